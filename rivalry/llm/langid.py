"""Language identification by multilingual mixture inference.

Every learned language is a smoothed distribution over hashed byte 4-grams of
lower-cased letters (with word borders). A document is a mixture: each of its
n-grams was drawn from one of its languages. Expectation-maximisation finds
the language proportions of a document from the n-gram likelihoods; the
language set is the one of the nested candidates (best single language, the
two largest shares, ... up to all) whose log-likelihood, less a penalty for
each language, is largest. The prediction is the largest share of that set.

The model is fitted on every label, on about ``docs_per_language`` distinct
texts of each, or all if it has fewer; copies of a text count once. It holds
``buckets`` numbers per language (32 KB by default), which are broadcast.
Scoring is one narrow pass over whole texts, vectorised over many documents at
once and, for many languages, in blocks of documents and of languages.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.llm.common import release_memory, utf8_slices, with_text
from rivalry.session import cut_lineage

UNDETERMINED = "und"
_LETTER = np.full(256, 32, dtype=np.uint8)  # ASCII letters lowered, bytes of other characters kept, the rest a space
_LETTER[65:91] = np.arange(97, 123)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)
_CELLS = 1 << 23  # numbers of one working matrix (n-grams, languages) or (texts, languages)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    log_p: np.ndarray | None = None  # (buckets, languages)
    buckets: int = 1 << 14


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every 4-gram that holds a letter, row by row."""
    n_rows = len(offsets) - 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(n_rows), sizes)
    padded = np.full(len(data) + 4 * n_rows, 32, dtype=np.uint8)
    padded[np.arange(len(data)) + 4 * row + 2] = _LETTER[data]
    owner = np.repeat(np.arange(n_rows), sizes + 4)
    if len(padded) < 4:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    p = padded.astype(np.uint32)
    code = (p[:-3] << np.uint32(24)) | (p[1:-2] << np.uint32(16)) | (p[2:-1] << np.uint32(8)) | p[3:]
    ok = (owner[:-3] == owner[3:]) & (code != 0x20202020)
    bits = int(buckets).bit_length() - 1
    hashed = (code[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    return owner[:-3][ok], hashed.astype(np.int64)


_SLICE = 1 << 17  # bytes of text at once: the kernels hold some hundred times as many
_BLOCK = 256  # languages whose counts reach the driver at once


def fit(
    df: DataFrame, *, text_col: str = "text", lang_col: str = "lang", docs_per_language: int = 2000,
    buckets: int = 1 << 13, smoothing: float = 0.5,
) -> LanguageModel:
    """Learn from the rows with a text and a label. Without any, the model has
    no languages and predicts ``und``."""
    src = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter(
        "text is not null and lang is not null").withColumn("h", F.xxhash64("text"))
    # one row per language reaches the driver
    sizes = src.groupBy("lang").agg(F.countDistinct("h").alias("texts")).collect()
    if not sizes:
        return LanguageModel(buckets=buckets)
    languages = sorted(r["lang"] for r in sizes)
    spark = df.sparkSession
    share = spark.createDataFrame([(r["lang"], min(1.0, docs_per_language / r["texts"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30)
    # a drawn text comes with all its copies, of which one is learned
    sample = src.join(F.broadcast(share), "lang").filter(draw < F.col("share")).dropDuplicates(["lang", "h"]).select("text", "lang")
    index = {name: k for k, name in enumerate(languages)}

    def counts(total):
        for k, n in total.items():
            g = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(g), pa.array(n[g])], names=["k", "g", "n"])

    def count(batches):
        total = {}
        for batch in batches:
            lang = np.array([index[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for lo, hi, data, offsets in utf8_slices(batch.column(0), _SLICE):
                row, g = grams(data, offsets, buckets)
                known, slot = np.unique(lang[lo:hi], return_inverse=True)
                for at in range(0, len(known), 64):
                    part = known[at: at + 64]
                    here = slot[row] - at
                    mine = (here >= 0) & (here < 64)
                    found = np.bincount(here[mine] * buckets + g[mine], minlength=len(part) * buckets).reshape(len(part), buckets)
                    for k, n in zip(part.tolist(), found):
                        total[k] = total[k] + n if k in total else n.copy()
                if len(total) > _BLOCK:
                    yield from counts(total)
                    total = {}
        yield from counts(total)

    counted = sample.mapInArrow(count, "k long, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    if len(languages) > _BLOCK:
        counted = cut_lineage(counted)
    log_p = np.empty((buckets, len(languages)), dtype=np.float32)
    for lo in range(0, len(languages), _BLOCK):
        hi = min(lo + _BLOCK, len(languages))
        part = counted.filter(F.col("k").between(lo, hi - 1)).toPandas()
        table = np.zeros((buckets, hi - lo))
        table[part["g"].to_numpy(np.int64), part["k"].to_numpy(np.int64) - lo] = part["n"].to_numpy(float)
        log_p[:, lo:hi] = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * buckets))
    return LanguageModel(languages, log_p, buckets)


def mixtures(row, gram, n_rows, log_p, *, rounds=6, penalty=0.01, cells=_CELLS):
    """Shares (n_rows, languages) of the selected language set of each row;
    rows without n-grams get zeros. ``penalty`` is the gain in log-likelihood
    per n-gram (besides half a logarithm of their number) that one more
    language must bring. Nothing else bounds a set: nested sets are tried up to
    all languages, and a row leaves the search only when no set of that size
    or more can win by the bound on its log-likelihood. Texts are taken as many
    at a time as keep a matrix of n-grams and languages within ``cells``
    numbers, a text beyond that in blocks of languages."""
    n_lang = log_p.shape[1]
    buckets = log_p.shape[0]
    out = np.zeros((n_rows, n_lang))
    if len(row) == 0 or n_lang == 0:
        return out
    key = row * buckets + gram
    if n_rows * buckets <= 16 * len(key):  # a dense count beats a sort unless the texts are short
        n = np.bincount(key, minlength=n_rows * buckets)
        key = np.flatnonzero(n)
        n = n[key]
    else:
        key, n = np.unique(key, return_counts=True)
    doc, g = key // buckets, key % buckets
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    ends = np.append(starts[1:], len(doc))
    n = n.astype(np.float32)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + cells // n_lang, side="right")))
        lo, hi = starts[i], ends[j - 1]
        out[doc[starts[i:j]]] = _selected(g[lo:hi], n[lo:hi], starts[i:j] - lo, log_p, rounds, penalty, cells)
        i = j
    return out


def _selected(g, n, starts, log_p, rounds, penalty, cells):
    """Shares of the selected set of each of some texts; ``g`` and ``n`` are
    their distinct n-grams with counts, a text's from its entry of ``starts``."""
    n_lang = log_p.shape[1]
    local = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(g))))
    size = np.add.reduceat(n, starts)
    width = max(1, cells // len(g))
    cuts = [(a, min(a + width, n_lang)) for a in range(0, n_lang, width)]
    lp = log_p[g] if len(cuts) == 1 else None

    def block(a, b):
        return log_p[:, a:b][g] if lp is None else lp

    top = block(*cuts[0]).max(axis=1)
    for cut in cuts[1:]:
        top = np.maximum(top, block(*cut).max(axis=1))
    single = np.concatenate([np.add.reduceat(n[:, None] * block(*cut), starts, axis=0, dtype=np.float64) for cut in cuts], axis=1)
    scaled = np.exp(lp - top[:, None]) if len(cuts) == 1 else None  # per n-gram, so that nothing underflows
    base = np.add.reduceat(n * top, starts, dtype=np.float64)

    def like(a, b):
        return np.exp(block(a, b) - top[:, None]) if scaled is None else scaled

    def mixed(pi):
        return np.maximum(sum((like(a, b) * pi[:, a:b][local]).sum(axis=1) for a, b in cuts), 1e-30)

    def slope(mix):
        w = (n / mix)[:, None]
        return np.concatenate([np.add.reduceat(like(*cut) * w, starts, axis=0) for cut in cuts], axis=1) / size[:, None]

    shares = np.full((len(starts), n_lang), 1.0 / n_lang, dtype=np.float32)
    for _ in range(rounds):
        shares = shares * slope(mixed(shares))
    best = np.zeros_like(shares)
    best[np.arange(len(starts)), single.argmax(axis=1)] = 1.0
    cost = penalty * size + 0.5 * np.log(size + 1)
    best_value = single.max(axis=1) - cost
    # no set exceeds this: the log-likelihood is concave in the shares, so the
    # steepest direction at any shares bounds what is left to gain
    mix = mixed(shares)
    steepest = np.maximum(slope(mix).max(axis=1).astype(np.float64), 1.0)
    most = base + np.add.reduceat(n * np.log(mix), starts, dtype=np.float64) + size * np.log(steepest)
    order = np.argsort(-shares, axis=1, kind="stable")
    for k in range(2, n_lang + 1):
        # only the texts that k or more languages could still win are fitted again
        some = np.flatnonzero(most - k * cost > best_value)
        if len(some) == 0:
            break
        slot = np.full(len(starts), -1)
        slot[some] = np.arange(len(some))
        rows = np.flatnonzero(slot[local] >= 0)
        where, m = slot[local[rows]], n[rows]
        langs = order[some, :k]
        each = langs[where]
        part = np.exp(log_p[g[rows][:, None], each] - top[rows, None]) if scaled is None else scaled[rows[:, None], each]
        begin = np.searchsorted(where, np.arange(len(some)))
        pi = np.take_along_axis(shares[some], langs, 1)
        pi = pi / np.maximum(pi.sum(axis=1, keepdims=True), 1e-30)
        for _ in range(rounds):
            w = m / np.maximum((part * pi[where]).sum(axis=1), 1e-30)
            pi = pi * np.add.reduceat(part * w[:, None], begin, axis=0) / size[some, None]
        mix = np.maximum((part * pi[where]).sum(axis=1), 1e-30)
        value = base[some] + np.add.reduceat(m * np.log(mix), begin, dtype=np.float64) - k * cost[some]
        better = value > best_value[some]
        best[some[better]] = 0.0
        best[some[better][:, None], langs[better]] = pi[better]
        best_value[some[better]] = value[better]
    return best


def identify(df: DataFrame, model: LanguageModel, *, text_col: str = "text", keep: Sequence[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (all if None) of every row of ``df``, with
    ``lang_pred`` (the language of the largest share), ``score`` (that share,
    0 to 1), ``languages`` and ``shares`` (the selected set, largest first).

    A NULL text, or one without a letter, is ``und`` with score 0 and an empty
    set; so is every text under a model without languages. Equal shares go to
    the language that sorts first. Columns of ``df`` with the names of the
    added ones are replaced (``prefix`` goes before those). Repeated rows are scored alike, an empty table
    gives no rows, texts are read whole.
    """
    added = [prefix + c for c in ("lang_pred", "score", "languages", "shares")]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    src, text_of = with_text(df, keep, text_col)
    schema = T.StructType([df.schema[c] for c in keep] + [
        T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType()),
        T.StructField(added[2], T.ArrayType(T.StringType())), T.StructField(added[3], T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.log_p))
    buckets = model.buckets

    def score(batches):
        languages, log_p = shared.value
        step = max(1, _CELLS // max(1, len(languages)))  # texts
        for batch in batches:
            text = text_of(batch)
            for lo, hi, data, offsets in utf8_slices(text, _SLICE):
                pred, value, names, parts = [], [], [], []
                ascii_letters = np.add.reduceat(
                    np.append((_LETTER[data] != 32) & (data < 128), False), offsets[:-1]) * (np.diff(offsets) > 0)
                row, g = grams(data, offsets, buckets)
                for r in range(hi - lo):
                    if r % step == 0:
                        a, b = np.searchsorted(row, [r, r + step])
                        share = mixtures(row[a:b] - r, g[a:b], min(step, hi - lo - r), log_p) if languages else None
                    ok = bool(languages) and share[r % step].any()
                    if ok and not ascii_letters[r]:
                        ok = any(ch.isalpha() for ch in (text[lo + r].as_py() or ""))
                    if not ok:
                        pred.append(UNDETERMINED)
                        value.append(0.0)
                        names.append([])
                        parts.append([])
                        continue
                    p = share[r % step]
                    order = np.flatnonzero(p > 0)
                    order = order[np.argsort(-p[order], kind="stable")]
                    pred.append(languages[order[0]])
                    value.append(float(min(1.0, p[order[0]])))
                    names.append([languages[k] for k in order])
                    parts.append([float(p[k]) for k in order])
                kept = [c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays(
                    [*kept, pa.array(pred, pa.string()), pa.array(value, pa.float64()),
                     pa.array(names, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], names=schema.names)
        release_memory()

    return src.mapInArrow(score, schema)
