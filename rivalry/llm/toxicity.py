"""Toxicity: boosted trees over dense text features, isotonically calibrated.

Features of a whole text: densities of lexicon words (a given list and terms
learned from the labels, in two strengths), their nearness to a second-person
word, capitals, exclamation and other punctuation, repeated symbols, and
obfuscation (symbols or digits inside words, and lexicon words that appear
once those are read as letters).

Learning uses at most about ``sample`` labelled documents, all of them in
every step, but no step is judged on what it was fitted to: term statistics
are taken ``FOLDS`` times without one fold, whose features then come from the
others' terms, and two ``GBTClassifier`` fits score each other's half for
``IsotonicRegression``. Learned terms are words and word beginnings that stand
out in the sentences of toxic documents (at most ``max_terms``); a sentence
counts once however many documents repeat it, so copies of a document do not
make its words stand out. Scoring is one narrow pass for the features and
Spark's own model transforms.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.llm.common import release_memory, utf8_slices, with_text
from rivalry.session import cut_lineage

# fixed values: plain insults of the lexicon's given part, and second-person words, of the languages at hand
INSULTS = tuple("""
ass asshole bastard bitch bullshit clown creep crap cretin damn degenerate dick disgusting dumb dumbass fool freak
fuck fucking garbage hate hateful horrible idiot idiotic ignorant imbecile jerk kill liar loser lousy lunatic moron
moronic nasty pathetic pervert pig psycho retard retarded scum shit shitty shut sick slut stupid sucker suck sucks
terrible trash twat ugly useless vermin whore wimp worthless
arschloch blöd depp drecksack dumm dummkopf hure idioten miststück schlampe trottel
connard connasse crétin imbécile merde putain salaud salope
cabrón estúpido gilipollas idiota imbécil mierda pendejo puta tonto
""".split())
SECOND_PERSON = tuple("""
you your yours yourself yourselves u ur ya du dich dir dein deine deiner deinen ihr euch euer eure sie tu te toi ton
ta tes vous votre vos tú ti tuyo usted ustedes vosotros vuestro
""".split())
NAMES = ("given", "given_log", "strong", "strong_log", "weak", "weak_log", "near_you", "second_person",
         "capitals", "all_caps", "exclaim", "punctuation", "repeated", "inner_symbols", "disguised")
_LEET = str.maketrans("0134578@$!|+€", "oieastbasiite")
_TOKEN = re.compile(r"[^\W_]+")
_DISGUISED = re.compile(r"(?<!\w)[A-Za-z]*(?:[A-Za-z][0-9@$!|+*€]+|[@$][A-Za-z])[A-Za-z0-9@$!|+*€]*[A-Za-z]")
_KIND = np.zeros(256, dtype=np.uint8)  # 1 letter, 2 capital A-Z, 3 digit, 4 exclamation mark, 5 other punctuation, 0 the rest
_KIND[[*range(97, 123), *range(128, 256)]] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[*range(34, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 5
_KIND[33] = 4


@dataclass
class Lexicon:
    given: frozenset = frozenset(INSULTS)
    second: frozenset = frozenset(SECOND_PERSON)
    strong: frozenset = field(default_factory=frozenset)  # learned terms; "abcd*" stands for all words beginning abcd
    weak: frozenset = field(default_factory=frozenset)


def terms(word: str) -> list[str]:
    """The word and its beginnings of four to eight letters, marked with a star."""
    return [word, *[word[:k] + "*" for k in (4, 5, 6, 7, 8) if len(word) > k]]


class _Marks(dict):
    """Word -> bits of the lists it belongs to, filled as words come; emptied
    when it grows past a bound."""

    def __init__(self, given, second, strong, weak):
        super().__init__()
        self.lists = given, second, strong, weak

    def __missing__(self, word: str) -> int:
        t, (given, second, strong, weak) = terms(word), self.lists
        mark = (word in given) + 2 * any(w in strong for w in t) + 4 * any(w in weak for w in t) + 8 * (word in second)
        if len(self) > 100_000:
            self.clear()
        self[word] = mark
        return mark


def feature_rows(texts: list[str], kinds: list[np.ndarray], marks: _Marks) -> np.ndarray:
    """One row of ``NAMES`` for each text; ``kinds`` holds the byte kinds of
    its UTF-8 form."""
    out = np.zeros((len(texts), len(NAMES)))
    for r, text in enumerate(texts):
        if not text:
            continue
        words = _TOKEN.findall(text.lower())
        m = np.fromiter(map(marks.__getitem__, words), dtype=np.uint8, count=len(words))
        n = max(1, len(words))
        given, strong, weak = ((m & b) > 0 for b in (1, 2, 4))
        you = np.flatnonzero(m & 8)
        hit = np.flatnonzero(given | strong)
        near = 0
        if len(you) and len(hit):
            at = np.searchsorted(you, hit)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hit), np.abs(you[np.maximum(at - 1, 0)] - hit))
            near = int((gap <= 4).sum())
        k = kinds[r]
        size = max(1, len(k))
        count = np.bincount(k, minlength=6)
        letter, same = (k == 1) | (k == 2), k[1:] == k[:-1]
        inner = int((~letter[1:-1] & (k[1:-1] > 0) & letter[:-2] & letter[2:]).sum()) if len(k) > 2 else 0
        again = int((same & (k[1:] >= 4)).sum())
        shout = int((same & (k[1:] == 2)).sum())
        disguised = 0
        if inner or "@" in text or "$" in text:
            for x in _DISGUISED.findall(text):
                plain = x.lower().translate(_LEET).replace("*", "")
                disguised += bool(marks[plain] & 3) and not marks[x.lower()] & 3
        g, s, w = int(given.sum()), int(strong.sum()), int(weak.sum())
        out[r] = (g / n, np.log1p(g), s / n, np.log1p(s), w / n, np.log1p(w), near / n, len(you) / n,
                  count[2] / size, shout / size, count[4] / size, count[5] / size, again / size, inner / n, disguised / n)
    return out


def features(df: DataFrame, lexicon: Lexicon, *, text_col: str, keep: Sequence[str], text_in_row: bool = False) -> DataFrame:
    """``keep`` and ``features`` (array of double, in the order of
    ``NAMES``). ``text_in_row``: the text is a field of the struct ``keep[0]``."""
    if text_in_row:
        src, text_of = df.select(*keep), lambda batch: batch.column(0).field(text_col)
    else:
        src, text_of = with_text(df, list(keep), text_col)
    shared = df.sparkSession.sparkContext.broadcast((lexicon.given, lexicon.second, lexicon.strong, lexicon.weak))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("features", T.ArrayType(T.DoubleType()))])
    width = len(NAMES)

    def run(batches):
        marks = _Marks(*shared.value)
        for batch in batches:
            text = text_of(batch)
            for lo, hi, data, offsets in utf8_slices(text):
                kind = _KIND[data]
                kinds = [kind[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
                flat = feature_rows([t or "" for t in text.slice(lo, hi - lo).to_pylist()], kinds, marks).reshape(-1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * width), pa.array(flat))
                kept = [c.slice(lo, hi - lo) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*kept, lists], names=schema.names)
        marks.clear()
        release_memory()

    return src.mapInArrow(run, schema)


FOLDS = 3
_SLOTS = [f"n{k}" for k in range(2 * FOLDS)]  # 2 * fold + label


def _counts_by_slot(rows: DataFrame) -> DataFrame:
    """``term`` and its number of ``rows(term, slot)`` by slot."""
    return rows.groupBy("term").agg(*[F.count(F.when(F.col("slot") == k, 1)).alias(c) for k, c in enumerate(_SLOTS)])


def _standing_out(a, b, share: float):
    """Signed root of the likelihood ratio of ``a`` toxic and ``b`` clean
    places against the usual share of toxic ones; NULL for terms whose odds
    are less than four times the usual, however many they are."""
    ratio = a * F.log(a / ((a + b) * share)) + F.when(b > 0, b * F.log(b / ((a + b) * (1 - share)))).otherwise(0.0)
    return F.when((a >= 3) & (a * (1 - share) >= 4 * share * (b + 0.5)), F.sqrt(F.greatest(2 * ratio, F.lit(0.0))))


def learn_terms(df: DataFrame, *, max_terms: int, weak_z: float = 4.0, strong_z: float = 6.0) -> list[tuple[frozenset, frozenset]]:
    """Strong and weak terms of labelled texts (``text``, ``y``, ``fold``):
    without each fold in turn, then of all.

    Candidates stand out by the number of distinct sentences that hold them.
    They are then judged by the number of distinct words and neighbours they
    occur with, so that near copies of a document count once, too. A sentence
    or place that a clean document holds is clean."""
    sentence = F.explode(F.split("text", r"[.!?\n]+")).alias("s")
    lines = df.select(sentence, "y", "fold").withColumn("s", F.lower(F.trim("s"))).filter("s != ''").groupBy(F.xxhash64("s")).agg(
        F.first("s").alias("s"), F.min("y").alias("y"), F.min("fold").alias("fold")).select("s", F.expr("2 * fold + y").alias("slot"))
    slots = 2 * FOLDS

    def count(batches):
        seen, sizes = {}, [0] * slots
        for batch in batches:
            for text, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sizes[k] += 1
                for t in {t for w in set(_TOKEN.findall(text)) if len(w) < 40 for t in terms(w)}:
                    n = seen.get(t)
                    if n is None:
                        n = seen[t] = [0] * slots
                    n[k] += 1
                if len(seen) > 200_000:
                    yield counted(seen)
                    seen = {}
        seen[""] = sizes  # the sentences themselves
        yield counted(seen)
        release_memory()

    def counted(seen):
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([n[k] for n in seen.values()], pa.int64()) for k in range(slots)]],
                                          names=["term", *names])

    names = list(_SLOTS)
    stats = lines.mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in names)).groupBy("term").agg(*[F.sum(c).alias(c) for c in names])

    def label(y, folds=range(FOLDS)):
        return sum(F.col(_SLOTS[2 * k + y]) for k in folds).cast("double")

    stats = cut_lineage(stats.filter((F.col("term") == "") | (label(1) >= 3)))
    sizes = stats.filter("term = ''").first()
    toxic, clean = (sum(sizes[_SLOTS[2 * k + y]] if sizes else 0 for k in range(FOLDS)) for y in (1, 0))
    if not toxic or not clean:
        return [(frozenset(), frozenset())] * (FOLDS + 1)
    share = toxic / (toxic + clean)
    # a bounded number of terms reaches the driver, and the executors as a broadcast
    z = _standing_out(label(1), label(0), share)
    top = stats.filter("term != ''").select("term", z.alias("z")).filter(F.col("z") >= weak_z).orderBy(F.desc("z"), "term").limit(4 * max_terms)
    candidates = df.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in top.collect()))

    def places(batches):
        wanted, known = candidates.value, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = set()
                for text, slot in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    words = ["", *_TOKEN.findall((text or "").lower()), ""]
                    for k in range(1, len(words) - 1):
                        found = known.get(words[k])
                        if found is None:
                            if len(known) > 100_000:
                                known.clear()
                            found = known[words[k]] = [t for t in terms(words[k]) if t in wanted]
                        if found:
                            place = " ".join(words[k - 1: k + 2])
                            out.update((t, place, slot) for t in found)
                if out:
                    a, b, c = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["term", "place", "slot"])
        release_memory()

    found = df.select("text", F.expr("2 * fold + y").cast("long").alias("slot")).mapInArrow(places, "term string, place string, slot long")
    # a place that a clean document holds is clean, in the fold where it is first found
    found = found.groupBy("term", F.xxhash64("place").alias("place")).agg(F.min(F.col("slot") % 2).alias("y"), F.min(F.expr("slot div 2")).alias("fold"))
    stats = cut_lineage(_counts_by_slot(found.select("term", F.expr("2 * fold + y").alias("slot"))))
    out = []
    for left_out in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left_out]
        z = _standing_out(label(1, folds), label(0, folds), share)
        top = stats.select("term", z.alias("z")).filter(F.col("z") >= weak_z).orderBy(F.desc("z"), "term").limit(max_terms).collect()
        out.append((frozenset(r["term"] for r in top if r["z"] >= strong_z), frozenset(r["term"] for r in top if r["z"] < strong_z)))
    candidates.destroy()
    return out


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    trees: object | None = None
    isotonic: object | None = None


def fit(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    sample: int = 24_000, max_terms: int = 2000, trees: int = 30, depth: int = 4, seed: int = 7,
) -> ToxicityModel:
    """Learn from the documents that ``labels`` (``id_col``, ``label_col``)
    marks 0 or 1; an id marked both ways counts as 1. Labelled ids beyond
    ``sample`` are left out by hash. With only one class the model scores
    every text 0."""
    y = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id is not null and y in (0, 1)")
    y = y.groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, sample / max(1, y.count()))
    draw = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) / float(1 << 30)
    y = y.filter(draw < share)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    part = F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(2 * FOLDS))
    # the sampled labels are at most about ``sample`` rows of two numbers
    train = cut_lineage(text.join(F.broadcast(y), "id").select("id", "text", "y", (part % FOLDS).alias("fold"), part.alias("part")))
    lexicons = [Lexicon(strong=strong, weak=weak) for strong, weak in learn_terms(train, max_terms=max_terms)]
    rows = [features(train.filter(F.col("fold") == k).coalesce(8), lexicons[k], text_col="text", keep=["y", "part"]) for k in range(FOLDS)]
    rows = cut_lineage(reduce(DataFrame.unionByName, rows)).select(
        F.col("y").cast("double").alias("label"), (F.col("part") >= FOLDS).alias("half"), array_to_vector("features").alias("features"))
    rows = rows.coalesce(4).cache()
    # two rows at most per half
    if rows.select("half", "label").distinct().count() < 4:
        rows.unpersist()
        return ToxicityModel(lexicons[-1]) if rows.select("label").distinct().count() < 2 else _small(rows, lexicons[-1], trees, depth, seed)
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=0.8, minInstancesPerNode=5, seed=seed, cacheNodeIds=False)
    p = F.element_at(vector_to_array("probability"), 2).alias("p")
    crossed = [boosted.fit(rows.filter(F.col("half") == h)).transform(rows.filter(F.col("half") != h)).select(p, "label") for h in (True, False)]
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(crossed[0].union(crossed[1]))
    model = boosted.fit(rows)
    rows.unpersist()
    return ToxicityModel(lexicons[-1], model, isotonic)


def _small(rows: DataFrame, lexicon: Lexicon, trees: int, depth: int, seed: int) -> ToxicityModel:
    """With so few labels that a half lacks a class: one fit, calibrated on itself."""
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, cacheNodeIds=False).fit(rows)
    scored = model.transform(rows).select(F.element_at(vector_to_array("probability"), 2).alias("p"), "label")
    return ToxicityModel(lexicon, model, IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(scored))


def score(df: DataFrame, model: ToxicityModel, *, text_col: str = "text", keep: Sequence[str] | None = None, threshold: float = 0.7, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (all if None) of every row, with ``score`` (0 to
    1) and ``predicted`` (1 if the score reaches ``threshold``, else 0).

    A NULL text is scored as an empty one. Repeated rows score alike, an empty
    table gives no rows, texts are read whole, and columns of ``df`` with the
    names of the added ones are replaced (``prefix`` goes before those)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (f"{prefix}score", f"{prefix}predicted")]
    if model.trees is None:
        return df.select(*keep, F.lit(0.0).alias(f"{prefix}score"), F.lit(0).alias(f"{prefix}predicted"))
    # the kept columns travel as one struct, so that none clashes with the model's own
    inside = text_col in keep and df.schema[text_col].dataType == T.StringType()
    packed = df.select(F.struct(*keep).alias("row"), *([] if inside else [F.col(text_col).cast("string").alias("_text")]))
    f = features(packed, model.lexicon, text_col=text_col if inside else "_text", keep=["row"], text_in_row=inside)
    f = f.select("row", array_to_vector("features").alias("features"))
    out = model.trees.transform(f).select("row", F.element_at(vector_to_array("probability"), 2).alias("p"))
    out = model.isotonic.transform(out)
    # the steps of the calibration keep a hundredth of the trees' order
    value = F.least(F.greatest(0.99 * F.col("score") + 0.01 * F.col("p"), F.lit(0.0)), F.lit(1.0))
    out = out.select("row", value.alias("value"))
    return out.select(*[F.col("row")[c].alias(c) for c in keep], F.col("value").alias(f"{prefix}score"),
                      (F.col("value") >= threshold).cast("int").alias(f"{prefix}predicted"))
