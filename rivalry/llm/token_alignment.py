"""Alignment of two tokenizers' tokens, with counts of linked id pairs over
the whole corpus.

Both tokenizers split the bytes of a space and the text into intervals. Byte
offsets where tokens of both end cut them into groups; two tokens are linked
where their byte ranges overlap, that is once for every stretch between
neighbouring token ends. Units (words with their space, runs of line breaks)
are aligned once per process, see :mod:`rivalry.llm.wordwise`.

Counting pairs works like an external sort:

1. One pass over the texts turns every batch of documents into pair-document
   records (pair, document, times). When enough are held they are sorted,
   B's id first, and spilled as a *run*: one zstd cell for each radix digit of
   B's id (low part), holding the run's pairs with their totals, and another
   with the documents behind them. Cells are rows of a table in the shared
   folder.
2. The pair cells of a digit meet in one task; a k-way heap merge of sorted
   cells adds up the count of each pair. As B's id leads the order, all pairs
   of an id are neighbours, and its highest count is known when they end. A
   digit's result is bounded by the vocabularies, however frequent an id is.
3. The counts stream back past the pair cells of the same digit, and each cell
   is answered in its own order. An answer returns to its run, where the
   records give every document its sums. The records themselves are read by
   run and never meet by pair, so a pair that half the corpus holds is spread
   over all runs.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import release_memory
from rivalry.llm.token_files import text_runs
from rivalry.llm.units import process_memo
from rivalry.llm.wordwise import UnitTable, cut
from rivalry.session import cut_lineage

_ORDINAL = 22  # bits of a document's place in its run


@dataclass
class Alignment:
    """``documents``: one row per document; ``pairs``: ``b_id, a_id, count,
    best`` (whether no pair of the B id has a higher count)."""

    documents: DataFrame
    pairs: DataFrame


# ------------------------------------------------------------ two tokenizers
class Tokenizers:
    """Tokens of both sides for pieces of text, by the libraries themselves.

    A is a byte-level file of the tokenizers library, B a file of the
    sentencepiece library that puts a space before the text."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        names = self.a.get_vocab()
        self.n_a = max(names.values()) + 1
        alphabet = byte_alphabet()
        a_bytes = [b""] * self.n_a
        for name, k in names.items():
            a_bytes[k] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
        n_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n_b)]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.a_bytes, self.b_bytes = a_bytes, b_bytes
        self.a_len = np.array([len(x) for x in a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in b_bytes], np.int64)
        # units are exact if no piece reaches over a border: a marker after another character, or a line break among others
        normal = [p for k, p in enumerate(pieces) if not (self.b.is_byte(k) or self.b.is_control(k) or self.b.is_unknown(k))]
        self.by_unit = not any("\n" in p or "▁" in p.lstrip("▁") for p in normal)
        self.line = self.b.encode("\n")
        # tokens as they are written: in front of another of their side, last of A, last of the group
        self.a_text = pa.array([f"{k}{end}" for end in ",|" for k in range(self.n_a)], pa.large_binary())
        self.b_text = pa.array([f"{k}{end}" for end in ",;" for k in range(n_b)], pa.large_binary())

    def ids_a(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_b(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]

    def whole(self, texts: list[str]) -> dict:
        """Columns of whole texts, the space put before them."""
        return self.columns(self.ids_a([" " + t for t in texts]), self.ids_b(texts), [" " + t for t in texts])

    def units(self, units: list[str]) -> dict:
        """Columns of units: a word with its space, a word after a line break, or line breaks."""
        # a unit's ids in its place: after a line break, or after a visible character (and before one, unless trailing)
        a, b = [], []
        runs = [u[0] == "\n" for u in units]
        spaced = [u[0] == " " for u in units]
        plain = [u.rstrip(" ") if r else u for u, r in zip(units, runs)]
        told = ["a" + u + ("" if units[k][-1] == " " else "a") if runs[k] else u for k, u in enumerate(plain)]
        for k, ids in enumerate(self.ids_a(told)):
            a.append(ids if not runs[k] else ids[1:] if units[k][-1] == " " else ids[1:-1])
        skip = len(self.line)
        for k, ids in enumerate(self.ids_b([u[1:] if s else u if r else "\n" + u for u, s, r in zip(plain, spaced, runs)])):
            b.append(ids if spaced[k] else ids[skip - 1:] if runs[k] else ids[skip:])
        return self.columns(a, b, plain)

    def columns(self, a: list[np.ndarray], b: list[np.ndarray], texts: list[str]) -> dict:
        """Per text: ``sizes`` (n_a, n_b, n_groups, n_links), ``pairs`` (the
        linked ids, one number a link), ``text`` (the groups as written, each
        with ``;`` behind) and ``same`` (whether both sides give its bytes).
        A text whose sides differ has no tokens."""
        raw = [t.encode() for t in texts]
        same = [b"".join(map(self.a_bytes.__getitem__, x.tolist())) == r and b"".join(map(self.b_bytes.__getitem__, y.tolist())) == r
                for x, y, r in zip(a, b, raw)]
        none = np.zeros(0, np.int64)
        a = [x if s else none for x, s in zip(a, same)]
        b = [y if s else none for y, s in zip(b, same)]
        n = len(texts)
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(y) for y in b], np.int64)
        a, b = np.concatenate([none, *a]), np.concatenate([none, *b])
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        length = np.array([len(r) if s else 0 for r, s in zip(raw, same)], np.int64)
        text_end = np.cumsum(length)
        # every stretch between neighbouring token ends lies in one token of each side
        ends = np.union1d(end_a, end_b)
        in_a, in_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        groups = np.intersect1d(end_a, end_b, assume_unique=True)
        text_of = lambda e: np.searchsorted(text_end, e)
        n_groups = np.bincount(text_of(groups), minlength=n)[:n]
        n_links = np.bincount(text_of(ends), minlength=n)[:n]
        # groups as written: all tokens sorted by group, A before B
        group_a, group_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
        last_a = np.append(group_a[1:] != group_a[:-1], True) if len(a) else np.zeros(0, bool)
        last_b = np.append(group_b[1:] != group_b[:-1], True) if len(b) else np.zeros(0, bool)
        written = pa.concat_arrays([self.a_text.take(pa.array(a + self.n_a * last_a)), self.b_text.take(pa.array(b + len(self.b_len) * last_b))])
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        written = written.take(pa.array(order))
        place = np.frombuffer(written.buffers()[1], np.int64, len(written) + 1, 8 * written.offset)
        data = written.buffers()[2].to_pybytes() if len(written) else b""
        edge = place[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return {
            "sizes": (np.full(n, 4), np.stack([n_a, n_b, n_groups, n_links], axis=1).reshape(-1)),
            "pairs": (n_links, b[in_b] * self.n_a + a[in_a]),
            "text": [data[x:y] for x, y in zip(edge, edge[1:])],
            "same": same,
        }


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: a
    printable Latin-1 character for itself, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


# ---------------------------------------------------------------- spilled runs
def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length each, as 64-bit numbers under zstandard; sorted
    ones should come as differences."""
    head = np.array([len(arrays), *map(len, arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays))


def _unpack(cell: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(cell)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes, at, out = np.frombuffer(raw, np.int64, k, 8).tolist(), 8 + 8 * k, []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view("<i8").reshape(-1))
        at += 8 * n
    return out


def _first_differences(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=0)


class _Run:
    """Pair-document records of one run until they are spilled."""

    def __init__(self, digits: int, n_a: int):
        self.digits, self.n_a = digits, n_a
        self.name = uuid.uuid4().hex
        self.docs = self.held = 0
        self.records: list[np.ndarray] = []
        self.times: list[np.ndarray] = []

    def add(self, pairs: np.ndarray, docs: int, doc: np.ndarray) -> None:
        """``pairs``: one number a link; ``doc``: the document of each, from 0."""
        record, times = np.unique((pairs << _ORDINAL) | (doc + self.docs), return_counts=True)
        self.records.append(record)
        self.times.append(times.astype(np.int32))
        self.docs += docs
        self.held += len(record)

    def cells(self):
        """(digit, pair cell, record cell) of every radix digit in use."""
        if not self.held:
            return
        record, times = np.concatenate(self.records), np.concatenate(self.times)
        self.records, self.times = [], []
        digit = ((record >> _ORDINAL) // self.n_a) % self.digits
        order = np.lexsort((record, digit))
        record, times, digit = record[order], times[order], digit[order]
        edges = np.flatnonzero(np.diff(digit, prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
            pair, n = record[lo:hi] >> _ORDINAL, times[lo:hi]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            docs = np.diff(first, append=hi - lo)
            ordinal = record[lo:hi] & ((1 << _ORDINAL) - 1)
            yield int(digit[lo]), _pack(_first_differences(pair[first]), np.add.reduceat(n, first, dtype=np.int64)), _pack(docs, _first_differences(ordinal), n)


def merge_counts(cells: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """k-way heap merge of sorted (pairs, counts); equal pairs add up."""
    if len(cells) == 1:
        return cells[0]
    streams = [zip(p.tolist(), c.tolist()) for p, c in cells]
    pairs: list[int] = []
    counts: list[int] = []
    last = -1
    for pair, count in heapq.merge(*streams):
        if pair == last:
            counts[-1] += count
        else:
            pairs.append(pair)
            counts.append(count)
            last = pair
    return np.array(pairs, np.int64), np.array(counts, np.int64)


def highest(pairs: np.ndarray, counts: np.ndarray, n_a: int) -> np.ndarray:
    """Whether a pair's count is the highest of its B id, pairs in B's order."""
    side = pairs // n_a
    first = np.flatnonzero(np.diff(side, prepend=-1))
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(pairs)))


def align(
    df: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", digits: int = 256, fan_in: int = 128,
    run_records: int = 1_000_000, with_groups: bool = False,
) -> Alignment:
    """Align the tokens of every text under two tokenizers.

    ``documents`` has ``doc_id, n_a, n_b`` (tokens), ``n_groups, n_links``,
    ``n_best`` (links whose pair's count over the corpus is the highest of its
    B id, ties included), ``count_sum`` (the counts of the pairs, over links)
    and ``groups_sha256`` of the groups ``a1,a2|b1;a3|b2`` (empty without
    tokens); with ``with_groups`` also that text as ``groups``.

    A NULL or empty text, or one whose joined token bytes on either side
    differ from its own with a space before it (a marker character in it, for
    one), has no tokens: zeros. Strings of special tokens are plain text. A
    row per row: repeated rows count each, rows with a NULL id like others. An
    empty table gives empty results. Other columns are ignored."""
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("ordinal", pa.int64()), ("run", pa.string()), ("digit", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                     ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("groups", pa.string()),
                     ("pairs", pa.binary()), ("records", pa.binary())])

    def load():
        both = Tokenizers(a_path, b_path)
        return both, UnitTable(both.units, 120_000)

    def batch_of(n: int, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in out], schema=out)

    def spill(run: _Run):
        names, pairs, records, size = [], [], [], 0
        for digit, pair_cell, record_cell in run.cells():
            names.append(digit)
            pairs.append(pair_cell)
            records.append(record_cell)
            size += len(pair_cell) + len(record_cell)
            if size > 4 << 20:
                yield batch_of(len(names), {"run": pa.array([run.name] * len(names)), "digit": pa.array(names, pa.int64()),
                                            "pairs": pa.array(pairs, pa.binary()), "records": pa.array(records, pa.binary())})
                names, pairs, records, size = [], [], [], 0
        if names:
            yield batch_of(len(names), {"run": pa.array([run.name] * len(names)), "digit": pa.array(names, pa.int64()),
                                        "pairs": pa.array(pairs, pa.binary()), "records": pa.array(records, pa.binary())})

    def tokens(batches):
        both, table = process_memo("two tokenizers", (a_path, b_path), load)
        run = _Run(digits, both.n_a)
        for batch in batches:
            for lo, hi in text_runs(batch.column(1), 1 << 20):
                n = hi - lo
                text = batch.column(1).slice(lo, n)
                c = cut(text, first_spaced=True)
                if both.by_unit:
                    # only whole texts need their strings here
                    whole = c.whole.tolist()
                else:
                    whole = [k for k in range(n) if text[k].as_py()]
                    c.per_text[:] = 0
                    c.codes = c.codes[:0]
                rows = table.rows(c.units)[c.codes] if len(c.codes) else c.codes.astype(np.int64)
                ends = np.cumsum(c.per_text)
                starts = ends - c.per_text
                good = np.fromiter(map(table.lists.get("same", []).__getitem__, rows.tolist()), bool, len(rows))
                row_text = np.repeat(np.arange(n), c.per_text)
                failed = np.bincount(row_text[~good], minlength=n) > 0
                keep = ~failed[row_text]
                sizes = np.zeros((n, 4), np.int64)
                values = table.gather("sizes", rows[keep])[1].reshape(-1, 4)
                np.add.at(sizes, row_text[keep], values)
                n_pairs, pairs = table.gather("pairs", rows[keep])
                owner = np.repeat(row_text[keep], n_pairs)
                written = table.lists.get("text", [])
                groups: list[bytes] = [b""] * n
                row_list = rows.tolist()
                for k in np.flatnonzero((c.per_text > 0) & ~failed).tolist():
                    groups[k] = b"".join([written[r] for r in row_list[starts[k]: ends[k]]])[:-1]
                if whole:
                    w = both.whole([text[k].as_py() for k in whole])
                    sizes[whole] = w["sizes"][1].reshape(-1, 4)
                    pairs = np.concatenate([pairs, w["pairs"][1]])
                    owner = np.concatenate([owner, np.repeat(np.array(whole, np.int64), w["pairs"][0])])
                    for k, t in zip(whole, w["text"]):
                        groups[k] = t[:-1]
                first = run.docs
                run.add(pairs, n, owner)
                yield batch_of(n, {
                    "doc_id": batch.column(0).slice(lo, n), "ordinal": pa.array(np.arange(first, first + n)), "run": pa.array([run.name] * n),
                    **{name: pa.array(sizes[:, k]) for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))},
                    "groups_sha256": pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in groups]),
                    **({"groups": pa.array([g.decode() for g in groups])} if with_groups else {})})
                if run.held >= run_records or run.docs >= 1 << (_ORDINAL - 1):
                    yield from spill(run)
                    run = _Run(digits, both.n_a)
        yield from spill(run)
        release_memory()

    spilled = cut_lineage(src.mapInArrow(
        tokens, "doc_id long, ordinal long, run string, digit long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, pairs binary, records binary"))
    n_a = Tokenizers(a_path, b_path).n_a

    def merged(batches):
        """Sorted by digit: one row per digit, its pairs with their counts."""
        def row(digit, cells):
            pairs, counts = merge_counts(cells)
            return pa.RecordBatch.from_pydict({"digit": [digit], "counts": [_pack(_first_differences(pairs), counts, highest(pairs, counts, n_a))]})

        now, cells = None, []
        for batch in batches:
            for digit, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
                if digit != now:
                    if cells:
                        yield row(now, cells)
                    now, cells = digit, []
                difference, counts = _unpack(cell.as_py())
                cells.append((np.cumsum(difference), counts))
                if len(cells) == fan_in:
                    cells = [merge_counts(cells)]
        if cells:
            yield row(now, cells)

    cells = spilled.filter("digit is not null")
    by_digit = cells.select("digit", "pairs").repartition("digit").sortWithinPartitions("digit")
    counted = cut_lineage(by_digit.mapInArrow(merged, "digit long, counts binary"))

    def answered(batches):
        """The counts of a digit come first, then its pair cells: each gets its pairs' counts."""
        now = keys = counts = best = None
        for batch in batches:
            names, digits_, answers = [], [], []
            for digit, name, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if name is None:
                    difference, counts, best = _unpack(cell.as_py())
                    now, keys = digit, np.cumsum(difference)
                    continue
                if digit != now:
                    raise ValueError("a digit without counts")
                at = np.searchsorted(keys, np.cumsum(_unpack(cell.as_py())[0]))
                names.append(name)
                digits_.append(digit)
                answers.append(_pack(counts[at], best[at]))
            if names:
                yield pa.RecordBatch.from_pydict({"run": pa.array(names), "digit": pa.array(digits_, pa.int64()), "cell": pa.array(answers, pa.binary())})

    flow = counted.select("digit", F.lit(None).cast("string").alias("run"), F.col("counts").alias("cell")).union(cells.select("digit", "run", F.col("pairs").alias("cell")))
    flow = flow.repartition("digit").sortWithinPartitions("digit", F.col("run").asc_nulls_first())
    answers = flow.mapInArrow(answered, "run string, digit long, cell binary")

    def returned(batches):
        """Sorted by run and digit, the answer before the records: sums by document."""
        now, best_sum, count_sum, counts, best, digit_of = None, None, None, None, None, None

        def rows():
            used = np.flatnonzero(count_sum)
            return pa.RecordBatch.from_arrays([pa.array([now] * len(used), pa.string()), pa.array(used), pa.array(best_sum[used]), pa.array(count_sum[used])],
                                              names=["run", "ordinal", "n_best", "count_sum"])

        for batch in batches:
            for name, digit, answer, cell in zip(*[batch.column(k).to_pylist() for k in range(3)], batch.column(3)):
                if name != now:
                    if now is not None:
                        yield rows()
                    now, best_sum, count_sum = name, np.zeros(1024, np.int64), np.zeros(1024, np.int64)
                if answer:
                    counts, best = _unpack(cell.as_py())
                    digit_of = digit
                    continue
                if digit != digit_of:
                    raise ValueError("records without an answer")
                docs, difference, times = _unpack(cell.as_py())
                ordinal = np.cumsum(difference)
                top = int(ordinal.max()) + 1
                if top > len(count_sum):
                    best_sum, count_sum = (np.concatenate([x, np.zeros(2 * top - len(x), np.int64)]) for x in (best_sum, count_sum))
                np.add.at(count_sum, ordinal, times * np.repeat(counts, docs))
                np.add.at(best_sum, ordinal, times * np.repeat(best, docs))
        if now is not None:
            yield rows()

    back = answers.select("run", "digit", F.lit(True).alias("answer"), "cell").union(cells.select("run", "digit", F.lit(False).alias("answer"), F.col("records").alias("cell")))
    back = back.repartition("run").sortWithinPartitions("run", "digit", F.col("answer").desc())
    sums = back.mapInArrow(returned, "run string, ordinal long, n_best long, count_sum long")
    documents = spilled.filter("digit is null").select(
        "doc_id", "run", "ordinal", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if with_groups else [])).join(sums, ["run", "ordinal"], "left")
    documents = documents.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256", *(["groups"] if with_groups else []))

    def listed(batches):
        for batch in batches:
            for cell in batch.column(0):
                difference, counts, best = _unpack(cell.as_py())
                pairs = np.cumsum(difference)
                yield pa.RecordBatch.from_arrays([pa.array(pairs // n_a), pa.array(pairs % n_a), pa.array(counts), pa.array(best == 1)],
                                                 names=["b_id", "a_id", "count", "best"])

    return Alignment(documents, counted.select("counts").mapInArrow(listed, "b_id long, a_id long, count long, best boolean"))
