"""Token-id files: bit-plane or byte-plane shuffled blocks under zstandard.

Layout of a file: the magic; blocks; the document table (zstandard: ids with a
NULL mask, token counts); the chunk index (for each block its offset, number
of ids and the compressed size of every plane); a fixed-size tail with the
places of both and the magic again.

A block holds up to ``block`` ids. As unsigned 32-bit integers they are
transposed into planes: byte plane k has byte k of every id, bit plane k has
bit k of every id, eight to a byte. Equal planes (the high ones of small
ids) shrink to almost nothing. Each plane is compressed on its own.

Writing: documents are range-partitioned by id, so the files are one ascending
sequence; each task streams its documents into one file of its own in the
shared folder and returns the file's name and sizes. Only files named by
finished tasks enter the manifest, so a lost executor leaves at most an unread
file. Reading: one file a task, one block at a time.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.llm.common import file_system, release_memory
from rivalry.llm.units import process_memo
from rivalry.llm.wordwise import TRAILING, UnitTable, cut, splice, text_lengths
from rivalry.session import cut_lineage

MAGIC = b"IDPLANES"
_TAIL = "<QQQQ8s"


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    wide = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [wide[:, k].tobytes() for k in range(4)]
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        wide = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes], axis=1)
        wide = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(wide).view("<u4").reshape(-1)


class PlaneWriter:
    """Streams ids into blocks of a file; holds one block."""

    def __init__(self, sink, *, block: int, plane: str, level: int):
        self.sink, self.block, self.plane = sink, block, plane
        self.packer = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = self.total = 0
        self.place = len(MAGIC)
        self.index: list = []
        self.doc_ids: list = []
        self.counts: list[int] = []
        sink.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.total += len(ids)
        while len(ids):
            part, ids = ids[: self.block - self.held], ids[self.block - self.held:]
            self.waiting.append(part)
            self.held += len(part)
            if self.held == self.block:
                self._flush()

    def document(self, doc_id, count: int) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(count)

    def _flush(self) -> None:
        if not self.held:
            return
        packed = [self.packer.compress(p) for p in to_planes(np.concatenate(self.waiting), self.plane)]
        self.index.append([self.place, self.held, [len(p) for p in packed]])
        for p in packed:
            self.sink.write(p)
            self.place += len(p)
        self.waiting, self.held = [], 0

    def close(self) -> int:
        self._flush()
        docs = np.array([d if d is not None else 0 for d in self.doc_ids], "<i8").tobytes()
        null = np.array([d is None for d in self.doc_ids], np.uint8).tobytes()
        table = self.packer.compress(docs + null + np.array(self.counts, "<i8").tobytes())
        index = self.packer.compress(json.dumps({"plane": self.plane, "docs": len(self.counts), "blocks": self.index}).encode())
        self.sink.write(table)
        self.sink.write(index)
        self.sink.write(struct.pack(_TAIL, self.place, len(table), self.place + len(table), len(index), MAGIC))
        return self.place + len(table) + len(index) + struct.calcsize(_TAIL)


def read_file(source, size: int) -> Iterator[tuple]:
    """(doc_id, first id's place in the file, ids as bytes) of every document
    of a file opened for random access; holds one block and one document."""
    tail = struct.calcsize(_TAIL)
    source.seek(size - tail)
    t_at, t_len, i_at, i_len, magic = struct.unpack(_TAIL, source.read(tail))
    source.seek(0)
    if magic != MAGIC or source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    unpack = zstandard.ZstdDecompressor()
    source.seek(i_at)
    index = json.loads(unpack.decompress(source.read(i_len)))
    n = index["docs"]
    source.seek(t_at)
    table = unpack.decompress(source.read(t_len), max_output_size=17 * n + 1)
    docs, null = np.frombuffer(table, "<i8", n), np.frombuffer(table, np.uint8, n, 8 * n)
    counts = np.frombuffer(table[9 * n:], "<i8", n)

    def blocks():
        for place, held, sizes in index["blocks"]:
            source.seek(place)
            raw = source.read(sum(sizes))
            ends = np.cumsum(sizes)
            yield from_planes([unpack.decompress(raw[e - s: e]) for s, e in zip(sizes, ends)], held, index["plane"])

    stream, block, at, start = blocks(), np.empty(0, "<u4"), 0, 0
    for k in range(n):
        need, parts = int(counts[k]), []
        while need:
            if at == len(block):
                block, at = next(stream), 0
            part = block[at: at + need]
            parts.append(part.tobytes())
            at += len(part)
            need -= len(part)
        yield (None if null[k] else int(docs[k])), start, b"".join(parts)
        start += int(counts[k])


def batch_encoder(path: str, *, plain_specials: bool = False, bound: int = 400_000):
    """A function from a string column to (ids per text, flat ids) under the
    tokenizers library's file at ``path``, for a byte-level vocabulary whose
    pre-tokens never reach over a single space after a visible character.
    With ``plain_specials`` the strings of special tokens are plain text."""
    from tokenizers import Tokenizer

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use every core
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = plain_specials
        newline = tokenizer.encode("\n", add_special_tokens=False).ids

        def encode(texts):
            ids = [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([len(x) for x in ids], np.int64), np.concatenate(ids) if ids else np.empty(0, np.int32)

        def encode_units(units):
            """Words many at a time: the line breaks put between them come back as ids."""
            words = [k for k, u in enumerate(units) if u[0] != "\n" and len(newline) == 1]
            joined = ["\n".join([units[k] for k in words[a: a + 1000]]) for a in range(0, len(words), 1000)]
            parts, owner = [], []
            for a, e in enumerate(tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
                ids = np.array(e.ids, np.int32)
                inner = ids != newline[0]
                parts.append(ids[inner])
                owner.append(np.array(words[a * 1000: a * 1000 + 1000])[np.cumsum(~inner)[inner]])
            for k in sorted(set(range(len(units))) - set(words)):
                u = units[k]
                if u[0] != "\n":
                    ids = encode([u])[1]
                elif u.endswith(TRAILING):
                    ids = encode(["a" + u[:-1]])[1][1:]
                else:
                    ids = encode(["a" + u + "a"])[1][1:-1]
                parts.append(ids)
                owner.append(np.full(len(ids), k))
            owner = np.concatenate(owner)
            order = np.argsort(owner, kind="stable")
            return {"ids": (np.bincount(owner, minlength=len(units)).astype(np.int64), np.concatenate(parts)[order])}

        return encode, UnitTable(encode_units, bound)

    encode, table = process_memo("tokenizer", (path, plain_specials, bound), load)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        c = cut(texts)
        rows = table.rows(c.units)[c.codes] if len(c.codes) else c.codes
        n, flat = table.gather("ids", rows)
        w_len, w_flat = encode([texts[int(k)].as_py() for k in c.whole])
        return splice(text_lengths(n, c.per_text), flat, c.whole, w_len, w_flat)

    return run


def text_runs(column: pa.Array, max_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Cut a string column into runs of rows of about ``max_bytes`` (a longer
    text is a run of its own)."""
    sizes = pc.binary_length(column.cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + max_bytes, side="right"))
        hi = min(max(hi, lo + 1), len(sizes))
        yield lo, hi
        lo = hi


def write_token_files(
    df: DataFrame, path: str, *, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text",
    block: int = 1 << 16, plane: str = "byte", level: int = 3,
) -> DataFrame:
    """Encode every text with the tokenizers file ``tokenizer`` and write the
    ids, ``end_id`` after each document, to files under ``path`` in ascending
    id order (NULL ids last, equal ids by the first 64 characters of their
    texts, then by hash). Returns the manifest
    ``(part, file, bytes, docs, ids)``.

    A NULL or empty text has only the end id. Repeated rows are written each.
    An empty table writes nothing. Other columns are ignored.
    """
    if plane not in ("byte", "bit"):
        raise ValueError(f"plane must be byte or bit, not {plane!r}")
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # dealt by id and text, so rows without an id, or with one id, spread over many files; the sample that finds the
    # borders holds beginnings of texts only
    order = [F.col("id").asc_nulls_last(), F.substring("text", 1, 64).asc_nulls_first(), F.xxhash64("text")]
    dealt = src.repartitionByRange(*order).sortWithinPartitions(*order)

    def write(batches):
        from pyspark import TaskContext

        fs, folder = file_system(path)
        writer = sink = name = None
        encode = batch_encoder(tokenizer)
        end = np.array([] if end_id is None else [end_id], np.int32)
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1)
            if writer is None and len(ids):
                name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.ids"
                fs.create_dir(folder, recursive=True)
                sink = fs.open_output_stream(name)
                writer = PlaneWriter(sink, block=block, plane=plane, level=level)
            for lo, hi in text_runs(text):
                lengths, flat = encode(text.slice(lo, hi - lo))
                if len(end):
                    flat = np.insert(flat, np.cumsum(lengths), end[0])
                writer.add(flat)
                for k, n in enumerate(lengths.tolist()):
                    writer.document(ids[lo + k], n + len(end))
        if writer is not None:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{
                "part": TaskContext.get().partitionId(), "file": name.rsplit("/", 1)[1], "bytes": size,
                "docs": len(writer.counts), "ids": writer.total}])
        release_memory()

    return cut_lineage(dealt.mapInArrow(write, "part long, file string, bytes long, docs long, ids long"))


def read_token_files(manifest: DataFrame, path: str) -> DataFrame:
    """The documents of the files named by ``manifest``: ``doc_id, start``
    (ids of all documents before it), ``ids`` (binary, little-endian unsigned
    32-bit integers). One row per document, as written."""
    # one row per file
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", "bytes", F.coalesce(before, F.lit(0)).cast("long").alias("first"), "part")
    # one file a task: the names are so few bytes that any other dealing would meet in one task
    files = files.repartition(max(1, min(manifest.count(), 10_000)))

    def read(batches):
        fs, folder = file_system(path)
        for batch in batches:
            for r in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{r['file']}") as source:
                    rows, held = [], 0
                    for doc_id, start, ids in read_file(source, r["bytes"]):
                        rows.append((doc_id, r["first"] + start, ids))
                        held += len(ids)
                        if held > 4 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return files.mapInArrow(read, "doc_id long, start long, ids binary")


def _rows(rows) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "start", "ids"])
