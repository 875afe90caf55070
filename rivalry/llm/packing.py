"""Packing documents into sequences: order-preserving dynamic programming.

The token ids of a stream of documents, each with its end id, are cut into
windows of at most ``length`` ids. A window of another size is padded to
``length``, but one whose size is a power of two needs no padding. A cut costs
nothing behind a document, ``sentence_cost`` behind a sentence, and
``token_cost`` elsewhere, where it is allowed only so that no two allowed
places lie more than ``length`` apart. The cheapest cuts (padding plus cut
costs, then the fewest windows) come from

    best[j] = cut[j] + min(best[i] + length - (j - i)) over i >= j - length,

the minimum of ``best[i] + i`` over a sliding range of places, which a
monotone queue keeps at its front; windows of a power of two are compared
besides.

Documents stay in their order and their partition: the pass is narrow, no text
is shuffled. A partition is packed in blocks of at least ``block`` ids, cut at
document ends, so the memory follows the block and the longest document.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.llm.common import release_memory
from rivalry.llm.token_files import batch_encoder, text_runs
from rivalry.llm.units import process_memo

# a cost and a number of windows in one integer: the cost decides, then the number
_UNIT = 1 << 32


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, *, length: int, sentence_cost: int, token_cost: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs): the allowed cuts of a stream, ascending, its start
    first and its end last. Where two neighbours lie more than ``length``
    apart, places at every ``length`` ids between them are added."""
    places = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > length)
    n = (gaps[wide] - 1) // length
    first = np.cumsum(n) - n
    extra = np.repeat(places[wide], n) + (np.arange(int(n.sum())) - np.repeat(first, n) + 1) * length
    places = np.sort(np.concatenate([places, extra]))
    cost = np.full(len(places), token_cost, np.int64)
    cost[np.searchsorted(places, sentence_ends)] = sentence_cost
    cost[np.searchsorted(places, doc_ends)] = 0
    cost[0] = 0
    return places, cost


def best_cuts(places: np.ndarray, costs: np.ndarray, length: int) -> list[int]:
    """The cheapest windows: the indexes into ``places`` where windows end."""
    n = len(places)
    # windows whose size is a power of two, as pairs (end, begin) by end
    ends, begins = [], []
    size = 1
    while size <= length:
        at = np.searchsorted(places, places - size)
        hit = np.flatnonzero((places >= size) & (places[np.minimum(at, n - 1)] == places - size))
        ends.append(hit)
        begins.append(at[hit])
        size *= 2
    ends, begins = np.concatenate(ends), np.concatenate(begins)
    order = np.argsort(ends, kind="stable")
    first = np.searchsorted(ends[order], np.arange(n + 1)).tolist()
    begins = begins[order].tolist()

    place, cost = places.tolist(), (costs * _UNIT).tolist()
    best, back = [0] * n, [0] * n
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (best + place, place, index), values ascending
    for j in range(1, n):
        p = place[j]
        while queue[0][1] < p - length:
            queue.popleft()
        value, _, i = queue[0]
        value += (length - p) * _UNIT
        for k in begins[first[j]: first[j + 1]]:
            if best[k] < value:
                value, i = best[k], k
        value += cost[j] + 1
        best[j], back[j] = value, i
        value += p * _UNIT
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, p, j))
    path, j = [], n - 1
    while j:
        path.append(j)
        j = back[j]
    return path[::-1]


def _end_marks(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """By id of a byte-level vocabulary: whether the token ends a sentence,
    and whether it begins with white space."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    names = t.get_vocab()
    stop, space = np.zeros(max(names.values()) + 1, bool), np.zeros(max(names.values()) + 1, bool)
    for name, k in names.items():
        stop[k] = name[-1:] in (".", "!", "?", "Ċ")  # the last: a line break in the byte alphabet
        space[k] = name[:1] in ("Ġ", "Ċ", "č", "ĉ")
    return stop, space


def pack(
    df: DataFrame, *, tokenizer: str, end_id: int = 1, length: int = 2048, id_col: str = "doc_id", text_col: str = "text",
    sentence_cost: int = 4, token_cost: int = 64, block: int = 1 << 22, with_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents: ``doc_id, start`` (ids of its document
    before it), ``length, ids_crc32`` (of the piece's ids as little-endian
    unsigned 32-bit integers), ``doc_tokens`` (ids of its document, the end id
    included), ``sequence_id`` and ``offset`` (the ids before it in its
    sequence, gapless from 0); with ``with_ids`` also the ids as ``ids``
    (binary). A sequence's pieces are consecutive in the stream.

    ``df`` is encoded with the byte-level tokenizers file ``tokenizer``,
    without special tokens; ``end_id`` follows each document. A sentence ends
    at a token that ends in ``.``, ``!``, ``?`` or a line break, before one
    that begins with white space. A NULL or empty text has only the end id.
    Repeated rows and rows that share an id, NULL included, are packed each.
    An empty table has no pieces. Other columns are ignored. Sequence ids are
    unique; they follow the order of the partitions, with gaps.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    names = [c.split()[0] for c in schema.split(", ")]
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def packed(doc_ids: list, sizes: np.ndarray, flat: np.ndarray, stop: np.ndarray, space: np.ndarray, first_sequence: int):
        doc_ends = np.cumsum(sizes)
        begins_word = np.zeros(len(flat), bool)
        begins_word[:-1] = space[flat[1:]]
        sentences = np.flatnonzero(stop[flat] & begins_word) + 1
        places, costs = cut_places(doc_ends, sentences, length=length, sentence_cost=sentence_cost, token_cost=token_cost)
        window_ends = places[best_cuts(places, costs, length)]
        # every piece ends at a window's or a document's end
        ends = np.union1d(window_ends, doc_ends)
        starts = np.concatenate([[0], ends[:-1]])
        doc = np.searchsorted(doc_ends, starts, side="right")
        window = np.searchsorted(window_ends, starts, side="right")
        window_start = np.concatenate([[0], window_ends])[window]
        raw = flat.astype("<u4").tobytes()
        parts = [raw[4 * a: 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
        columns = [
            pa.array([doc_ids[k] for k in doc.tolist()], pa.int64()), pa.array(starts - (doc_ends - sizes)[doc]), pa.array(ends - starts),
            pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(sizes[doc]), pa.array(first_sequence + window), pa.array(starts - window_start),
            *([pa.array(parts, pa.binary())] if with_ids else []),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names), len(window_ends)

    def run(batches):
        from pyspark import TaskContext

        encode = batch_encoder(tokenizer)
        stop, space = process_memo("sentence marks", tokenizer, lambda: _end_marks(tokenizer))
        sequence = TaskContext.get().partitionId() << 40
        doc_ids, sizes, parts, held = [], [], [], 0
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), batch.column(1)
            for lo, hi in text_runs(text):
                n, flat = encode(text.slice(lo, hi - lo))
                flat = np.insert(flat, np.cumsum(n), end_id)
                doc_ids += ids[lo:hi]
                sizes.append(n + 1)
                parts.append(flat)
                held += len(flat)
                if held >= block:
                    out, used = packed(doc_ids, np.concatenate(sizes), np.concatenate(parts), stop, space, sequence)
                    yield out
                    sequence += used
                    doc_ids, sizes, parts, held = [], [], [], 0
        if held:
            yield packed(doc_ids, np.concatenate(sizes), np.concatenate(parts), stop, space, sequence)[0]
        release_memory()

    return src.mapInArrow(run, schema)
