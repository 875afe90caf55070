"""SentencePiece-style encoding and decoding: unigram Viterbi over a
double-array trie, with byte fallback and the whitespace marker.

A piece file of the ``sentencepiece`` library gives pieces and scores (ranks
of a BPE file become log scores by Zipf's law). The trie over the pieces'
bytes is a double array: child ``base[s] + byte + 1`` of state ``s`` exists if
``check`` there is ``s``. Encoding walks it from all positions of many words
at once, then fills the best score of every position, word ends last, again
for all words at once; a character without a piece costs the lowest score less
ten and becomes its byte pieces. As no piece reaches over the start of a word,
a text is the sequence of its words, and each task segments a word once
(a bounded store keeps them).

Scoring one row needs only its own text: encoding and decoding are narrow
passes; the trie (about a megabyte) is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.llm.common import release_memory, with_text
from rivalry.llm.units import UnitStore

MARKER = "▁"


@dataclass
class Pieces:
    """Piece bytes (marker as a space) and scores by id; the trie's arrays."""

    texts: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray | None
    unknown: int
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    def parts(self) -> tuple:
        return self.texts, self.scores, self.byte_ids, self.unknown, self.base, self.check, self.value


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base``, ``check`` and ``value`` (-1: no key ends here) of a trie; the root is state 0."""
    children: list[dict] = [{}]
    end = [-1]
    for key, v in zip(keys, values):
        s = 0
        for b in key:
            t = children[s].get(b)
            if t is None:
                t = children[s][b] = len(children)
                children.append({})
                end.append(-1)
            s = t
        end[s] = v
    size = 4 * len(children) + 1024
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    taken = bytearray(size)
    taken[0] = 1
    check[0], value[0] = 0, end[0]
    place = {0: 0}
    free, top, queue = 1, 1, [0]  # every slot below free is taken, none from top on
    for s in queue:
        kids = sorted(children[s])
        if not kids:
            continue
        slot, tries = max(free, kids[0] + 1), 0
        while True:  # a few holes are tried, then the end of the array
            slot = max(taken.find(0, slot), 0) if tries < 32 else max(top, kids[0] + 1)
            at = slot - kids[0] - 1
            if not any(taken[at + b + 1] for b in kids):
                break
            slot, tries = slot + 1, tries + 1
        if at + 600 >= size:
            more = size
            base, check, value = (np.concatenate([x, np.full(more, v, np.int32)]) for x, v in ((base, 0), (check, -1), (value, -1)))
            taken += bytes(more)
            size += more
        me = place[s]
        base[me] = at
        for b in kids:
            t, k = children[s][b], at + b + 1
            place[t], check[k], value[k], taken[k] = k, me, end[t], 1
            top = max(top, k + 1)
            queue.append(t)
        free = taken.find(0, free)
    size = top + 260  # a step from any state stays inside
    return base[:size].copy(), check[:size].copy(), value[:size].copy()


def load(path: str, *, ranks: bool) -> Pieces:
    """Pieces of a sentencepiece model file. ``ranks``: its scores are merge
    ranks, not log probabilities."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    texts, score, normal, bytes_ = [], np.zeros(n), [], {}
    for i in range(n):
        piece = p.id_to_piece(i)
        score[i] = p.get_score(i)
        if p.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
            texts.append(bytes([int(piece[3:5], 16)]))
        elif p.is_control(i) or p.is_unknown(i):
            texts.append(b"" if p.is_control(i) else " ⁇ ".encode())
        else:
            texts.append(piece.replace(MARKER, " ").encode())
            if not p.is_unused(i):
                normal.append(i)
    if ranks:
        rank = np.maximum(score[normal] * -1, 0)
        real = rank < 1e8
        rank = np.where(real, rank, rank[real].max() + 1 if real.any() else 0)
        weight = 1.0 / (rank + 2)
        score[normal] = np.log(weight / weight.sum())
    byte_ids = np.array([bytes_[b] for b in range(256)], np.int32) if len(bytes_) == 256 else None
    if any(b" " in texts[i].lstrip(b" ") for i in normal):
        raise ValueError("a piece reaches over the start of a word")
    trie = double_array([texts[i] for i in normal], normal)
    return Pieces(texts, score, byte_ids, p.unk_id(), *trie)


def segment(units: list[bytes], parts: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Best segmentations of many byte strings: (ids per unit, flat ids)."""
    texts, scores, byte_ids, unknown, base, check, value = parts
    size = np.array([len(u) for u in units], dtype=np.int64)
    data = np.frombuffer(b"".join(units), dtype=np.uint8)
    n = len(data)
    if n == 0:
        return np.zeros(len(units), np.int64), np.empty(0, np.int32)
    first = np.cumsum(size) - size
    unit_end = np.repeat(first + size, size)
    lead = (data & 0xC0) != 0x80  # character starts
    starts = np.flatnonzero(lead)
    width = np.diff(np.append(starts, n))
    # all pieces that start at a character, walked in step
    at, state = starts, np.zeros(len(starts), np.int32)
    edge_from, edge_to, edge_id = [], [], []
    step = 0
    while len(at):
        here = at + step
        inside = here < unit_end[at]
        at, state, here = at[inside], state[inside], here[inside]
        child = base[state] + data[here].astype(np.int32) + 1
        ok = check[child] == state
        at, state = at[ok], child[ok]
        step += 1
        v = value[state]
        hit = v >= 0
        edge_from.append(at[hit])
        edge_to.append(at[hit] + step)
        edge_id.append(v[hit])
    e_from, e_to, e_id = np.concatenate(edge_from), np.concatenate(edge_to), np.concatenate(edge_id)
    # a character without a piece of its own
    width_at = np.zeros(n + 1, np.int64)
    width_at[starts] = width
    alone = np.zeros(n, bool)
    alone[e_from[e_to - e_from == width_at[e_from]]] = True
    lost = starts[~alone[starts]]
    e_score = scores[e_id]
    if len(lost):
        e_from = np.concatenate([e_from, lost])
        e_to = np.concatenate([e_to, lost + width_at[lost]])
        e_id = np.concatenate([e_id, np.full(len(lost), -1, e_id.dtype)])
        e_score = np.concatenate([e_score, np.full(len(lost), _floor(scores, value) - 10.0)])
    # best way to every position, by distance from the word's start; equal scores keep the longest last piece
    begin = np.repeat(first, size)
    depth = e_to - begin[e_from]
    order = np.lexsort((e_from, e_to, depth))
    e_from, e_to, e_id, e_score, depth = e_from[order], e_to[order], e_id[order], e_score[order], depth[order]
    # slot of a position: one per byte plus one per unit, so that a word's end is not the next word's start
    unit_of = np.repeat(np.arange(len(units)), size)
    s_from = e_from + unit_of[e_from]
    s_to = e_to + unit_of[e_from]
    best = np.full(n + len(units), -np.inf)
    best[first + np.arange(len(units))] = 0.0
    back = np.zeros(n + len(units), np.int64)
    bounds = np.flatnonzero(np.concatenate([[True], depth[1:] != depth[:-1], [True]]))
    for a, b in zip(bounds[:-1], bounds[1:]):
        total = best[s_from[a:b]] + e_score[a:b]
        to = s_to[a:b]
        new = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        top = np.maximum.reduceat(total, new)
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, b - a)))
        winner = np.flatnonzero(total == top[group])
        keep = winner[np.concatenate([[True], group[winner][1:] != group[winner][:-1]])]
        best[to[keep]] = total[keep]
        back[to[keep]] = a + keep
    # back from every word's end
    live = np.flatnonzero(size > 0)
    here = (first + size + np.arange(len(units)))[live]
    home = (first + np.arange(len(units)))[live]
    used = []
    while len(here):
        e = back[here]
        used.append(e)
        here = s_from[e]
        on = here != home
        here, home = here[on], home[on]
    used = np.concatenate(used)
    used = used[np.argsort(s_from[used], kind="stable")]
    ids, unit = e_id[used], unit_of[e_from[used]]
    if byte_ids is not None and (ids < 0).any():
        count = np.where(ids < 0, e_to[used] - e_from[used], 1)
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        spread = np.repeat(ids, count)
        raw = data[np.repeat(e_from[used], count) + offset]
        ids, unit = np.where(spread < 0, byte_ids[raw], spread), np.repeat(unit, count)
    else:
        ids = np.where(ids < 0, unknown, ids)
    return np.bincount(unit, minlength=len(units)).astype(np.int64), ids.astype(np.int32)


def segment_all(units: list[bytes], parts: tuple, at_once: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """:func:`segment` over runs of about ``at_once`` bytes, which bounds the
    working memory of the walk (a longer unit is a run of its own)."""
    lengths, flat, run, size = [], [], [], 0
    for unit in units:
        if run and size + len(unit) > at_once:
            n, ids = segment(run, parts)
            lengths.append(n)
            flat.append(ids)
            run, size = [], 0
        run.append(unit)
        size += len(unit)
    n, ids = segment(run, parts)
    return np.concatenate([*lengths, n]), np.concatenate([*flat, ids])


def _floor(scores: np.ndarray, value: np.ndarray) -> float:
    return float(scores[value[value >= 0]].min())


def text_units(text: str) -> list[bytes]:
    """Words of a text with a space put before it; a unit stands for the one
    space before it and its bytes, which begin with any further spaces."""
    words = text.replace(MARKER, " ").encode().split(b" ")
    if b"" not in words:
        return words
    units, spaces = [], 0
    for k, w in enumerate(words):
        if w or k == len(words) - 1:
            units.append(b" " * spaces + w)
            spaces = 0
        else:
            spaces += 1
    return units


def encode(df: DataFrame, pieces: Pieces, *, text_col: str = "text", keep: Sequence[str] | None = None, out: str = "ids",
           decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` (all if None) of every row with its piece ids in
    ``out`` (array of int; a column of that name is replaced) and, if
    ``decoded`` names one, a column with what :func:`decode` makes of them.

    NULL gives NULL, an empty text no ids. Every other text, whitespace only
    included, is encoded whole with a space put before it; spaces and the
    marker character are the same. Repeated rows encode alike and an empty
    table gives no rows."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (out, decoded)]
    extra = [T.StructField(decoded, T.StringType())] if decoded else []
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.IntegerType())), *extra])
    shared = df.sparkSession.sparkContext.broadcast(pieces.parts())
    src, text_of = with_text(df, keep, text_col)

    def run(batches):
        # one store per task: an idle worker keeps nothing for other stages to pay for
        store = UnitStore(lambda us: segment_all([b" " + u for u in us], shared.value), bound=60_000)
        for batch in batches:
            text = text_of(batch)
            at = 0
            while at < len(text):  # about half a million characters at a time
                first, units, per_text, size = at, [], [], 0
                while at < len(text) and (size < 1 << 19 or not per_text):
                    t = text[at].as_py() or ""
                    u = text_units(t) if t else []
                    units += u
                    per_text.append(len(u))
                    size += len(t)
                    at += 1
                n, flat = store.ids(units)
                edges = np.concatenate([[0], np.cumsum(n)])
                ends = np.cumsum(per_text)
                offsets = np.concatenate([[0], edges[ends]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=text.slice(first, at - first).is_null())
                back = [_joined(lists, shared.value[0], shared.value[3])] if decoded else []
                yield pa.RecordBatch.from_arrays([*[c.slice(first, at - first) for c in batch.columns[: len(keep)]], lists, *back], names=schema.names)
        del store
        release_memory()

    return src.mapInArrow(run, schema)


def _joined(lists: pa.Array, texts: list[bytes], unknown: int) -> pa.Array:
    """The texts of lists of ids."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    flat = np.where((flat >= 0) & (flat < len(texts)), flat, unknown).astype(np.int64)
    ends = np.cumsum(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))
    values, a = [], 0
    for b, missing in zip(ends.tolist(), lists.is_null().to_pylist()):
        raw = b"".join(map(texts.__getitem__, flat[a:b].tolist()))
        values.append(None if missing else raw.removeprefix(b" ").decode("utf-8", "replace"))
        a = b
    return pa.array(values, pa.string())


def decode(df: DataFrame, pieces: Pieces, *, ids_col: str = "ids", keep: Sequence[str] | None = None, out: str = "decoded") -> DataFrame:
    """The columns ``keep`` (all if None) of every row with the text of its
    ids in ``out``: pieces joined, markers as spaces, the space put before the
    text removed, byte pieces as UTF-8 (what is not valid becomes U+FFFD),
    control pieces empty. NULL gives NULL; a NULL id or one outside the
    pieces is the unknown piece."""
    keep = [c for c in (df.columns if keep is None else keep) if c != out]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast((pieces.texts, pieces.unknown))

    def run(batches):
        texts, unknown = shared.value
        for batch in batches:
            lists = batch.column(len(keep))
            for first in range(0, len(lists), 256):
                back = _joined(lists.slice(first, 256), texts, unknown)
                yield pa.RecordBatch.from_arrays([*[c.slice(first, 256) for c in batch.columns[:-1]], back], names=schema.names)
        release_memory()

    return df.select(*keep, F.col(ids_col).cast("array<int>").alias("_decoded_ids")).mapInArrow(run, schema)
