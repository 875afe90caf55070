"""MinHash near-duplicates with b-bit signatures and exact confirmation.

1. One pass over the texts (Arrow batches, whole texts) gives every document
   its set size, a 128-bit fingerprint of its shingle set, band keys (each the
   hash of ``rows`` minima) and the low ``bits`` of all minima, packed.
2. Documents with equal sets collapse to the one with the smallest id.
3. In every band bucket, each member meets the bucket's smallest id, its
   pivot. The full sets give the exact intersection with the pivot and a
   bitmap of what the member has beyond it.
4. Members still in another component than their pivot meet a few deputies
   of one of their buckets, drawn by hash: variants of one text, of which each
   pair may or may not reach the similarity, grow together here.
5. What is left in several components is dealt in tiles of two blocks of at
   most ``_BLOCK`` members of a bucket. In a tile, a pair stays only where a
   link is possible: what two members share within the pivot is at most the
   smaller of their intersections with it, and beyond it at most what their
   bitmaps allow. If few pairs stay they are compared one by one; if many do,
   the tile's sets become rows of a 0/1 matrix whose product gives all
   intersections at once, and only a spanning set of links leaves the task.
6. Before any full sets are compared, the sizes must allow the similarity, and
   the b-bit estimate, corrected for chance agreement, must not be far below it
   (``slack`` standard errors).

With 32 bands of 4 minima a pair of similarity 0.8 misses every bucket with
probability (1 - 0.8^4)^32 = 5e-8, and the estimate's slack adds less than 1e-6.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.llm.common import WORD_SPACE, components, mix64, release_memory, utf8_slices
from rivalry.session import cut_lineage

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WORD_SPACE)] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = [np.uint64(v) for v in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word (A-Z lowered) of a run of texts, and the row
    each word belongs to."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    low = _LOWER[data]
    inside = ~_SPACE[low]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True  # a text's border also ends a word
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    starts = np.flatnonzero(start)
    if len(starts) == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    ends = np.flatnonzero(end) + 1
    length = (ends - starts).astype(np.uint64)
    # a polynomial in the word's bytes from one running sum: byte i has weight base^-i
    power = np.full(n, _inverse(_BASE), dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = (low.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    total = np.add.accumulate(value * power)
    before = np.where(starts > 0, total[starts - 1], np.uint64(0))
    lift = np.full(n, _BASE, dtype=np.uint64)
    lift[0] = 1
    lift = np.multiply.accumulate(lift)
    h = mix64((total[ends - 1] - before) * lift[starts] + length * _MIX[4])
    return h, np.searchsorted(offsets, starts, side="right") - 1


def _inverse(a: np.uint64) -> np.uint64:
    return np.uint64(pow(int(a), -1, 1 << 64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text of a run. A text with
    fewer than ``width`` words has its whole sequence as its only shingle."""
    h, row = word_hashes(data, offsets)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    out = []
    full = len(h) - width + 1
    if full > 0:
        s = np.zeros(full, dtype=np.uint64)
        for k in range(width):
            s = s * _BASE + h[k: k + full] * _MIX[k % 4]
        s = mix64(s)
    for r in range(n_rows):
        a, b = first[r], first[r + 1]
        if b - a >= width:
            part = np.sort(s[a: b - width + 1])
            out.append(part[np.concatenate([[True], part[1:] != part[:-1]])] if len(part) > 1 else part)
        elif b > a:
            x = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for v in h[a:b]:
                    x = x * _BASE + v
            out.append(mix64(np.array([x ^ _MIX[4]], dtype=np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def multipliers(n: int, seed: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


_BLOCK = 256  # members of a bucket on one side of a tile
_FEW = 4  # pairs per member up to which a tile's pairs are compared one by one
_DEPUTIES = 8
_MASK = 16  # 64-bit words of the bitmap of a member's shingles beyond its pivot


def compare(head: np.ndarray, other: np.ndarray) -> tuple[int, np.ndarray]:
    """Size of the intersection of two sorted sets, and what only ``other`` has."""
    if not len(head) or not len(other):
        return 0, other
    hit = head[np.minimum(np.searchsorted(head, other), len(head) - 1)] == other
    return int(hit.sum()), other[~hit]


def bitmap(hashes: np.ndarray) -> np.ndarray:
    place = hashes >> np.uint64(64 - 10)
    out = np.zeros(_MASK, dtype=np.uint64)
    np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    return out.view(np.int64)


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
    bands: int = 32, rows: int = 4, bits: int = 4, slack: float = 5.5, seed: int = 1,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are maximal runs without the bytes x20, x09-x0D, with A-Z lowered; a
    document's set holds its distinct shingles of ``width`` words (with fewer
    words, the whole sequence as one). Documents are linked if intersection /
    union of their sets is at least ``similarity``; every link is confirmed on
    the full sets. ``component_id`` is the smallest id reachable, ``kept``
    marks it.

    A NULL or wordless text has an empty set and links with nothing. Rows that
    repeat an id are documents of their own where their texts differ: each is
    linked by its own set. A row with a NULL id counts only
    as a copy of a named row with the same set, else it keeps a NULL component
    and ``kept`` false. An empty input gives no rows. Other columns are
    ignored.
    """
    return row_components(docs, id_col=id_col, text_col=text_col, width=width, similarity=similarity, bands=bands, rows=rows, bits=bits,
                          slack=slack, seed=seed).select("doc_id", "n_shingles", "component_id", "kept")


def row_components(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8,
    bands: int = 32, rows: int = 4, bits: int = 4, slack: float = 5.5, seed: int = 1,
) -> DataFrame:
    """:func:`near_duplicates` with two more columns: ``text_hash`` (xxhash64
    of the text) and ``first``, true for the rows with the id and text that
    stand for their component, or that are alone. A component has one such
    pair of id and text; rows that repeat it are all marked."""
    if 64 % bits:
        raise ValueError("bits must divide 64")
    perms = bands * rows
    a = multipliers(perms, seed)
    lanes = 64 // bits
    words = -(-perms // lanes)
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("n", T.LongType()), T.StructField("f1", T.LongType()),
        T.StructField("f2", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.ArrayType(T.LongType())),
    ])

    def features(batches):
        np.seterr(over="ignore")
        for batch in batches:
            for lo, hi, data, offsets in utf8_slices(batch.column(1)):
                sets = shingle_sets(data, offsets, width)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                has = np.flatnonzero(n)
                low = np.zeros((len(sets), perms), dtype=np.uint64)
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                if len(has):
                    flat = np.concatenate([sets[i] for i in has])
                    at = np.concatenate([[0], np.cumsum(n[has])[:-1]])
                    for k in range(perms):
                        low[has, k] = np.minimum.reduceat(flat * a[k], at)
                    f1[has] = np.add.reduceat(mix64(flat ^ _MIX[1]), at)
                    f2[has] = np.add.reduceat(mix64(flat + _MIX[2]), at)
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                for j in range(rows):
                    keys = mix64(keys * _BASE + low[:, j::rows][:, :bands])
                keys = mix64(keys ^ (np.arange(1, bands + 1, dtype=np.uint64) * _MIX[3]))
                # the low bits of a minimum of products are the plainest of its bits, so mix before cutting
                small = mix64(low) & np.uint64((1 << bits) - 1)
                packed = np.zeros((len(sets), words), dtype=np.uint64)
                for k in range(perms):
                    packed[:, k // lanes] |= small[:, k] << np.uint64(bits * (k % lanes))
                empty = n == 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo).cast(pa.int64()), batch.column(2).slice(lo, hi - lo), pa.array(n),
                    pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)),
                    _lists(keys.view(np.int64), empty), _lists(packed.view(np.int64), empty),
                ], names=schema.names)
        release_memory()

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    feats = cut_lineage(src.mapInArrow(features, schema))
    # equal sets: one class, named by its smallest id; empty sets stay out. An id may name several classes, so they get numbers
    full = feats.filter("n > 0")
    classes = cut_lineage(full.groupBy("n", "f1", "f2").agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h"))).alias("own"), F.first("bands").alias("bands"), F.first("sig").alias("sig")).filter(
        "own is not null").withColumn("id", F.monotonically_increasing_id()))
    owners = classes.select("id", F.col("own.id").alias("doc"), F.col("own.h").alias("h"))

    keyed = classes.select("id", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    keyed = cut_lineage(keyed.join(shared.select("key", "pivot"), "key"))
    sig = classes.select("id", "n", "sig")

    # chance agreement of b bits is 2^-b; the estimate must not be too far below the similarity
    chance = 0.5 ** bits
    agree = chance + (1 - chance) * similarity
    least = perms * agree - slack * math.sqrt(perms * agree * (1 - agree))

    def agreeing(x, y):
        one = sum(1 << (bits * k) for k in range(lanes))
        one = one - (1 << 64) if one >= 1 << 63 else one

        def differing(p, q):
            d = p.bitwiseXOR(q)
            folded = d
            for k in range(1, bits):
                folded = folded.bitwiseOR(F.shiftrightunsigned(d, k))
            return F.bit_count(folded.bitwiseAND(F.lit(one)))

        return F.lit(words * lanes) - sum(differing(x[k], y[k]) for k in range(words)) - F.lit(words * lanes - perms)

    def likely(p: str, q: str):
        sizes = F.least(f"n_{p}", f"n_{q}") * F.lit(10_000) >= F.greatest(f"n_{p}", f"n_{q}") * F.lit(round(similarity * 10_000))
        return sizes & (agreeing(F.col(f"sig_{p}"), F.col(f"sig_{q}")) >= math.floor(least))

    def side(p: str, frame: DataFrame = sig):
        return frame.select(*[F.col(c).alias(f"{c}_{p}") for c in frame.columns])

    star = keyed.filter("id != pivot").select(F.col("pivot").alias("id_a"), F.col("id").alias("id_b")).distinct()
    star = star.join(side("a"), "id_a").join(side("b"), "id_b").filter(likely("a", "b")).select("id_a", "id_b")
    met = compared(star, src, owners, width, similarity)
    links = met.filter("link").select("id_a", "id_b")
    comp = cut_lineage(components(links.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))))

    # members of a bucket that did not join its pivot meet deputies of the bucket, the same ones wherever a bucket has them
    def members_now(comp):
        """All members with their component and their pivot's, and the buckets that hold several components."""
        member = keyed.join(comp.withColumnRenamed("component_id", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        lead = comp.select(F.col("id").alias("pivot"), F.col("component_id").alias("lead"))
        member = member.join(lead, "pivot", "left").withColumn("lead", F.coalesce("lead", "pivot"))
        several = member.groupBy("key").agg((F.min("comp") != F.max("comp")).alias("several")).filter("several").select("key")
        return cut_lineage(member.join(several, "key"))

    def joined(comp, more):
        # components are stars already: the new links only join them
        return cut_lineage(components(comp.select(F.col("id").alias("a"), F.col("component_id").alias("b")).union(
            more.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))))

    member = members_now(comp)
    drawn = [F.min(F.struct(F.xxhash64(F.lit(k), "id").alias("h"), "id", "comp")).alias(f"d{k}") for k in range(_DEPUTIES)]
    deputies = member.groupBy("key").agg(*drawn).select("key", F.array_distinct(F.array(*[F.struct(f"d{k}.id", f"d{k}.comp") for k in range(_DEPUTIES)])).alias("d"))
    strays = member.filter("comp != lead").groupBy("id").agg(F.min_by("key", F.xxhash64("key")).alias("key"), F.first("comp").alias("comp"))
    second = strays.join(deputies, "key").select("id", "comp", F.explode("d").alias("d")).filter("comp != d.comp").select(
        F.least("id", "d.id").alias("id_a"), F.greatest("id", "d.id").alias("id_b")).distinct()
    second = second.join(side("a"), "id_a").join(side("b"), "id_b").filter(likely("a", "b")).select("id_a", "id_b")
    comp = joined(comp, compared(second, src, owners, width, similarity).filter("link"))

    # what is left: tiles of two blocks of a bucket
    member = members_now(comp)
    to_pivot = met.select(F.col("id_a").alias("pivot"), F.col("id_b").alias("id"), "inter", "extra", "mask")
    is_pivot = F.col("id") == F.col("pivot")
    blocks = member.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / _BLOCK).cast("int").alias("blocks"))
    body = member.join(blocks, "key").join(to_pivot, ["pivot", "id"], "left").join(classes.select("id", "n", "sig", "bands"), "id").select(
        "key", "id", "comp", "n", "sig", "blocks", F.slice("bands", F.lit(1), F.col("band")).alias("earlier"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"),
        F.when(is_pivot, F.col("n")).otherwise(F.col("inter")).alias("inter"),
        F.when(is_pivot, F.lit(0)).otherwise(F.col("extra")).alias("extra"),
        F.when(is_pivot, F.array(*[F.lit(0).cast("long")] * _MASK)).otherwise(F.col("mask")).alias("mask"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = body.select("*", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    tiles = dealt.select("key", "low", "high", "block", "id", "comp", "n", "inter", "extra", "sig", "mask", "earlier").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    tiles = cut_lineage(tiles.mapInArrow(_tile_pairs(bits, perms, math.floor(least), round(similarity * 10_000)), "key long, low int, high int, id_a long, id_b long"))
    cross = tiles.filter("id_b is not null").select("id_a", "id_b").distinct()
    more = compared(cross, src, owners, width, similarity).filter("link").select("id_a", "id_b")
    dense = tiles.filter("id_b is null").select("key", "low", "high", F.col("id_a").alias("id")).join(comp, "id", "left").select(
        "key", "low", "high", "id", F.coalesce("component_id", "id").alias("comp"))
    texts = src.select(F.col("id").alias("doc"), "h", "text").join(
        cut_lineage(owners.join(dense.select("id").distinct(), "id", "left_semi")), ["doc", "h"]).groupBy("id").agg(F.min("text").alias("text"))
    flow = dense.join(texts, "id").select("key", "low", "high", "id", "comp", "text").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    more = more.union(flow.mapInArrow(_tile_links(width, round(similarity * 10_000)), "id_a long, id_b long"))
    comp = joined(comp, more)

    lead = cut_lineage(comp.join(classes.select("id", "own"), "id").groupBy("component_id").agg(F.min("own").alias("lead")))
    if lead.count() <= 1_000_000:  # 24 bytes a component; a large component stays dealt evenly
        lead = F.broadcast(lead)
    named = classes.select("n", "f1", "f2", "id", "own").join(comp, "id", "left").join(lead, "component_id", "left").select(
        "n", "f1", "f2", F.coalesce("lead", "own").alias("lead"))
    out = full.select("id", "h", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left").select("id", "h", "n", "lead")
    out = out.union(feats.filter("n = 0").select("id", "h", "n", F.when(F.col("id").isNotNull(), F.struct("id", "h")).alias("lead")))
    kept = F.coalesce(F.col("id") == F.col("lead.id"), F.lit(False))
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("lead.id").alias("component_id"), kept.alias("kept"),
        F.col("h").alias("text_hash"), (kept & (F.col("h") == F.col("lead.h"))).alias("first"))


def _lists(matrix: np.ndarray, empty: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists; empty sets get NULL."""
    n, w = matrix.shape
    return pa.ListArray.from_arrays(
        pa.array(np.arange(n + 1, dtype=np.int32) * w), pa.array(np.ascontiguousarray(matrix).reshape(-1)),
        mask=pa.array(empty))


def compared(pairs: DataFrame, src: DataFrame, owners: DataFrame, width: int, similarity: float, slice_size: int = 256, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The full sets of every pair ``(id_a, id_b)`` compared: ``inter``, their
    intersection's size; ``extra``, how much ``b`` has beyond ``a``; ``mask``,
    the bitmap of that; ``link``, whether they reach the similarity. ``owners``
    gives the id and text hash ``(id, doc, h)`` whose text in ``src`` a number stands for.

    The texts of a pair's ``b`` side travel once per pair and that of ``a``
    once per slice of at most about ``slice_size`` partners, so a document
    with very many partners is spread over many tasks."""
    pairs = cut_lineage(pairs)
    fan = cut_lineage(pairs.groupBy("id_a").agg(F.ceil(F.count(F.lit(1)) / slice_size).alias("slices")).filter("slices > 1"))
    # one row for every slice_size pairs at most: without moving the pairs of a hot id as long as they are few
    fan = F.broadcast(fan) if fan.count() <= broadcast_ids else fan
    pairs = cut_lineage(pairs.join(fan, "id_a", "left").withColumn("slice", F.pmod(F.xxhash64("id_b"), F.coalesce("slices", F.lit(1)))).drop("slices"))
    need = cut_lineage(pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).distinct())
    # 24 bytes an id: the texts that no pair needs stay where they are; beyond the bound both sides are shuffled
    few = need.count() <= broadcast_ids
    need = cut_lineage(owners.join(need, "id", "left_semi"))
    if few:
        need = F.broadcast(need)
    # one text of the rows that repeat an id and a text
    texts = cut_lineage(src.select(F.col("id").alias("doc"), "h", "text").join(need, ["doc", "h"]).groupBy("id").agg(F.min("text").alias("text")))
    heads = pairs.select("id_a", "slice").distinct().join(texts, F.col("id_a") == F.col("id")).select(
        "id_a", "slice", F.lit(None).cast("long").alias("id_b"), "text")
    rest = pairs.join(texts, F.col("id_b") == F.col("id")).select("id_a", "slice", "id_b", "text")
    flow = heads.unionByName(rest).repartition("id_a", "slice").sortWithinPartitions("id_a", "slice", F.col("id_b").asc_nulls_first())
    # in ten-thousandths, so that 0.8 is exactly 8,000
    need_10k = round(similarity * 10_000)

    def check(batches):
        np.seterr(over="ignore")
        head, head_set = None, None
        for batch in batches:
            ida, idb = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            found, masks = [], []
            for lo, hi, data, offsets in utf8_slices(batch.column(3)):
                sets = shingle_sets(data, offsets, width)
                for i in range(lo, hi):
                    own = sets[i - lo]
                    if idb[i] is None:
                        head, head_set = ida[i], own
                    elif head == ida[i]:
                        inter, extra = compare(head_set, own)
                        link = inter > 0 and 10_000 * inter >= need_10k * (len(head_set) + len(own) - inter)
                        found.append((ida[i], idb[i], inter, len(extra), link))
                        masks.append(bitmap(extra))
            if found:
                a, b, inter, extra, link = zip(*found)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(masks) + 1, dtype=np.int32) * _MASK), pa.array(np.concatenate(masks)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(inter, pa.int64()), pa.array(extra, pa.int64()),
                    lists, pa.array(link, pa.bool_())], names=["id_a", "id_b", "inter", "extra", "mask", "link"])
        release_memory()

    return cut_lineage(flow.mapInArrow(check, "id_a long, id_b long, inter long, extra long, mask array<long>, link boolean"))


def _grouped(batches, n_keys: int):
    """(key columns' values, the rows) of every run of equal keys of sorted batches."""
    now, parts = None, []
    for batch in batches:
        keys = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[:n_keys]], axis=1)
        edges = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
        for lo, hi in zip(edges, [*edges[1:], len(keys)]):
            here = tuple(keys[lo].tolist())
            if now is not None and here != now:
                yield now, pa.Table.from_batches(parts).combine_chunks()
                parts = []
            now = here
            parts.append(batch.slice(lo, hi - lo))
    if parts:
        yield now, pa.Table.from_batches(parts).combine_chunks()


def _flat(column, width: int) -> np.ndarray:
    """A column of lists as a matrix, zeros for NULL."""
    rows = [np.zeros(width, np.int64) if x is None else np.array(x, np.int64) for x in column.to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, width), np.int64)


def _tile_pairs(bits: int, perms: int, least: int, need_10k: int):
    """For every tile the pairs of different components that may be linked,
    or, where these are many, its members that have any (``id_b`` NULL)."""
    lanes = 64 // bits
    words = -(-perms // lanes)
    one = np.uint64(sum(1 << (bits * k) for k in range(lanes)))

    def run(batches):
        for (key, low, high), t in _grouped(batches, 3):
            block, ids, comp, n = (t.column(c).to_numpy().astype(np.int64) for c in ("block", "id", "comp", "n"))
            known = np.array([x is not None for x in t.column("inter").to_pylist()])
            inter = np.array([x or 0 for x in t.column("inter").to_pylist()], np.int64)
            extra = np.array([x or 0 for x in t.column("extra").to_pylist()], np.int64)
            sig, mask = _flat(t.column("sig"), words).view(np.uint64), _flat(t.column("mask"), _MASK).view(np.uint64)
            hidden = extra - np.bitwise_count(mask).sum(axis=1)
            earlier = np.array(t.column("earlier").to_pylist(), np.int64).reshape(len(ids), -1)
            left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
            found_a, found_b = [], []
            for i in left.tolist():
                j = right[(right > i) if low == high else slice(None)]
                j = j[(comp[j] != comp[i]) & (np.minimum(n[j], n[i]) * 10_000 >= np.maximum(n[j], n[i]) * need_10k)]
                j = j[~(earlier[j] == earlier[i]).any(axis=1)]  # the first bucket that two members share speaks for the others
                d = sig[j] ^ sig[i]
                folded = d.copy()
                for k in range(1, bits):
                    folded |= d >> np.uint64(k)
                agree = perms - np.bitwise_count(folded & one).sum(axis=1)
                j = j[agree >= least]
                most = np.minimum(inter[j], inter[i]) + np.minimum(hidden[j], hidden[i]) + np.bitwise_count(mask[j] & mask[i]).sum(axis=1)
                j = j[(most * 10_000 >= (n[j] + n[i] - most) * need_10k) | ~(known[j] & known[i])]
                found_a.append(np.full(len(j), i))
                found_b.append(j)
            if not found_a:
                continue
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            if len(a) > _FEW * t.num_rows:
                a, b = np.union1d(a, b), None
            lows, highs = (ids[a], None) if b is None else (np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b]))
            m = len(a)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, key)), pa.array(np.full(m, low, np.int32)), pa.array(np.full(m, high, np.int32)), pa.array(lows),
                     pa.nulls(m, pa.int64()) if highs is None else pa.array(highs)], names=["key", "low", "high", "id_a", "id_b"])

    return run


def intersections(sets: list[np.ndarray], columns: int = 1 << 14) -> np.ndarray:
    """Sizes of the intersections of all pairs of sorted sets, as products of
    0/1 matrices over some of the values at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1  # the others are in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[code]
    owner, code = owner[keep], place[code[keep]]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(shared.sum()), columns):
        here = (code >= lo) & (code < lo + columns)
        m = np.zeros((len(sets), columns), np.float32)
        m[owner[here], code[here] - lo] = 1
        out += (m @ m.T).astype(np.int64)  # below 2^24, exact
    return out


def _tile_links(width: int, need_10k: int):
    """A spanning set of the links between different components of every tile."""
    def run(batches):
        np.seterr(over="ignore")
        for _, t in _grouped(batches, 3):
            sets = []
            for _, _, data, offsets in utf8_slices(t.column("text")):
                sets += shingle_sets(data, offsets, width)
            inter = intersections(sets)
            n = np.array([len(x) for x in sets])
            a, b = np.nonzero(np.triu(10_000 * inter >= need_10k * (n[:, None] + n[None, :] - inter), 1))
            ids, comp = t.column("id").to_numpy(), t.column("comp").to_numpy()
            root = {c: c for c in comp.tolist()}

            def top(c):
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            found = []
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = top(int(comp[x])), top(int(comp[y]))
                if p != q:
                    root[p] = q
                    found.append((min(int(ids[x]), int(ids[y])), max(int(ids[x]), int(ids[y]))))
            if found:
                one, two = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["id_a", "id_b"])
        release_memory()

    return run
