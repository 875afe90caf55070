"""Mixing sources to target weights by Pareto order sampling.

Targets: sources share the total size by weight, no source above
``max_copies`` times its own size; the excess goes to the others by weight. A
source with target t and size S gives floor(t / S) certain whole copies of
every document; the rest, R = t - floor(t / S) * S, is a sample in which each
document has inclusion probability p = R / S.

Pareto order sampling ranks documents by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)), with u drawn from a hash of the id, and takes the
smallest up to the sample's fixed size, here measured in words. The last
document rarely fits exactly, so the ranking goes on behind it with the
documents that still fit, for a few rounds, and ends with the one document, if
any, that brings the sum nearest to the target.

A source's decision is a handful of cut points in its ranking. They are found
from sums per (source, rank bucket): 4096 buckets, then 4096 within the bucket
of the cut, then the few documents of that one in order. So a source with a
third of all rows is never gathered, and the cut points (a few rows per
source) are all that joins back to the documents.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivalry.llm.common import WORD_SPACE, release_memory, utf8_slices
from rivalry.operators.scan import ordered_scan
from rivalry.session import cut_lineage

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(WORD_SPACE)] = True
_BUCKETS = 4096


def word_count() -> Column:
    """Arrow UDF: the number of maximal runs without x20, x09-x0D; 0 for NULL."""

    @F.arrow_udf("long")
    def count(text: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in utf8_slices(text):
            start = ~_SPACE[data]
            follows = np.zeros(len(data), dtype=bool)
            follows[1:] = start[:-1]
            follows[offsets[:-1][offsets[:-1] < len(data)]] = False
            total = np.concatenate([[0], np.cumsum(start & ~follows)])
            out.append(total[offsets[1:]] - total[offsets[:-1]])
        counts = pa.array(np.concatenate(out) if out else np.empty(0, np.int64), pa.int64())
        release_memory()
        return counts

    return count


def targets(sizes: DataFrame, *, weights: Sequence[float] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """``sizes`` has one row per source: ``source, source_size``. Adds
    ``target``. Sources in code-point order, NULL last, take ``weights`` in
    turn."""
    ranked = ordered_scan(
        sizes.select(F.col("source").isNull().cast("int").alias("last"), F.coalesce("source", F.lit("")).alias("name"), "source", "source_size"),
        [], ["last", "name"], row_number="rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = cut_lineage(ranked.select("source", "source_size", w.alias("weight")))
    cap = F.col("source_size") * max_copies
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0  # target = min(cap, level * weight); the level only rises, each round caps at least one source more
    while total:
        r = ranked.filter(cap > level * F.col("weight")).agg(F.sum("weight").alias("w"), F.sum(cap).alias("c")).first()
        if not r["w"]:
            break
        rising = (total - (total * max_copies - r["c"])) / r["w"]
        if rising <= level:
            break
        level = rising
    return ranked.select("source", "source_size", F.least(cap.cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def _uniform(id_col: Column, text: Column, seed: int) -> Column:
    h = F.xxhash64(F.lit(seed), id_col, F.when(id_col.isNull(), text))
    return (F.shiftrightunsigned(h, 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def _place(u: Column, p: Column) -> Column:
    """q / (1 + q) of the Pareto rank q: the same order, between 0 and 1."""
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, q / (1 + q)).otherwise(F.lit(1.0))


def _bucket(v: Column) -> Column:
    return F.least(F.floor(v * _BUCKETS * _BUCKETS), F.lit(_BUCKETS * _BUCKETS - 1)).cast("long")


def _first_over(sums: DataFrame, bucket: str) -> DataFrame:
    """Per source all words (``able``), the bucket in which their running sum
    first passes ``left``, and ``left`` at its beginning (both NULL if it never
    does). ``sums`` has ``sid, left, words`` and the bucket, at most
    ``_BUCKETS`` rows per source."""
    run = sums.withColumn("run", F.sum("words").over(Window.partitionBy("sid").orderBy(bucket)))
    over = F.struct(F.col(bucket).alias("at"), (F.col("left") - (F.col("run") - F.col("words"))).alias("left"))
    first = run.groupBy("sid").agg(F.sum("words").alias("able"), F.min(F.when(F.col("run") > F.col("left"), over)).alias("x"))
    return first.select("sid", "able", F.col("x.at").alias(bucket), F.col("x.left").alias("left"))


def cuts(ranked: DataFrame, need: DataFrame, rounds: int) -> DataFrame:
    """Cut points per source: ``sid, round, max_size, b, v, id``. A document
    goes to round k if its place is behind the cut of round k - 1 and not
    behind that of round k, and its size is at most ``max_size``.

    ``ranked`` has ``sid, id, size, v, b``; ``need`` has ``sid, left``."""
    found = []
    open_ = cut_lineage(need.select("sid", "left", F.lit(-1).cast("long").alias("b0"), F.lit(-1.0).alias("v0"), F.lit(0).cast("long").alias("id0")))
    for k in range(rounds):
        # behind the last cut and no larger than what is left
        behind = (F.col("b") > F.col("b0")) | ((F.col("b") == F.col("b0")) & (F.struct("v", "id") > F.struct("v0", "id0")))
        able = ranked.join(open_, "sid").filter(behind & (F.col("size") <= F.col("left"))).select("sid", "id", "size", "v", "b", "left")
        b1 = F.shiftright("b", 12)
        # one row per source; one whose able documents all fit has no cut: it takes them all
        at1 = cut_lineage(_first_over(able.groupBy("sid", "left", b1.alias("b1")).agg(F.sum("size").alias("words")), "b1"))
        inner = cut_lineage(able.drop("left").withColumn("b1", b1).join(at1.drop("able"), ["sid", "b1"]))
        at2 = _first_over(inner.groupBy("sid", "left", "b").agg(F.sum("size").alias("words")), "b")
        last = inner.select("sid", "id", "size", "v", "b").join(at2.drop("able"), ["sid", "b"])
        w = Window.partitionBy("sid").orderBy("v", "id")  # equal ranks and ids go together
        fits = F.col("run") <= F.col("left")
        cut = last.withColumn("run", F.sum("size").over(w)).groupBy("sid").agg(
            F.max("b").alias("b"), F.max(F.when(fits, F.struct("v", "id"))).alias("e"),
            (F.max("left") - F.coalesce(F.max(F.when(fits, F.col("run"))), F.lit(0))).alias("rest"),
        ).select("sid", "b", F.coalesce("e.v", F.lit(-1.0)).alias("v"), F.col("e.id").alias("id"), "rest")
        done = cut_lineage(open_.join(cut, "sid", "left").join(at1.select("sid", "able"), "sid", "left").select(
            "sid", F.lit(k).alias("round"), F.col("left").alias("max_size"), "b0", "v0", "id0",
            F.coalesce("b", F.lit(_BUCKETS * _BUCKETS)).cast("long").alias("b"), F.coalesce("v", F.lit(2.0)).alias("v"),
            F.coalesce("id", F.lit(-(1 << 63))).alias("id"),
            F.coalesce("rest", F.col("left") - F.coalesce("able", F.lit(0))).alias("rest")))
        found.append(done.drop("rest"))
        open_ = done.filter("rest > 0").select("sid", F.col("rest").alias("left"), F.col("b").alias("b0"), F.col("v").alias("v0"), F.col("id").alias("id0"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    # of the documents left out, the one whose size is nearest to what is still missing
    free = ranked.join(open_.select("sid", "left"), "sid").join(packed(out), "sid", "left").filter(
        ~F.coalesce(in_cuts(F.col("size"), F.col("b"), F.col("v"), F.col("id")), F.lit(False)))
    near = free.groupBy("sid").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("gap"), "v", "id", "size", "b", "left")).alias("x"))
    pick = near.filter("x.gap < x.left").select(
        "sid", F.lit(rounds).alias("round"), F.col("x.size").alias("max_size"), F.col("x.b").alias("b0"), F.col("x.v").alias("v0"),
        (F.col("x.id") - 1).alias("id0"), F.col("x.b").alias("b"), F.col("x.v").alias("v"), F.col("x.id").alias("id"))
    return out.union(pick)


def packed(points: DataFrame) -> DataFrame:
    """The few cut points of a source as one list."""
    return points.groupBy("sid").agg(F.collect_list(F.struct("max_size", "b0", "v0", "id0", "b", "v", "id")).alias("cuts"))


def in_cuts(size: Column, b: Column, v: Column, doc_id: Column) -> Column:
    def behind(b0, v0, id0):
        return (b > b0) | ((b == b0) & (F.struct(v, doc_id) > F.struct(v0, id0)))

    return F.exists("cuts", lambda c: (size <= c["max_size"]) & behind(c["b0"], c["v0"], c["id0"]) & ~behind(c["b"], c["v"], c["id"]))


def mix(
    df: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[float] = (1, 2, 3), max_copies: int = 3, seed: int = 11, rounds: int = 4, keep: Sequence[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """The columns ``keep`` (all if None) of every row, with ``size`` (words),
    ``source_size``, ``target`` (its source's), ``copies`` (how often the mix
    takes it, 0 to ``max_copies``) and ``taken`` (``copies * size``).

    A NULL or blank text has size 0. NULL is a source of its own. A source
    without words has target 0. Draws come from the id, so reruns agree; rows
    that repeat an id within a source and have equal sizes are taken together;
    rows with a NULL id draw from their text. Wordless documents get the whole
    copies of their source, and an empty table gives no rows. Columns of ``df``
    with the names of the added ones are replaced (``prefix`` goes before those).
    """
    added = [prefix + c for c in ("size", "source_size", "target", "copies", "taken")]
    keep = [c for c in (df.columns if keep is None else keep) if c not in added]
    source, doc_id, text = F.col(source_col).cast("string"), F.col(id_col).cast("long"), F.col(text_col).cast("string")
    sized = df.select(
        F.struct(*keep).alias("row"), doc_id.alias("id"), source.alias("source"), word_count()(text).alias("size"), _uniform(doc_id, text, seed).alias("u"))
    narrow = cut_lineage(sized.select(F.coalesce("id", F.xxhash64("u")).alias("id"), "source", "size", "u"))
    goal = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, max_copies=max_copies)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = goal.withColumn("whole", whole).withColumn("over", F.col("target") - F.col("whole") * F.col("source_size"))
    goal = goal.withColumn("p", F.when(F.col("source_size") > 0, F.col("over") / F.col("source_size")).otherwise(F.lit(0.0)))
    goal = cut_lineage(goal.withColumn("sid", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))))
    ranked = narrow.withColumn("sid", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).join(goal.select("sid", "p"), "sid").filter("p > 0 and size > 0")
    ranked = cut_lineage(ranked.select("sid", "id", "size", _place(F.col("u"), F.col("p")).alias("v")).withColumn("b", _bucket(F.col("v"))))
    points = cuts(ranked, goal.filter("p > 0").select("sid", F.col("over").alias("left")), rounds)
    rules = cut_lineage(goal.join(packed(points), "sid", "left").select("sid", "source_size", "target", "whole", "p", "cuts"))
    out = sized.withColumn("sid", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))).join(rules, "sid")
    out = out.withColumn("my_v", _place(F.col("u"), F.col("p"))).withColumn("my_b", _bucket(F.col("my_v"))).withColumn(
        "my_id", F.coalesce("id", F.xxhash64("u")))

    taken = in_cuts(F.col("size"), F.col("my_b"), F.col("my_v"), F.col("my_id"))
    extra = F.when((F.col("size") > 0) & (F.col("p") > 0) & F.coalesce(taken, F.lit(False)), 1).otherwise(0)
    out = out.withColumn("copies", (F.col("whole") + extra).cast("int"))
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep],
        *[F.col(c).alias(prefix + c) for c in ("size", "source_size", "target", "copies")],
        (F.col("copies") * F.col("size")).cast("long").alias(f"{prefix}taken"))
