"""Distributed ordered scan: row numbers, running sums, lags and forward
fill inside (possibly huge, possibly skewed) key groups.

A plain ``Window.partitionBy(keys).orderBy(order)`` puts every row of a key
into one task, so a season or a team holding a third of the data becomes one
straggler. Here a key is cut into bounded slices of its order first:

1. ``repartitionByRange`` over ``keys + order`` gives every row the number of
   a contiguous slice of the global order. A hot key spreads over many slices
   (AQE may merge adjacent ones up to the advisory size; they stay
   contiguous).
2. Ordinary windows over ``(slice, keys)`` compute row numbers, sums, lags and
   fills. Such a window group is at most one slice.
3. The result is written to the shared folder, so that the carry and the data
   path read one fixed copy. Of each slice only the first and the last key can
   be continued from, or into, another slice: the last rows of their segments
   (at most two per slice) give, by one small window per key, what a segment
   inherits from earlier slices.
4. The carry has fewer rows than there are slices, so broadcasting it is
   bounded. Adding it is a narrow pass.

A caller that knows bounded slices of the order (``slices``) saves the range
shuffle, the sampling before it and, where its rows already lie by slice, the
shuffle of step 2. Any key of such a slice can go on in the next one: the carry
has one row per key and slice, and is broadcast only where it is counted small.

All of it is built-in expressions: values keep their types, NULLs and NaNs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.session import cut_lineage

# a carry of given slices is broadcast up to this many rows (counted)
CARRY_BROADCAST_MAX = 1_000_000


def _lag_name(col: str, k: int) -> str:
    return f"{col}_lag{k}"


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    row_number: str | None = "rn",
    sums: Mapping[str, str] | None = None,
    lags: Mapping[str, int] | None = None,
    ffill: Mapping[str, str] | None = None,
    num_partitions: int | None = None,
    keep: Sequence[str] | None = None,
    slices: str | None = None,
) -> DataFrame:
    """Scan ``df`` in ``order`` (ascending, unique within a key) per ``keys``.

    Adds ``row_number`` (1-based), ``sums`` (out name -> input column;
    inclusive running sum in the type of Spark's ``sum``, NULL counts as 0),
    ``lags`` (input column -> depth L; adds ``<col>_lag1..L``, NULL before the
    first row) and ``ffill`` (out name -> input column; last non-NULL value up
    to and including the row). A NULL key raises when the scan runs. ``keep``
    names the columns of ``df`` that are written and returned (default all; the
    keys and the columns of ``lags`` always are). ``slices`` names a column of
    slice numbers that never fall along the order of a key; a slice should hold
    no more rows than a task sorts with ease. The column is not returned.
    """
    keys, order = list(keys), list(order)
    sums = dict(sums or {})
    lags = dict(lags or {})
    ffill = dict(ffill or {})
    columns = [c for c in df.columns if c != slices]
    types = {f.name: f.dataType for f in df.schema.fields}

    if slices:
        ranged, pid = df, F.col(slices)
    else:
        ranged = df.repartitionByRange(num_partitions, *keys, *order) if num_partitions else df.repartitionByRange(*keys, *order)
        pid = F.spark_partition_id()
    def no_null(c):
        return F.raise_error(F.lit(f"ordered_scan: NULL in key column {c}"))

    checked = [F.coalesce(F.col(c), no_null(c).cast(types[c])).alias(c) if c in keys else F.col(c) for c in columns]
    if slices:
        # a filter leaves the keys as they are, and so the way their rows lie
        checked = columns
        for c in keys:
            ranged = ranged.filter(F.when(F.col(c).isNull(), no_null(c).cast("boolean")).otherwise(True))
    sliced = ranged.select(*checked, pid.alias("_pid"))

    if keep is not None:
        columns = [c for c in columns if c in {*keep, *keys, *lags}]
    here = Window.partitionBy("_pid", *keys).orderBy(*order)
    so_far = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = [F.row_number().over(here).cast("long").alias("_lrn"), F.lead(F.lit(1)).over(here).isNull().alias("_tail")]
    local += [F.coalesce(F.sum(src).over(so_far), F.lit(0)).alias(f"_ls_{o}") for o, src in sums.items()]
    for c, depth in lags.items():
        local += [F.lag(c, k).over(here).alias(f"_ll_{c}_{k}") for k in range(1, depth + 1)]
    local += [F.last(src, ignorenulls=True).over(so_far).alias(f"_lf_{o}") for o, src in ffill.items()]
    # read by the carry and by the data path: one fixed, reliable copy
    scanned = cut_lineage(sliced.select(*columns, "_pid", *local))

    # the last row of a segment holds all that a later segment of its key needs
    tails = scanned.filter("_tail")
    if keys and not slices:
        ends = tails.groupBy("_pid").agg(F.min(F.struct(*keys)).alias("_lo"), F.max(F.struct(*keys)).alias("_hi"))
        # one row per slice
        tails = tails.join(F.broadcast(ends), "_pid").filter((F.struct(*keys) == F.col("_lo")) | (F.struct(*keys) == F.col("_hi")))
    by_slice = Window.partitionBy(*keys).orderBy("_pid")
    before = by_slice.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = ["_pid", *keys, F.sum("_lrn").over(before).alias("_pcn")]
    carry_cols += [F.sum(f"_ls_{o}").over(before).alias(f"_ps_{o}") for o in sums]
    for c, depth in lags.items():
        # oldest to newest, as many as the segment has
        last = F.array(*[F.col(f"_ll_{c}_{k}") for k in range(depth - 1, 0, -1)], F.col(c))
        own = F.slice(last, F.greatest(F.lit(depth) - F.col("_lrn") + 1, F.lit(1)).cast("int"), depth)
        near = F.flatten(F.collect_list(own).over(by_slice.rowsBetween(-depth, -1)))
        carry_cols.append(near.alias(f"_pt_{c}"))
    carry_cols += [F.last(f"_lf_{o}", ignorenulls=True).over(before).alias(f"_pf_{o}") for o in ffill]
    carry = tails.select(*carry_cols).filter(F.col("_pcn").isNotNull())

    # at most one carry row per slice: a bounded broadcast
    small = True
    if slices:
        carry = cut_lineage(carry)
        small = carry.count() <= CARRY_BROADCAST_MAX
    joined = scanned.join(F.broadcast(carry) if small else carry, on=["_pid", *keys], how="left")
    result = [F.col(c) for c in columns]
    if row_number:
        result.append((F.col("_lrn") + F.coalesce("_pcn", F.lit(0))).cast("long").alias(row_number))
    for o, src in sums.items():
        total = F.col(f"_ls_{o}") + F.coalesce(f"_ps_{o}", F.lit(0))
        if not isinstance(types[src], T.DecimalType):
            total = total.cast("long" if isinstance(types[src], T.IntegralType) else "double")
        result.append(total.alias(o))
    for c, depth in lags.items():
        for k in range(1, depth + 1):
            from_prev = F.try_element_at(F.col(f"_pt_{c}"), (F.col("_lrn") - F.lit(k + 1)).cast("int"))
            result.append(
                F.when(F.col("_lrn") > k, F.col(f"_ll_{c}_{k}")).otherwise(from_prev).alias(_lag_name(c, k))
            )
    for o in ffill:
        result.append(F.coalesce(F.col(f"_lf_{o}"), F.col(f"_pf_{o}")).alias(o))
    return joined.select(*result)
