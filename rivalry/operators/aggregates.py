"""Aggregations (A1-A5, A8, A9), all with map-side partial aggregation: a hot
key is pre-combined in every task before the shuffle. Those that keep a whole
row per key (``min_by`` of a struct) are planned as sort aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_value(df: DataFrame, value: str, *, counted: str) -> DataFrame:
    """A1: rows per ``value``, counting non-NULL ``counted``; NULL values
    dropped."""
    return df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(counted).alias("n"))


def best_per_group(df: DataFrame, keys: Sequence[str], metric: str, tie: str, *, largest: bool = False) -> DataFrame:
    """A2: per group the row with the smallest (or largest) numeric
    ``metric``, ties to the smallest ``tie`` (of any ordered type); rows
    without a metric come last. ``min_by`` over a struct: partial
    aggregation, so a huge group never sits whole in one task."""
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    key = -F.col(metric) if largest else F.col(metric)
    pick = F.min_by(row, F.struct(key.isNull(), key, F.col(tie)))
    return df.groupBy(*keys).agg(pick.alias("_b")).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in others])


def pivot_metric(df: DataFrame, row: str, column: str, values: Sequence[str], metric: str) -> DataFrame:
    """A3: ``row`` x ``column`` -> ``metric`` (first value per cell); the
    pivot values are given, so no extra job finds them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(metric))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """A4: frequency of each non-NULL value."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """A5: distinct values including NULL."""
    return df.select(column).distinct()


def confusion_matrix(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts per (actual, predicted) over the union of labels, zero
    cells included. The label grid comes from the set of classes (bounded by
    the number of classes, not by rows)."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    labels = counts.select(F.col("actual").alias("l")).union(counts.select(F.col("predicted").alias("l")))
    label_set = labels.agg(F.array_sort(F.collect_set("l")).alias("ls"))
    grid = label_set.select(F.explode("ls").alias("actual"), "ls").select("actual", F.explode("ls").alias("predicted"))
    return grid.join(counts, ["actual", "predicted"], "left").select(
        "actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def max_len(df: DataFrame, column: str) -> DataFrame:
    """Longest string length in a column."""
    return df.agg(F.max(F.length(column)).cast("long").alias("max_len"))
