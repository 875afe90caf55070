"""Joins (J1-J6). Plain equi-joins: Catalyst/AQE pick broadcast or
sort-merge from measured sizes; only dimensions with a fixed bound are
hinted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# dimension tables up to this many rows may be hinted for broadcast
DIMENSION_MAX_ROWS = 1_000_000


def merge_features(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Inner join of feature sets on ``keys`` where NULL keys match each
    other (pandas merge semantics). Include the row key (match id) in
    ``keys`` so duplicate match keys do not multiply."""
    out = frames[0]
    for f in frames[1:]:
        other = f.select(*keys, *[c for c in f.columns if c not in keys and c not in out.columns])
        a, b = out.alias("l"), other.alias("r")
        cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
        out = a.join(b, on=cond, how="inner").select(
            "l.*", *[F.col(f"r.{c}") for c in other.columns if c not in keys]
        )
    return out


def left_enrich(df: DataFrame, ranking: DataFrame, *, keys: Sequence[str], team_cols: Sequence[str],
                value: str, ranking_team: str = "team") -> DataFrame:
    """For each team column, left join ``ranking`` on keys + team and
    attach ``value`` as ``<team_col>_<value>``."""
    out = df
    for tc in team_cols:
        r = ranking.select(*keys, F.col(ranking_team).alias(tc), F.col(value).alias(f"{tc}_{value}"))
        out = out.join(r, on=[*keys, tc], how="left")
    return out


def fixture_join(features: DataFrame, fixtures: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Inner join of features and fixtures; an empty result raises
    (checked with ``isEmpty``, which stops at the first row)."""
    out = features.join(fixtures, on=list(on), how="inner")
    if out.isEmpty():
        raise ValueError("No matching fixtures found")
    return out


def dimension_lookup(df: DataFrame, dim: DataFrame, *, on: str, dim_rows: int | None = None) -> DataFrame:
    """Left join of a dimension (e.g. stadiums by location). The
    dimension is broadcast only under a row bound: ``dim_rows`` when the
    caller knows it, else a count of the dimension (one small job); above
    the bound it is a regular join."""
    rows = dim_rows if dim_rows is not None else dim.count()
    side = F.broadcast(dim) if rows <= DIMENSION_MAX_ROWS else dim
    return df.join(side, on=on, how="left")


def keyed_attach(rows: DataFrame, values: DataFrame, *, key: str, check: bool = True, mark: bool = False) -> DataFrame:
    """Attach ``values`` to ``rows`` by key (not by position). With
    ``check``, a key present on one side only raises. ``mark`` is for a caller
    that writes the result: rows of one side stay, marked in ``_unmatched``, and
    :func:`raise_unmatched` checks the written copy, so that one join does both."""
    if mark:
        sides = rows.withColumn("_row", F.lit(True)).join(values.withColumn("_value", F.lit(True)), on=key, how="full")
        return sides.withColumn("_unmatched", F.col("_row").isNull() | F.col("_value").isNull()).drop("_row", "_value")
    out = rows.join(values, on=key, how="inner")
    if check:
        # one aggregate of both sides' keys; a NULL key meets no other
        k = F.col(key)
        sides = rows.select(k, F.lit(0).alias("_side")).union(values.select(k, F.lit(1).alias("_side")))
        met = sides.groupBy(k).agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi"))
        if not met.filter(k.isNull() | (F.col("_lo") == F.col("_hi"))).isEmpty():
            raise ValueError("rows and values do not cover the same keys")
    return out


def raise_unmatched(written: DataFrame) -> DataFrame:
    """``written`` without the mark of :func:`keyed_attach`; raises if a row is marked."""
    if not written.filter("_unmatched").isEmpty():
        raise ValueError("rows and values do not cover the same keys")
    return written.drop("_unmatched")


def anti_split(df: DataFrame, sample: DataFrame, *, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``sample``."""
    return df.join(sample.select(key), on=key, how="left_anti")
