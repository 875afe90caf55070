"""Set operations and refresh (U1-U5) and keep-first dedupe."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions.scalars import fixture_date_text
from rivalry.operators.projections import TEAM_ALIASES, drop_nulls, fill_placeholders, replace_values


def union_by_name(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; columns missing in a frame are NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full-row dedupe (hash aggregate with map-side combine)."""
    return df.distinct()


def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``, the first by ``order``. Written as an
    aggregation (``min_by`` of the row), so duplicates are combined map-side
    and a key with many copies never lands whole in one task, unlike a
    ``row_number`` window."""
    others = [c for c in df.columns if c not in keys]
    ordkey = F.struct(*[F.col(c) for c in order])
    best = F.min_by(F.struct(*[F.col(c) for c in others]), ordkey).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others]).select(
        *df.columns
    )


def refresh_partition(
    full: DataFrame, new: DataFrame | None, *, season: str, season_col: str = "season"
) -> DataFrame:
    """Replace one season: drop its rows from ``full``, add ``new``
    without its repeated rows, drop rows with NULLs. Only ``new`` is shuffled:
    the untouched seasons of ``full`` were deduplicated when they came in.
    ``new`` None (source missing) returns ``full`` unchanged. On storage, write
    the result with ``partitionOverwriteMode=dynamic`` partitioned by season so
    only the refreshed season's files are replaced."""
    if new is None:
        return full
    kept = full.filter(F.col(season_col) != F.lit(season))
    return drop_nulls(union_by_name(kept, distinct_rows(new.select(*full.columns))))


def append_fixtures(
    full: DataFrame,
    fixtures: DataFrame,
    *,
    seq_col: str,
    date_col: str = "date_text",
    home: str = "home_team",
    away: str = "away_team",
    season_col: str = "season",
    aliases: Mapping[str, str] = TEAM_ALIASES,
    goals: Sequence[str] = ("fthg", "ftag"),
    result: str = "ftr",
) -> DataFrame:
    """U4: append unplayed fixtures (date cut to its first 10 characters) to
    the results, map team aliases on both sides, NULL goals -> 0 and result
    -> 'D', then keep the first row per (season, date, home, away) in
    ``seq_col`` order (results come before fixtures)."""
    fx = fixtures.filter(F.col("result").isNull()).select(
        F.col(season_col), fixture_date_text(F.col(date_col)).alias(date_col), F.col(home), F.col(away),
        F.col(seq_col),
    ).withColumn("_src", F.lit(1))
    base = full.withColumn("_src", F.lit(0))
    both = union_by_name(base, fx)
    both = replace_values(both, aliases, [home, away])
    both = fill_placeholders(both, goals=goals, result=result)
    out = dedupe_keep_first(both, [season_col, date_col, home, away], ["_src", seq_col])
    return out.drop("_src")


def home_away_stack(df: DataFrame, *, home: str, away: str, home_value: str, away_value: str,
                    keys: Sequence[str] = ()) -> DataFrame:
    """(home, home value) and (away, away value) stacked to (team, value)."""
    return df.select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.col(home).alias("team"), F.col(home_value).alias("value"), F.lit("H").alias("side")),
                F.struct(F.col(away).alias("team"), F.col(away_value).alias("value"), F.lit("A").alias("side")),
            )
        ).alias("_s"),
    ).select(*keys, "_s.*")
