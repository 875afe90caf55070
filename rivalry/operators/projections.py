"""Projections and row filters (PRJ1-PRJ11). Narrow, codegen'd, pushed down
to the scan where they are filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the seven columns a match file must have
REQUIRED_COLUMNS = ("season", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR")

# fixed values: entity aliases applied to fixture lists
TEAM_ALIASES = {
    "Nottingham Forest": "Nott'm Forest",
    "Spurs": "Tottenham",
    "Man Utd": "Man United",
    "Sheffield Utd": "Sheffield United",
}


def select_required(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """PRJ1: keep ``columns`` in that order (missing -> AnalysisException)."""
    return df.select(*columns)


def replace_values(df: DataFrame, mapping: Mapping[str, str], subset: Sequence[str]) -> DataFrame:
    """PRJ2: map aliases in ``subset`` columns; unmapped values kept; an empty
    map is the identity. Small maps become a literal CASE expression; large
    ones should go through :func:`replace_values_by_table`."""
    if not mapping:
        return df
    out = df
    for c in subset:
        expr = F.col(c)
        for k, v in mapping.items():
            expr = F.when(F.col(c) == k, F.lit(v)).otherwise(expr)
        out = out.withColumn(c, expr)
    return out


def replace_values_by_table(df: DataFrame, aliases: DataFrame, subset: Sequence[str],
                            key: str = "alias", value: str = "name") -> DataFrame:
    """PRJ2 for large alias tables: left join per column + coalesce (AQE
    broadcasts the alias table when it is small)."""
    out = df
    for c in subset:
        a = aliases.select(F.col(key).alias(f"_k_{c}"), F.col(value).alias(f"_v_{c}"))
        out = out.join(a, out[c] == a[f"_k_{c}"], "left").withColumn(
            c, F.coalesce(F.col(f"_v_{c}"), F.col(c))
        ).drop(f"_k_{c}", f"_v_{c}")
    return out


def drop_if_exists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PRJ3: drop columns, ignore absent ones."""
    return df.drop(*[c for c in columns if c in df.columns])


def align_columns(df: DataFrame, fit_columns: Sequence[str], fill=0) -> DataFrame:
    """PRJ4: exactly ``fit_columns`` in fit order; missing ones as ``fill``."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in fit_columns])


def filter_unplayed(df: DataFrame, result: str = "result") -> DataFrame:
    """PRJ5: rows with no result yet."""
    return df.filter(F.col(result).isNull())


def fill_placeholders(df: DataFrame, goals: Sequence[str] = ("fthg", "ftag"), result: str = "ftr") -> DataFrame:
    """PRJ6: NULL goals -> 0, NULL result -> 'D'."""
    return df.na.fill({**{g: 0 for g in goals}, result: "D"})


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """PRJ7: drop rows with any NULL."""
    return df.na.drop("any", subset=subset)


def encode_result(c: Column) -> Column:
    """PRJ8: H -> 0, D -> 1, anything else (NULL too) -> 2."""
    return F.when(c == "H", 0).when(c == "D", 1).otherwise(2).cast("long")


def cast_categories(df: DataFrame, target: str | None = None) -> DataFrame:
    """PRJ9: mark string columns (except ``target``) as categorical. Spark has
    no category type: the columns stay strings and the list is recorded in
    column metadata (see :func:`categorical_columns`)."""
    out = df
    for f in df.schema.fields:
        if f.dataType.simpleString() == "string" and f.name != target:
            out = out.withMetadata(f.name, {**f.metadata, "categorical": True})
    return out


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if f.metadata.get("categorical")]
