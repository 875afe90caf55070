"""Feature attributions (XP1-XP6) on a long (row, feature, contribution)
table: every step is a grouped aggregate or a per-row projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import GeneralizedLinearRegressionModel, LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.operators.ordering import rank_average, top3_per_row


def linear_attribution(df: DataFrame, model: LinearRegressionModel | GeneralizedLinearRegressionModel, features: Sequence[str], *,
                       row: str) -> DataFrame:
    """XP1: per row and feature, coef * (x - mean(x)); exact additive
    attributions. For a linear model they sum to prediction - mean
    prediction; for a generalised linear one, on the scale of its link, to
    link(prediction) - :func:`attribution_base` (a multiplicative effect under
    a log link). Means are one aggregate; the long table is an explode."""
    coefs = list(model.coefficients.toArray())
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    parts = [
        F.struct(F.lit(c).alias("feature"), F.lit(i).cast("long").alias("pos"),
                 (F.lit(float(coefs[i])) * (F.col(c) - F.lit(float(means[c] or 0.0)))).alias("contribution"))
        for i, c in enumerate(features)
    ]
    return df.select(F.col(row).alias("row_id"), F.explode(F.array(*parts)).alias("a")).select("row_id", "a.*")


def attribution_base(df: DataFrame, model: LinearRegressionModel | GeneralizedLinearRegressionModel, features: Sequence[str]) -> float:
    """The linear predictor at the features' means, which the contributions
    of :func:`linear_attribution` start from."""
    means = df.agg(*[F.avg(c).alias(c) for c in features]).first()
    return float(model.intercept) + sum(float(k) * float(means[c] or 0.0) for k, c in zip(model.coefficients.toArray(), features))


def attribution_collapse(long: DataFrame, groups: Sequence[str], *, feature: str = "feature") -> DataFrame:
    """XP2: features whose name contains a group name are summed into one
    feature named after the group (first matching group wins); others stay.
    The position of a collapsed feature is its smallest member position."""
    name = F.col(feature)
    target = name
    for g in reversed(list(groups)):
        target = F.when(name.contains(g), F.lit(g)).otherwise(target)
    return long.withColumn(feature, target).groupBy("row_id", feature).agg(
        F.sum("contribution").alias("contribution"), F.min("pos").alias("pos")
    )


def attribution_top3(long: DataFrame) -> DataFrame:
    """XP3: names of the three largest contributions per row (T4)."""
    return top3_per_row(long)


def attribution_summary(long: DataFrame) -> DataFrame:
    """XP4: mean absolute contribution per feature with its rank (1 = the
    largest; ties share the mean of their ranks)."""
    return rank_average(long.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs")), "mean_abs")


def one_row_waterfall(long: DataFrame, row_id, *, base_value) -> DataFrame:
    """XP5: contributions of one row ordered by absolute size, largest first,
    plus a base row (``feature`` = '__base__'). ``row_id`` and ``base_value``
    may be scalar columns; :func:`rivalry.operators.report.choose_fixture`
    finds a fixture by its label."""
    one = long.filter(F.col("row_id") == F.lit(row_id)).select("feature", "contribution")
    base = long.sparkSession.range(1).select(
        F.lit("__base__").alias("feature"), F.lit(base_value).cast("double").alias("contribution")
    )
    out = one.unionByName(base)
    return out.withColumn("abs_contribution", F.abs("contribution")).orderBy(F.desc("abs_contribution"), "feature")


def residual_pairs(df: DataFrame, *, actual: str, predicted: str, jitter: float = 0.0, seed: int = 42) -> DataFrame:
    """XP6: (actual, predicted) pairs; optional uniform jitter for plotting."""
    out = df.select(F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))
    if jitter:
        out = out.withColumn("actual_jittered", F.col("actual") + (F.rand(seed) - 0.5) * 2 * jitter)
    return out
