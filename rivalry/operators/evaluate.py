"""Model evaluation (EV1, EV2) and the run log (EV3, F18)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions.scalars import merge_maps
from rivalry.operators.scan import ordered_scan


def class_metrics(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    """EV1: accuracy, weighted F1 and multiclass MCC in one row, all derived
    from the (actual, predicted) count table (classes^2 rows).

    MCC = (c*s - sum p_k t_k) / sqrt((s^2 - sum p_k^2)(s^2 - sum t_k^2)),
    0 when the denominator is 0; a class's F1 is 0 when undefined."""
    cells = df.groupBy(F.col(actual).alias("a"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    t = cells.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("t"))
    pr = cells.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("pp"))
    tp = cells.filter(F.col("a") == F.col("p")).select(F.col("a").alias("k"), F.col("n").alias("tp"))
    per = t.join(pr, "k", "full").join(tp, "k", "left").select(
        "k", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("t", "pp", "tp")]
    )
    f1 = F.when(F.col("t") + F.col("pp") > 0, 2 * F.col("tp") / (F.col("t") + F.col("pp"))).otherwise(0.0)
    agg = per.agg(
        F.sum("t").alias("s"), F.sum("tp").alias("c"), F.sum(F.col("t") * f1).alias("wf1"),
        F.sum(F.col("pp") * F.col("t")).alias("pt"), F.sum(F.col("pp") ** 2).alias("pp2"),
        F.sum(F.col("t") ** 2).alias("tt2"),
    )
    den = F.sqrt((F.col("s") ** 2 - F.col("pp2")) * (F.col("s") ** 2 - F.col("tt2")))
    return agg.select(
        F.col("s").cast("long").alias("n"),
        (F.col("c") / F.col("s")).alias("accuracy"),
        (F.col("wf1") / F.col("s")).alias("f1_weighted"),
        F.when(den > 0, (F.col("c") * F.col("s") - F.col("pt")) / den).otherwise(0.0).alias("mcc"),
    )


def exact_median(df: DataFrame, value) -> DataFrame:
    """Exact median of ``value`` without gathering the values in one task:
    counts per distinct value, a distributed prefix sum over the sorted
    values (:func:`ordered_scan`), then the value(s) holding the middle
    rank(s). One row ``median`` (NULL for no rows)."""
    v = value if not isinstance(value, str) else F.col(value)
    counts = df.select(v.cast("double").alias("v")).filter(F.col("v").isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("c")
    )
    n = counts.agg(F.sum("c")).scalar()
    scanned = ordered_scan(counts, [], ["v"], row_number=None, sums={"cum": "c"})
    # middle ranks as columns first: aggregate arguments stay plain columns
    ranked = scanned.withColumn("_lo", F.floor((n + 1) / 2)).withColumn("_hi", F.floor(n / 2) + 1)
    holds = lambda k: (F.col("cum") - F.col("c") < F.col(k)) & (F.col(k) <= F.col("cum"))
    return ranked.agg(
        ((F.max(F.when(holds("_lo"), F.col("v"))) + F.max(F.when(holds("_hi"), F.col("v")))) / 2).alias("median")
    )


def regression_metrics(df: DataFrame, *, actual: str, predicted: str, exact_median_ae: bool = True) -> DataFrame:
    """EV2: R^2, median absolute error and mean absolute error in one row.
    The median is exact and distributed (:func:`exact_median`);
    ``exact_median_ae=False`` uses the approx_percentile sketch instead."""
    err = F.abs(F.col(actual) - F.col(predicted))
    stats = df.agg(
        F.sum((F.col(actual) - F.col(predicted)) ** 2).alias("ss_res"),
        # centred: the difference of two sums of squares has no digits left for values far from zero
        (F.var_pop(actual) * F.count(actual)).alias("ss_tot"),
        F.avg(err).alias("mean_ae"),
        *([] if exact_median_ae else [F.percentile_approx(err, 0.5, 10000).cast("double").alias("median_ae")]),
    )
    if exact_median_ae:
        stats = stats.select("*", exact_median(df, err).select(F.col("median").alias("m")).scalar().alias("median_ae"))
    return stats.select(
        F.when(F.col("ss_tot") > 0, 1 - F.col("ss_res") / F.col("ss_tot")).otherwise(F.lit(None).cast("double")).alias("r2"),
        "median_ae", "mean_ae",
    )


def run_log(runs: DataFrame, *, run_id: str, params: Sequence[str], metrics: Sequence[str],
            tags: Sequence[str] = ()) -> DataFrame:
    """EV3: the append-only run table: one row per run with ``params``,
    ``metrics`` and ``tags`` maps (string values) and their merge ``all``
    (later maps win, run id added)."""
    def as_map(cols):
        if not cols:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[x for c in cols for x in (F.lit(c), F.col(c).cast("string"))])

    out = runs.select(
        F.col(run_id).alias("run_id"), as_map(params).alias("params"), as_map(metrics).alias("metrics"),
        as_map(tags).alias("tags"),
    )
    return out.withColumn(
        "all", merge_maps("params", "metrics", "tags", F.create_map(F.lit("run_id"), F.col("run_id").cast("string")))
    )


def maps_to_columns(df: DataFrame, map_col: str, keys: Sequence[str] | None = None, *, id_col: str = "run_id") -> DataFrame:
    """one column per map key, missing keys NULL. With ``keys`` given
    this is a projection; otherwise the keys are found with one distinct
    pass over the map keys (metadata-sized) and pivoted."""
    if keys is not None:
        return df.select(id_col, *[F.col(map_col).getItem(k).alias(k) for k in keys])
    long = df.select(id_col, F.explode(map_col).alias("k", "v"))
    return long.groupBy(id_col).pivot("k").agg(F.first("v"))
