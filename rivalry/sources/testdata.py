"""Match-shaped views derived from the driver's parquet tables.

The test tables are TPC-H-like; these views reshape them into the inputs the
operators expect (matches, text-dated raw results, fixture lists, model-run
logs, drift samples, versioned artifact paths, attributions). The same
definitions exist as SQL in ``rivalry.oracle_views`` for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def season_of(d: Column) -> Column:
    y = F.year(d)
    return F.when(F.month(d) < 8, F.concat((y - 1).cast("string"), F.lit("-"), _two(y % 100))).otherwise(
        F.concat(y.cast("string"), F.lit("-"), _two((y + 1) % 100))
    )


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    hg = F.floor(F.col("o_orderkey") / 7).cast("bigint") % 5
    ag = F.floor(F.col("o_totalprice")).cast("bigint") % 4
    return o.select(
        F.col("o_orderkey").alias("match_id"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        season_of(F.col("o_orderdate")).alias("season"),
        F.concat(F.lit("T"), _two(F.col("o_custkey") % 20)).alias("home_team"),
        F.concat(F.lit("T"), _two((F.col("o_custkey") % 20 + 1 + F.col("o_orderkey") % 19) % 20)).alias(
            "away_team"
        ),
        hg.alias("fthg"),
        ag.alias("ftag"),
        F.when(hg > ag, "H").when(hg == ag, "D").otherwise("A").alias("ftr"),
    )


def raw_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    d = F.col("match_date")
    year_text = F.when(F.year(d) < 1998, _two(F.year(d) % 100)).otherwise(F.year(d).cast("string"))
    return m.select(
        "match_id", "season", "home_team", "away_team", "fthg", "ftag", "ftr",
        F.concat(_two(F.dayofmonth(d)), F.lit("/"), _two(F.month(d)), F.lit("/"), year_text).alias("date_text"),
    )


def fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    d = F.col("match_date")
    mid = F.col("match_id")
    return m.select(
        mid.alias("match_number"),
        (mid % 38 + 1).alias("round_number"),
        F.concat(
            _two(F.dayofmonth(d)), F.lit("/"), _two(F.month(d)), F.lit("/"), F.year(d).cast("string"),
            F.lit(" "), _two(mid % 14 + 8), F.lit(":"), F.when(mid % 2 == 0, "00").otherwise("30"),
        ).alias("date_text"),
        F.concat(F.lit("NATION_"), (mid % 25).cast("string")).alias("location"),
        "home_team",
        "away_team",
        F.when(mid % 17 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("fthg").cast("string"), F.lit(" - "), F.col("ftag").cast("string")))
        .alias("result"),
        "season",
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(
        F.col("n_name").alias("location"), (F.col("n_nationkey") * 1234 + 15000).cast("long").alias("capacity")
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matches(spark, sf_dir)
    mid = F.col("match_id")
    actual = F.when(F.col("ftr") == "H", 0).when(F.col("ftr") == "D", 1).otherwise(2)
    return m.select(
        "match_id", "season", "fthg", "ftag",
        ((F.col("fthg") * 2 + mid % 3 - 1) / F.lit(2.0)).alias("home_raw"),
        ((F.col("ftag") * 2 + mid % 2) / F.lit(2.0)).alias("away_raw"),
        actual.alias("actual_class"),
        F.when(mid % 10 < 6, actual).otherwise((mid % 3).cast("int")).alias("predicted_class"),
    )


def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("run_id"),
        F.col("ts").cast("date").alias("run_date"),
        F.when(F.col("user_id") % 3 == 0, "home").when(F.col("user_id") % 3 == 1, "away").otherwise("result")
        .alias("model_type"),
        F.col("value").alias("mean_ae"),
        (F.col("value") / 100).alias("mcc"),
        (F.col("value") / 90).alias("accuracy"),
        (F.col("value") / 95).alias("f1"),
    )


def drift_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.when(F.col("l_shipdate") < F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), "reference")
        .otherwise("current")
        .alias("part"),
        F.col("l_quantity").alias("num_col"),
        F.col("l_returnflag").alias("cat_col"),
        F.when(F.col("l_linestatus") == "F", 1).otherwise(0).alias("flag_col"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    d = F.col("o_orderdate")
    stamp = F.when(k % 50 == 0, F.lit("latest")).otherwise(
        F.concat(F.year(d).cast("string"), _two(F.month(d)), _two(F.dayofmonth(d)))
    )
    return o.select(
        k.alias("id"),
        F.concat(F.lit("models/classifier_v"), (k % 3).cast("string"), F.lit("_"), stamp, F.lit(".bin")).alias(
            "path"
        ),
    )


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", F.posexplode("embedding").alias("pos", "v")).select(
        F.col("vec_id").alias("row_id"),
        F.concat(F.lit("f"), F.col("pos").cast("string")).alias("feature"),
        "pos",
        F.col("v").cast("double").alias("contribution"),
    )
