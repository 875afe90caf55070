"""Property tests on the driver's tables and an oracle subset (sf0.001)."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from rivalry.plans.features import build_features
from rivalry.operators.teamgames import team_games_scan
from rivalry.sources import testdata as td

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_contract(spark):
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100
    df = E.entry(spark)
    assert df.count() > 0
    assert "home_league_position" in df.columns


def test_points_per_match_and_goal_balance(spark, sf_dir):
    tg = team_games_scan(td.matches(spark, sf_dir))
    per_match = tg.groupBy("match_id").agg(F.sum("pts").alias("p"))
    assert per_match.filter(~F.col("p").isin(2, 3)).count() == 0
    bal = tg.groupBy("season").agg(F.sum("gf").alias("gf"), F.sum("ga").alias("ga"))
    assert bal.filter(F.col("gf") != F.col("ga")).count() == 0
    # game numbers are dense 1..n per team
    dense = tg.groupBy("season", "team").agg(F.max("g").alias("mx"), F.count(F.lit(1)).alias("n"))
    assert dense.filter(F.col("mx") != F.col("n")).count() == 0


def test_asof_features_ignore_later_rows(spark, sf_dir):
    m = td.matches(spark, sf_dir)
    cut = "1997-06-01"
    keep = ["match_id", "htgs", "atgs", "htgc", "atgc", "htp", "atp", "hm1", "hm2", "hm3", "hm4", "hm5",
            "am1", "am2", "am3", "am4", "am5"]
    full = build_features(m, mode="asof").filter(F.col("match_date") < cut).select(*keep)
    part = build_features(m.filter(F.col("match_date") < cut), mode="asof").select(*keep)
    assert full.exceptAll(part).count() == 0 and part.exceptAll(full).count() == 0


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize(
    "name",
    ["w13_all_rounds", "features_asof", "rp6_standings", "w15_last_n_per_team", "dq8_validate", "dr6_drift_report",
     "u4_append_fixtures", "src6_latest_versioned", "t4_top3_per_row", "ev1_class_metrics"],
)
def test_oracle_subset(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf_dir)
    cols = sorted(sdf.columns)
    got = sorted(tuple(str(_norm(r[c])) for c in cols) for r in sdf.collect())
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    want = sorted(tuple(str(_norm(dict(zip(dcols, r))[c])) for c in cols) for r in cur.fetchall())
    assert got == want


def test_reference_column_names(spark, sf_dir):
    """The same features from a table laid out with the original's column
    names and text dates (parsed with F1)."""
    from rivalry.functions.scalars import parse_match_date
    from rivalry.operators.teamgames import MatchCols

    raw = td.raw_matches(spark, sf_dir).select(
        "season", F.col("match_id").alias("Id"), F.col("date_text").alias("Date"),
        F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        F.col("fthg").alias("FTHG"), F.col("ftag").alias("FTAG"), F.col("ftr").alias("FTR"),
    ).withColumn("Day", parse_match_date("Date"))
    cols = MatchCols(match_id="Id", order=("Day", "Id"), home="HomeTeam", away="AwayTeam", hg="FTHG", ag="FTAG",
                     result="FTR")
    got = build_features(raw, cols=cols, date_col="Day").withColumnRenamed("Id", "match_id").withColumnRenamed(
        "HomeTeam", "home_team").withColumnRenamed("AwayTeam", "away_team").withColumnRenamed(
        "FTR", "ftr").withColumnRenamed("Day", "match_date")
    want = build_features(td.matches(spark, sf_dir))
    cols_cmp = sorted(want.columns)
    assert sorted(got.columns) == cols_cmp
    assert got.select(*cols_cmp).exceptAll(want.select(*cols_cmp)).count() == 0
