"""Plan-shape guards: order-dependent match operators must not funnel data
through a single partition (a whole season or team in one task)."""

import pytest

import __spark_entry__ as E

CORE = ["w1_match_week", "w2_team_games", "w13_all_rounds", "features_asof", "w15_last_n_per_team",
        "rp6_standings", "u4_append_fixtures", "w16_dedupe_keep_first", "t2_trim_multiple"]


@pytest.mark.parametrize("name", CORE)
def test_no_single_partition_exchange(spark, sf_dir, name):
    df = E.queries()[name](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_match_view_scan_reads_pruned_columns(spark, sf_dir):
    df = E.queries()["prj8_encode_result"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the orders scan is there and reads only the columns the view needs
    assert "o_orderkey" in plan
    assert "o_orderpriority" not in plan and "o_orderstatus" not in plan


def test_drift_report_scans_do_not_grow_with_columns(spark, sf_dir):
    from pyspark.sql import functions as F

    from rivalry.operators.drift import drift_report
    from rivalry.sources import testdata as td

    d = td.drift_rows(spark, sf_dir)
    wide = d.select("*", (F.col("num_col") * 2).alias("num2"), F.concat("cat_col", F.lit("x")).alias("cat2"),
                    (1 - F.col("flag_col")).alias("flag2"))

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")

    for regime in ("tests", "distances"):
        narrow_scans = scans(drift_report(d, regime=regime))
        assert narrow_scans > 0
        assert scans(drift_report(wide, regime=regime)) == narrow_scans
    assert "Expand" not in drift_report(wide, regime="distances")._jdf.queryExecution().toString()
