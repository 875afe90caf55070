"""Deliveries of the streaming refresh and R2 far from zero."""

import os
import time

import pytest
from pyspark.sql import functions as F

from rivalry.operators.evaluate import regression_metrics
from rivalry.streaming.refresh import read_refreshed, stream_refresh

SCHEMA = "match_id long, goals long, season string"


def land(spark, folder, rows, files, marker=True):
    spark.createDataFrame(rows, SCHEMA).repartition(files).write.option("header", True).csv(folder)
    if not marker:
        os.remove(f"{folder}/_SUCCESS")
    time.sleep(1.1)  # file systems keep whole seconds


def table_of(spark, path):
    return sorted(tuple(r) for r in read_refreshed(spark, path, ["match_id", "goals", "season"]).collect())


@pytest.mark.parametrize("max_files", [None, 1, 3])
def test_a_season_in_many_files_beside_older_deliveries(spark, tmp_path, max_files):
    base = str(tmp_path)
    old = [(i, 9, "s1") for i in range(50)] + [(i, 1, "s2") for i in range(20)]
    new = [(i, i, "s1") for i in range(100)] + [(3, 3, "s1"), (None, 4, "s1")]
    land(spark, f"{base}/landing/b old", old, 3)
    land(spark, f"{base}/landing/a_new", new, 4)
    land(spark, f"{base}/landing/c_unfinished", [(1, 1, "s1")], 2, marker=False)
    args = dict(schema=SCHEMA, max_files=max_files)
    stream_refresh(spark, f"{base}/landing/*", f"{base}/table", checkpoint=f"{base}/ckpt", **args)
    want = sorted([(i, i, "s1") for i in range(100)] + [(i, 1, "s2") for i in range(20)])
    assert table_of(spark, f"{base}/table") == want
    # a replay changes nothing; the marker finishes the delivery that waited
    stream_refresh(spark, f"{base}/landing/*", f"{base}/table", checkpoint=f"{base}/ckpt2", **args)
    assert table_of(spark, f"{base}/table") == want
    open(f"{base}/landing/c_unfinished/_SUCCESS", "w").close()
    stream_refresh(spark, f"{base}/landing/*", f"{base}/table", checkpoint=f"{base}/ckpt", **args)
    assert table_of(spark, f"{base}/table") == sorted([(1, 1, "s1")] + [(i, 1, "s2") for i in range(20)])


def test_r2_of_values_far_from_zero(spark):
    rows = [(1e9 + k, 1e9 + k + (-1) ** k * 0.5) for k in range(4)]
    got = regression_metrics(spark.createDataFrame(rows, "a double, p double"), actual="a", predicted="p").first()
    assert got.r2 == pytest.approx(1 - 4 * 0.25 / 5, abs=1e-9) and got.mean_ae == 0.5
    same = spark.range(5).select(F.lit(2.0).alias("a"), F.lit(1.0).alias("p"))
    assert regression_metrics(same, actual="a", predicted="p").first().r2 is None
