"""End-to-end jobs on the smallest tables: train, save, reload, score."""

import pytest
from pyspark.sql import functions as F

from rivalry.operators.drift import preset
from rivalry.operators.quality import generate_rules, profile
from rivalry.plans import jobs
from rivalry.plans.jobs import inference_job, latest_models, report_tables, training_job
from rivalry.sources import files as SRC
from rivalry.sources import testdata as td


def test_train_then_score(spark, sf_dir):
    m = td.matches(spark, sf_dir)
    rules = generate_rules(profile(m))
    out_dir = SRC.scratch_dir(spark, "jobs")
    res = training_job(spark, m, out_dir=out_dir, run_date="2024-01-07", rules=rules, reference=m,
                       goal_iterations=10, num_trees=10)
    assert res["validation"].filter(~F.col("success")).count() == 0
    # identical samples: no column drifts
    assert res["drift"].filter((F.col("column") != "__dataset__") & F.col("drifted")).count() == 0
    metrics = {r.model_type: r for r in res["metrics"].collect()}
    assert set(metrics) == {"result", "home", "away"}
    assert 0.0 <= metrics["result"].accuracy <= 1.0

    models = latest_models(spark, [res["classifier_model"], res["home_model"], res["away_model"]])
    raw = td.raw_matches(spark, sf_dir)
    fx = td.fixtures(spark, sf_dir).withColumnRenamed("match_number", "match_id")
    unplayed = fx.filter(F.col("result").isNull()).select("match_id")
    played = raw.join(unplayed, "match_id", "left_anti")
    upcoming = inference_job(spark, played, fx, models=models, as_of="1997-01-01")
    rows = upcoming.collect()
    assert 0 < len(rows) <= 12
    assert all(r.result_prediction in ("H", "D", "A") for r in rows)
    tables = report_tables(upcoming, spark.read.parquet(res["run_log"]))
    assert tables["upcoming"].count() == len(rows)
    assert tables["result_metrics"].count() == 1


def test_drift_arguments_do_not_follow_the_sample_size(spark, monkeypatch):
    seen = []

    class Stop(Exception):
        pass

    def report(df, **arguments):
        seen.append(arguments)
        raise Stop

    monkeypatch.setattr(jobs, "drift_report", report)
    m = spark.range(1001).selectExpr("id AS match_id", "id % 7 AS fthg", "id % 6 AS ftag", "'H' AS ftr")
    regimes = []
    for n in (1000, 1001):
        few = m.limit(n)
        both = few.selectExpr("*", "'reference' AS part")
        regimes.append(preset(both)["regime"])
        for drift in (None, {"regime": "tests", "binary": ["fthg"]}):
            with pytest.raises(Stop):
                training_job(spark, m, out_dir="/nowhere", reference=few, drift=drift)
    assert regimes == ["tests", "distances"]
    assert seen == [{"regime": "distances"}, {"regime": "tests", "binary": ["fthg"]}] * 2
