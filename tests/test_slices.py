"""Scans over given slices against scans over sampled ones, the block features
with slices of a few matches, and the attachment checked in one join."""

import random

import pytest
from pyspark.sql import functions as F

from rivalry.operators import teamgames as TG
from rivalry.operators.joins import keyed_attach, raise_unmatched
from rivalry.operators.scan import ordered_scan
from rivalry.plans.features import build_features
from rivalry.plans.jobs import features_with_goals

MATCH = "season string, match_id long, match_date string, home_team string, away_team string, fthg long, ftag long, ftr string"


def _matches(n=230):
    rnd = random.Random(3)
    rows = []
    for i in range(n):  # t7 and t8 stop early, and the second season is short
        h, a = rnd.sample([f"t{k}" for k in range(1, 9 if i < 60 else 7)], 2)
        hg, ag = rnd.randint(0, 3), rnd.randint(0, 2)
        rows.append(("s1" if i % 5 else "s2", i, f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", h, a, hg, ag, "H" if hg > ag else "A" if ag > hg else "D"))
    return rows


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("bound", [0, 1_000_000])
def test_given_slices_equal_sampled_ones(spark, monkeypatch, bound):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), rnd.choice("xyz"), i, rnd.choice([None, i]), rnd.choice("WDL")) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t string, i long, v long, res string")
    ask = {"row_number": "g", "sums": {"s": "v"}, "lags": {"res": 5}, "ffill": {"f": "v"}}
    want = ordered_scan(df, ["k", "t"], ["i"], **ask)
    monkeypatch.setattr("rivalry.operators.scan.CARRY_BROADCAST_MAX", bound)
    # a slice without rows of a key lies between two with some, and most hold fewer rows than a lag reaches
    got = ordered_scan(df.withColumn("_slice", F.floor(F.col("i") / 9)), ["k", "t"], ["i"], slices="_slice", **ask)
    assert got.columns == want.columns and got.schema["s"].dataType == want.schema["s"].dataType
    assert _rows(got) == _rows(want)


def test_null_key_raises_with_slices(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "k string, i long").withColumn("_slice", F.lit(0))
    with pytest.raises(Exception, match="NULL in key column k"):
        ordered_scan(df, ["k"], ["i"], slices="_slice").collect()


def test_block_features_do_not_depend_on_the_slices(spark, monkeypatch):
    m = spark.createDataFrame(_matches(), MATCH).withColumn("match_date", F.to_date("match_date"))
    want = _rows(build_features(m, streaks=True))
    monkeypatch.setattr(TG, "SLICE_ROWS", 20)
    assert _rows(build_features(m, streaks=True)) == want
    indexed = TG.match_index(m, block=10)
    assert _rows(TG.indexed_games_scan(indexed).drop("i")) == _rows(TG.team_games_scan(m).drop("match_date"))


def test_goals_are_attached_by_one_join(spark):
    m = spark.createDataFrame(_matches(60), MATCH).withColumn("match_date", F.to_date("match_date"))
    got = features_with_goals(m)
    assert got.columns[0] == "match_id" and got.columns[-2:] == ["fthg", "ftag"] and "_unmatched" not in got.columns
    assert _rows(got.select("match_id", "fthg", "ftag")) == _rows(m.select("match_id", "fthg", "ftag"))
    assert _rows(got.drop("fthg", "ftag")) == _rows(build_features(m).drop("match_date"))


@pytest.mark.parametrize("left, right, covered", [
    ([1, 2], [2, 1], True), ([1, 1, 2], [1, 2], True), ([1, 2], [1], False), ([1], [1, 2], False), ([1, None], [1, None], False), ([], [], True),
])
def test_keys_of_one_side_raise_either_way(spark, left, right, covered):
    rows = spark.createDataFrame([(k, 1) for k in left], "k long, a long")
    values = spark.createDataFrame([(k, 2) for k in right], "k long, b long")
    if covered:
        want = _rows(keyed_attach(rows, values, key="k"))
        assert len(want) == len(left)
        assert _rows(raise_unmatched(keyed_attach(rows, values, key="k", mark=True))) == want
        return
    with pytest.raises(ValueError, match="same keys"):
        keyed_attach(rows, values, key="k")
    with pytest.raises(ValueError, match="same keys"):
        raise_unmatched(keyed_attach(rows, values, key="k", mark=True))
