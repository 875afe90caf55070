"""Operators rewritten for scale against brute force: the exact split, the
as-of lookup before a fixture, places of a table; boosted classes and
generalised linear attributions."""

import math
import random
from datetime import date, timedelta

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from rivalry.operators import explain as X
from rivalry.operators import ml as M
from rivalry.operators import quality as Q
from rivalry.operators import report as R
from rivalry.operators import standings as S
from rivalry.operators.standings import season_table
from rivalry.operators.teamgames import team_games_scan


@pytest.mark.parametrize("cell_rows", [65_536, 50, 0])
@pytest.mark.parametrize("ratio", [0.0, 0.1, 0.8, 1.0])
def test_split_is_exact_and_by_hash(spark, monkeypatch, cell_rows, ratio):
    monkeypatch.setattr(M, "CELL_ROWS", cell_rows)
    df = spark.range(997).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    train, test = M.split(df, key="k", ratio=ratio)
    want = [r.k for r in df.orderBy(F.xxhash64("k", F.lit(42))).collect()]
    k = math.floor(997 * ratio + 0.5)
    assert {r.k for r in train.collect()} == set(want[:k]) and train.count() == k
    assert {r.k for r in test.collect()} == set(want[k:]) and test.count() == 997 - k


def test_split_with_repeated_and_null_keys(spark):
    rows = [(None, float(i % 3)) for i in range(60)] + [(7, float(i)) for i in range(30)] + [(i, 1.0) for i in range(10)]
    df = spark.createDataFrame(rows, "k long, v double")
    for ratio in (0.2, 0.5, 0.77):
        train, test = M.split(df, key="k", ratio=ratio)
        k = math.floor(100 * ratio + 0.5)
        left = [r for r in train.collect()]
        assert len(left) == k
        # the test part drops rows with NULLs
        kept = sorted((r.k, r.v) for r in left if r.k is not None) + sorted((r.k, r.v) for r in test.collect())
        assert sorted(kept) == sorted(r for r in rows if r[0] is not None)
    empty, rest = M.split(df.limit(0), key="k")
    assert empty.count() == rest.count() == 0


def test_split_sorts_and_copies_nothing(spark):
    train, test = M.split(spark.range(5000).withColumnRenamed("id", "k"), key="k")
    for part in (train, test):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Scan parquet" not in plan


def test_last5_before_a_fixture(spark):
    rnd = random.Random(3)
    day = date(2020, 1, 1)
    teams = list("ABCD")
    matches, upcoming = [], []
    for i in range(120):
        h, a = rnd.sample(teams, 2)
        matches.append((i, "s1", day + timedelta(days=rnd.randrange(60)), h, a, rnd.randrange(3), rnd.randrange(3)))
    for i in range(25):
        h, a = rnd.sample(teams + ["Z"], 2)
        upcoming.append((1000 + i, day + timedelta(days=rnd.randrange(-2, 70)), h, a))
    upcoming += [(2000, None, "A", "B"), (2001, day + timedelta(days=99), None, "C")]
    history = []
    for t in teams:
        own = sorted((m for m in matches if t in m[3:5]), key=lambda m: (m[2], m[0]))
        history += [(t, g + 1, m[2], m[3], m[4], 1 if m[5] == m[6] else 0 if m[5] > m[6] else 2) for g, m in enumerate(own)]
    schema = "team string, g long, match_date date, home_team string, away_team string, ftr_code int"
    h = spark.createDataFrame(history, schema)
    u = spark.createDataFrame(upcoming, "match_id long, fixture_date date, home_team string, away_team string")
    phrase = {(r.team, r.g): r.p for r in h.select("team", "g", R.result_phrase(F.col("team"), F.col("home_team"), F.col("away_team"), F.col("ftr_code")).alias("p")).collect()}
    want = set()
    for mid, d, home, away in upcoming:
        sides = []
        for t in (home, away):
            before = [r[1] for r in history if r[0] == t and d is not None and r[2] < d]
            last = sorted(before)[-5:]
            sides.append({k + 1: phrase[t, g] for k, g in enumerate(last)} if last else {k: "Not Available" for k in range(1, 6)})
        want |= {(mid, k, sides[0].get(k), sides[1].get(k)) for k in range(1, 6)}
    got = [tuple(r) for r in R.last5_both(u, h).collect()]
    assert len(got) == len(want) and set(got) == want
    assert R.last5_both(u.limit(0), h).count() == 0
    assert {r.home_result for r in R.last5_both(u, h.limit(0)).collect()} == {"Not Available"}


def test_places_of_a_table_with_many_teams(spark):
    rnd = random.Random(5)
    n = 700
    rows = [(i, "big" if i % 3 else "small", date(2020, 1, 1) + timedelta(days=i % 90), f"t{rnd.randrange(n)}", f"u{rnd.randrange(n)}",
             rnd.randrange(4), rnd.randrange(4)) for i in range(2000)]
    rows = [(*r, "H" if r[5] > r[6] else "A" if r[5] < r[6] else "D") for r in rows]
    m = spark.createDataFrame(rows, "match_id long, season string, match_date date, home_team string, away_team string, fthg long, ftag long, ftr string")
    got = season_table(m).collect()
    for season in ("big", "small"):
        table = [r for r in got if r.season == season]
        order = sorted(table, key=lambda r: (-r.points, -r.goal_diff, -r.goals_for, r.team))
        assert [r.position for r in order] == list(range(1, len(table) + 1))


def test_boosted_classes(spark, tmp_path):
    rnd = random.Random(1)
    rows = []
    for i in range(600):
        a, b = rnd.random(), rnd.random()
        rows.append((i, a, b, "xyz"[i % 3], 0 if a > 0.6 else 1 if b > 0.5 else 2))
    df = spark.createDataFrame(rows, "id long, a double, b double, c string, label int")
    train, test = M.split(df, key="id")
    model = M.train_result_boosted(train, target="label", categorical=["c"], numeric=["a", "b"], max_iter=5, max_depth=3)
    model.write().overwrite().save(str(tmp_path / "model"))
    pred = M.class_scores(PipelineModel.load(str(tmp_path / "model")).transform(test)).select("label", "match_prediction", "result_scores").collect()
    assert all(abs(sum(r.result_scores) - 1) < 1e-9 and min(r.result_scores) >= 0 for r in pred)
    assert all(r.result_scores[int(r.match_prediction)] == max(r.result_scores) for r in pred)
    right = sum(r.label == r.match_prediction for r in pred) / len(pred)
    majority = max(sum(r.label == k for r in pred) for k in range(3)) / len(pred)
    assert right > majority + 0.2 and right > 0.9
    stacked = M.stack_prediction(model, test)
    assert set(stacked.columns) == {*df.columns, "match_prediction"}
    with pytest.raises(TypeError):
        M.train_result_boosted(df, target="c", categorical=[], numeric=["a"])


def test_generalised_linear_attribution(spark):
    rnd = random.Random(2)
    rows = [(i, x, y, float(max(0, round(math.exp(0.3 + x - 0.5 * y) + rnd.random() - 0.5)))) for i in range(300) for x, y in [(rnd.random(), rnd.random())]]
    df = spark.createDataFrame(rows, "id long, x double, y double, goals double")
    ready = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(df)
    model = GeneralizedLinearRegression(labelCol="goals", family="poisson", link="log").fit(ready)
    means = [sum(r[k] for r in rows) / len(rows) for k in (1, 2)]
    coef = list(model.coefficients)
    base = model.intercept + sum(k * m for k, m in zip(coef, means))
    assert X.attribution_base(df, model, ["x", "y"]) == pytest.approx(base)
    parts = {(r.row_id, r.feature): r.contribution for r in X.linear_attribution(df, model, ["x", "y"], row="id").collect()}
    for r in model.transform(ready).collect():
        assert parts[r.id, "x"] == pytest.approx(coef[0] * (r.x - means[0]))
        assert parts[r.id, "x"] + parts[r.id, "y"] == pytest.approx(math.log(r.prediction) - base)


_GAMES = "season string, match_id long, match_date date, home_team string, away_team string, fthg long, ftag long, ftr string"


def _games(seasons, teams, days, seed):
    rnd, out = random.Random(seed), []
    for season, n in zip(seasons, teams):
        for d in range(days):
            # a team may play twice a day, some days are missing, some goals too
            for _ in range(rnd.randint(0, n)):
                h, a = rnd.sample(range(n), 2)
                hg, ag = rnd.choice([None, 0, 0, 1, 2]), rnd.randint(0, 2)
                ftr = "D" if hg is None or hg == ag else "H" if hg > ag else "A"
                day = None if rnd.random() < 0.02 else date(2020, 1, 1) + timedelta(days=d)
                out.append((season, len(out), day, f"t{h:03d}", f"t{a:03d}", hg, ag, ftr))
    return out


def _places_by_hand(games):
    """The table of every match day, built anew from all earlier games."""
    want = {}
    for season, mid, day, home, away, *_ in games:
        if day is None:
            want[mid] = (None, None)
            continue
        table = {}
        for s, _, d, h, a, hg, ag, r in games:
            if s != season:
                continue
            for team, gf, ga, wins in ((h, hg, ag, "H"), (a, ag, hg, "A")):
                p, diff = table.get(team, (0, 0))
                if d is None or d < day:
                    p += 3 if r == wins else 1 if r == "D" else 0
                    diff += (gf or 0) - (ga or 0)
                table[team] = (p, diff)
        order = sorted(table, key=lambda t: (-table[t][0], -table[t][1], t))
        want[mid] = (order.index(home) + 1, order.index(away) + 1)
    return want


@pytest.mark.parametrize("seed, teams, days, block, grid", [
    (1, (12, 3), 15, 128, False), (2, (2, 5), 9, 1, False), (3, (40, 4), 8, 4, False), (3, (40, 4), 8, 128, True)])
def test_asof_positions_by_counts_and_grid(spark, monkeypatch, seed, teams, days, block, grid):
    monkeypatch.setattr(S, "_BLOCK", block)  # few or many levels
    monkeypatch.setattr(S, "_small_grid", lambda *a: grid)
    games = _games(("a", "b"), teams, days, seed)
    m = spark.createDataFrame(games, _GAMES).repartition(5)
    got = S.asof_positions(m, team_games_scan(m)).collect()
    want = _places_by_hand(games)
    assert len(got) == len(games)
    assert {r.match_id: (r.home_league_position, r.away_league_position) for r in got} == want


def test_asof_positions_of_no_games(spark):
    m = spark.createDataFrame([], _GAMES)
    scan = team_games_scan(m)
    assert S.asof_positions(m, scan).count() == 0
    assert S._places(S._spans(scan, ["season"], "match_date"), ["season"], "match_date").count() == 0


def test_asof_positions_build_no_grid(spark, monkeypatch):
    # 1,200 teams that play once, on 300 days: a grid would hold 360,000 rows
    games = [("a", i, date(2020, 1, 1) + timedelta(days=i // 2), f"t{2 * i:04d}", f"t{2 * i + 1:04d}", i % 3, i % 2, "H")
             for i in range(600)]
    m = spark.createDataFrame(games, _GAMES)
    scan = team_games_scan(m)
    seen, plain = [], S.ordered_scan
    monkeypatch.setattr(S, "ordered_scan", lambda df, *a, **k: (seen.append(df.count()), plain(df, *a, **k))[1])
    out = S.asof_positions(m, scan)
    # two spans a team in 19 blocks of 128, two digits of three bits: (1 + 3) nodes, 301 days
    assert seen[0] == 2 * 1200 and seen[1] <= 4 * 301
    # windows are left in the scans' carries only, a row per slice: none numbers teams
    assert "row_number" not in out._jdf.queryExecution().analyzed().toString()
    assert out.count() == 600


def test_profile_counts_by_sketch_beyond_the_set_limit(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("wide"), (F.col("id") % 100).alias("edge"), (F.col("id") % 101).alias("over"),
        F.when(F.col("id") % 2 == 0, "x").alias("half"), F.lit(None).cast("double").alias("none"))
    exact = {r.column: r for r in Q.profile(df, exact=True).collect()}
    sketch = {r.column: r for r in Q.profile(df).collect()}
    assert exact["wide"].distinct_count == 20_000 and abs(sketch["wide"].distinct_count - 20_000) < 2_000
    for c in ("edge", "over", "half", "none"):
        assert sketch[c] == exact[c]
    assert len(sketch["edge"].value_set) == 100 and sketch["over"].value_set is None and sketch["over"].distinct_count == 101
    # the values of a wide column are not shuffled
    only_wide = df.select("wide")
    assert "Deduplicate" in Q.profile(only_wide, exact=True)._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" not in Q.profile(only_wide)._jdf.queryExecution().analyzed().toString()
    assert Q.profile(only_wide).first().value_set is None


def test_profile_of_no_rows(spark):
    empty = spark.createDataFrame([], "a long, b string")
    for exact in (True, False):
        rows = Q.profile(empty, exact=exact).collect()
        assert [(r.n_rows, r.distinct_count, r.value_set) for r in rows] == [(0, 0, None)] * 2
