"""Block ranks by sortable texts against the pairwise form, the form texts
against games taken one by one, and the columns that the scans write."""

import random

import pytest
from pyspark.sql import functions as F

from rivalry.operators import ml as M
from rivalry.operators import standings as S
from rivalry.operators.scan import ordered_scan
from rivalry.operators.teamgames import attach_block_state, match_index, team_games_scan

PLACED = "season string, mw long, i long, home_team string, away_team string, htp long, atp long, htgd long, atgd long"


def _blocks(one_entry: bool):
    rnd = random.Random(11)
    rows = []
    for mw in range(1, 40):
        state = {t: (rnd.randint(0, 3), rnd.randint(-2, 2)) for t in ["a", "b", "c", "d", "é", None]}
        for i in range(6):
            h, a = rnd.choice(list(state)), rnd.choice(list(state))
            hs, as_ = (state[h], state[a]) if one_entry else [(rnd.randint(0, 3), rnd.randint(-2, 2)) for _ in "ha"]
            rows.append(("s", mw, mw * 10 + i, h, a, hs[0], as_[0], hs[1], as_[1]))
    return rows


@pytest.mark.parametrize("one_entry", [True, False])
def test_ranks_by_texts_equal_ranks_by_pairs(spark, one_entry):
    df = spark.createDataFrame(_blocks(one_entry), PLACED)
    pairs = S.block_positions(df)
    never_null = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("htp", "atp", "htgd", "atgd")})
    texts = S.block_positions(never_null)
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" in plan and "collect_list" not in plan
    assert texts.columns == pairs.columns
    assert sorted(map(str, texts.collect())) == sorted(map(str, pairs.collect()))


def test_form_texts_equal_games_one_by_one(spark):
    rnd = random.Random(5)
    teams = ["t1", "t2", "t3", "t4", "t5", "t6"]
    rows = []
    for i in range(90):  # t5 and t6 stop early
        h, a = rnd.sample(teams if i < 10 else teams[:4], 2)
        hg, ag = rnd.randint(0, 2), rnd.randint(0, 2)
        rows.append(("s", i, f"2020-01-01", h, a, hg, ag, "H" if hg > ag else "A" if ag > hg else "D"))
    m = spark.createDataFrame(rows, "season string, match_id long, match_date string, home_team string, away_team string, fthg long, ftag long, ftr string")
    games = {t: [] for t in teams}
    for _, _, _, h, a, _, _, r in rows:
        games[h].append({"H": "W", "A": "L"}.get(r, "D"))
        games[a].append({"H": "L", "A": "W"}.get(r, "D"))
    out = attach_block_state(match_index(m, block=4), team_games_scan(m, keep=["team", "res"])).collect()
    assert len(out) == 90
    for row in out:
        for p, team in (("h", row.home_team), ("a", row.away_team)):
            played = games[team]
            want = ["M" if row.j < k else "L" if row.j - k + 1 > len(played) else played[row.j - k] for k in range(1, 6)]
            assert [row[f"{p}m{k}"] for k in range(1, 6)] == want


def test_scan_writes_the_columns_asked_for(spark):
    df = spark.createDataFrame([("k", i, i * 2, "x") for i in range(20)], "k string, o long, v long, wide string")
    out = ordered_scan(df, ["k"], ["o"], sums={"s": "v"}, keep=["o"])
    assert out.columns == ["k", "o", "rn", "s"]
    assert {r.o: (r.rn, r.s) for r in out.collect()} == {i: (i + 1, i * (i + 1)) for i in range(20)}


def test_one_indexer_counts_all_categories(spark):
    df = spark.createDataFrame([(c, d, float(i % 3)) for i, (c, d) in enumerate([("b", "x"), ("a", "y"), ("a", None), ("b", "x")] * 5)], "c string, d string, y double")
    model = M.train_result(df, target="y", categorical=["c", "d"], numeric=[], max_depth=2, num_trees=2)
    assert len(model.stages) == 3
    assert [list(x) for x in model.stages[0].labelsArray] == [["a", "b"], ["x", "y"]]
