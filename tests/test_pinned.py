"""Pinned small frames (FIXTURES.md part A) and hand-computed metrics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from rivalry.functions import scalars as S
from rivalry.operators import aggregates as A
from rivalry.operators import evaluate as EV
from rivalry.operators import ml as M
from rivalry.operators import projections as P
from rivalry.operators import quality as Q
from rivalry.operators.teamgames import MatchCols, match_index, team_games_scan
from rivalry.plans.features import block_state
from rivalry.sources import files as SRC

COLS = "season string, match_id long, match_date date, home_team string, away_team string, fthg long, ftag long, ftr string"


def _matches(spark, rows):
    out = []
    for i, (h, a, hg, ag, r) in enumerate(rows):
        out.append(("s", i + 1, dt.date(2020, 8, 1) + dt.timedelta(days=i), h, a, hg, ag, r))
    return spark.createDataFrame(out, COLS)


def _by_team(df, col):
    got = {}
    for r in df.orderBy("team", "g").collect():
        got.setdefault(r["team"], []).append(r[col])
    return got


def test_a1_cumulative_goals(spark):
    m = _matches(spark, [("Arsenal", "Chelsea", 1, 2, "A"), ("Chelsea", "Man Utd", 2, 1, "H"),
                         ("Man Utd", "Arsenal", 0, 2, "A")])
    tg = team_games_scan(m)
    assert _by_team(tg, "cum_gf") == {"Arsenal": [1, 3], "Chelsea": [2, 4], "Man Utd": [1, 1]}
    assert _by_team(tg, "cum_ga") == {"Arsenal": [2, 2], "Chelsea": [1, 2], "Man Utd": [2, 4]}
    # one block only: every to-date column is 0
    st = block_state(m).collect()
    assert all(r[c] == 0 for r in st for c in ("htgs", "atgs", "htgc", "atgc", "htp", "atp"))


def test_a2_results_and_points(spark):
    m = _matches(spark, [("A", "B", 1, 0, "H"), ("B", "C", 1, 1, "D"), ("C", "A", 0, 1, "A")])
    tg = team_games_scan(m)
    assert _by_team(tg, "res") == {"A": ["W", "W"], "B": ["L", "D"], "C": ["D", "L"]}
    assert _by_team(tg, "cum_pts") == {"A": [3, 6], "B": [0, 1], "C": [1, 1]}
    # result codes other than H/A count as a draw
    odd = _matches(spark, [("A", "B", 1, 0, None)])
    assert _by_team(team_games_scan(odd), "res") == {"A": ["D"], "B": ["D"]}


def test_match_week_blocks(spark):
    rows = [(f"T{i % 4}", f"T{(i + 1) % 4}", 1, 0, "H") for i in range(25)]
    idx = match_index(_matches(spark, rows), block=10).orderBy("i").collect()
    assert [r["mw"] for r in idx] == [1] * 10 + [2] * 10 + [3] * 5


def test_a5_rule_generation(spark):
    df = spark.createDataFrame(
        [("A", 1, 8.2), ("A", 4, None), ("A", 0, 2.99), ("B", 8, None), ("B", 3, 0.29), ("B", 3, 1.10)],
        "str_col string, int_col long, miss_col double",
    )
    rules = Q.generate_rules(Q.profile(df)).orderBy("rule_id").collect()
    assert len(rules) == 10
    assert [r.rule_type for r in rules] == [
        "columns_match_set", "column_type", "null_fraction", "in_set", "column_type", "null_fraction", "between",
        "column_type", "null_fraction", "between",
    ]
    by = {(r.rule_type, r.column): r for r in rules}
    assert by[("null_fraction", "miss_col")].mostly == pytest.approx(0.233)
    assert by[("between", "int_col")].min_value == pytest.approx(-0.8)
    assert by[("between", "int_col")].max_value == pytest.approx(8.8)
    assert by[("between", "miss_col")].min_value == pytest.approx(-0.501)
    assert by[("between", "miss_col")].max_value == pytest.approx(8.991)
    assert by[("in_set", "str_col")].value_set == ["A", "B"]
    wide = Q.generate_rules(Q.profile(df), max_buffer=20).filter("rule_type = 'between' and column = 'int_col'")
    assert wide.first().max_value == pytest.approx(9.6)
    # validation on the same frame passes every rule
    res = Q.validate(df, Q.generate_rules(Q.profile(df)))
    assert res.filter(~F.col("success")).count() == 0


def test_a6_season_calendar(spark):
    cases = [(1998, 2000, ["9899", "9900"]), (1999, 2001, ["9900", "0001"]), (2000, 2002, ["0001", "0102"]),
             (2000, 2000, []), (2002, 2000, [])]
    df = spark.createDataFrame([(a, b) for a, b, _ in cases], "s int, e int")
    got = df.select(SRC.season_calendar(F.col("s"), F.col("e")).alias("c")).collect()
    assert [r.c for r in got] == [c for _, _, c in cases]


def test_a7_replace_values(spark):
    df = spark.createDataFrame([("Gunners", 1), ("Spurs", 2), ("Forest", 3)], "Team string, Points int")
    m = {"Gunners": "Arsenal", "Spurs": "Tottenham", "Forest": "Nottingham Forest"}
    assert [r.Team for r in P.replace_values(df, m, ["Team"]).collect()] == ["Arsenal", "Tottenham", "Nottingham Forest"]
    assert [r.Team for r in P.replace_values(df, {}, ["Team"]).collect()] == ["Gunners", "Spurs", "Forest"]


def test_a8_no_unplayed_fixture_raises(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 1, "11/08/2023 20:00", "Turf Moor", "Burnley", "Man City", "0 - 3")] * 4,
        "match_number int, round_number int, date_text string, location string, home_team string, away_team string, result string",
    )
    path = str(tmp_path / "fx")
    df.write.option("header", True).csv(path)
    with pytest.raises(ValueError):
        SRC.scan_fixtures(spark, path)


def test_a9_split_sizes(spark):
    df = spark.createDataFrame([(f"t{i}", i) for i in range(5)], "team string, goals long")
    train, test = M.split(df, key="team", ratio=0.8)
    tr = {r.team for r in train.collect()}
    te = {r.team for r in test.collect()}
    assert len(tr) == 4 and len(te) == 1 and not tr & te


def test_a10_a11_scores(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "h int, a int")
    assert [r.r for r in df.select(S.result_from_scores("h", "a").alias("r")).collect()] == ["H", "A", "D"]
    x = spark.createDataFrame([(2.5,), (1.8,), (0.4,), (3.5,)], "x double")
    assert [r.v for r in x.select(S.round_half_even("x").alias("v")).collect()] == [2, 2, 0, 4]


def test_a12_align_columns(spark):
    df = spark.createDataFrame([(1, 2)], "col1 int, col3 int")
    out = P.align_columns(df, ["col1", "col2"])
    assert out.columns == ["col1", "col2"]
    assert out.first().col2 == 0


def test_class_metrics_by_hand(spark):
    df = spark.createDataFrame(list(zip([1, 1, 1, 0, 0], [1, 0, 1, 1, 0])), "a int, p int")
    m = EV.class_metrics(df, actual="a", predicted="p").first()
    assert m.accuracy == pytest.approx(0.6)
    assert m.f1_weighted == pytest.approx(0.6)
    assert m.mcc == pytest.approx(1 / 6)
    cm = {(r.actual, r.predicted): r.n for r in A.confusion_matrix(df, "a", "p").collect()}
    assert cm == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 2}


def test_regression_metrics_by_hand(spark):
    df = spark.createDataFrame(list(zip([4, 2, 4, 4, 3], [3, 2, 4, 5, 3])), "y long, p long")
    m = EV.regression_metrics(df, actual="y", predicted="p").first()
    assert m.mean_ae == pytest.approx(0.4)
    assert m.median_ae == pytest.approx(0.0)
    assert m.r2 == pytest.approx(0.375)


def test_date_parsing_pivot(spark):
    df = spark.createDataFrame([("05/08/95",), ("05/08/2005",), ("01/01/68",)], "t string")
    got = [r.d for r in df.select(S.parse_match_date("t").alias("d")).collect()]
    assert got == [dt.date(1995, 8, 5), dt.date(2005, 8, 5), dt.date(2068, 1, 1)]


def test_ordinal_and_merge_maps(spark):
    df = spark.createDataFrame([(d,) for d in (1, 2, 3, 4, 11, 21, 22, 23, 24, 31)], "d int")
    got = [r.s for r in df.select(S.ordinal_day("d").alias("s")).collect()]
    assert got == ["1st", "2nd", "3rd", "4th", "11th", "21st", "22nd", "23rd", "24th", "31st"]
    m = spark.range(1).select(
        S.merge_maps(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")),
                     F.create_map(F.lit("b"), F.lit("3"))).alias("m")
    ).first().m
    assert m == {"a": "1", "b": "3"}


def test_p_value_helpers(spark):
    from rivalry.operators.drift import p_values

    # chi-square(1) upper tail at 3.841 is 0.05; KS lambda 1.358 gives 0.05; chi-square(2) at 4 is exp(-2)
    n = 10_000_000
    root = math.sqrt(n / 2)
    rows = [("chisquare", 3.841, n, n, 1), ("ks", 1.358 / (root + 0.12 + 0.11 / root), n, n, 0), ("chisquare", 4.0, n, n, 2)]
    df = spark.createDataFrame(rows, "t string, s double, a long, b long, d long")
    chi, ks, exact = [r[0] for r in df.coalesce(1).select(p_values(*[F.col(c) for c in "tsabd"])).collect()]
    assert chi == pytest.approx(0.05, abs=1e-3)
    assert ks == pytest.approx(0.05, abs=1e-3)
    assert math.isclose(exact, math.exp(-2.0), rel_tol=1e-9)


def test_dedupe_keep_first(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "a"), ("j", 2, "b")], "k string, seq int, v string")
    from rivalry.operators.sets import dedupe_keep_first

    got = {r.k: r.v for r in dedupe_keep_first(df, ["k"], ["seq"]).collect()}
    assert got == {"k": "a", "j": "b"}


def test_league_keys_generalise(spark):
    """Two leagues share team names; keys keep them apart."""
    rows = []
    for lg in ("E0", "D1"):
        for i in range(12):
            rows.append((lg, "s", i + 1 + (100 if lg == "D1" else 0), dt.date(2020, 8, 1) + dt.timedelta(days=i),
                         f"T{i % 3}", f"T{(i + 1) % 3}", 1, 0, "H"))
    m = spark.createDataFrame(rows, "league string, " + COLS)
    cols = MatchCols(keys=("league", "season"))
    idx = match_index(m, cols=cols).groupBy("league").agg(F.max("i").alias("n")).collect()
    assert {r.league: r.n for r in idx} == {"E0": 12, "D1": 12}


def test_fixture_scan_falls_back_to_next_file(spark, tmp_path):
    cols = ("match_number int, round_number int, date_text string, location string, home_team string, "
            "away_team string, result string")
    played = spark.createDataFrame([(1, 1, "11/08/2023 20:00", "X", "A", "B", "0 - 3")], cols)
    upcoming = spark.createDataFrame([(2, 1, "10/08/2024 15:00", "Y", "C", "D", None)], cols)
    cur, nxt = str(tmp_path / "cur"), str(tmp_path / "next")
    played.write.option("header", True).csv(cur)
    upcoming.write.option("header", True).csv(nxt)
    got = SRC.scan_fixtures(spark, cur, next_path=nxt, schema=cols).collect()
    assert [(r.home_team, r.away_team) for r in got] == [("C", "D")]


def test_refresh_partition_semantics(spark):
    from rivalry.operators.sets import refresh_partition

    full = spark.createDataFrame([("s1", 1, "a"), ("s2", 2, "b"), ("s2", 3, None)], "season string, x int, y string")
    assert refresh_partition(full, None, season="s2").count() == 3  # source missing: unchanged
    new = spark.createDataFrame([("s2", 9, "z"), ("s2", 9, "z"), ("s2", 8, None)], "season string, x int, y string")
    got = sorted((r.season, r.x) for r in refresh_partition(full, new, season="s2").collect())
    assert got == [("s1", 1), ("s2", 9)]


def test_null_upper_bound_rule(spark):
    ref = spark.createDataFrame([(1.0,), (None,), (2.0,), (3.0,)], "x double")
    rules = Q.generate_rules(Q.profile(ref), missing_upper=True)
    assert rules.filter("rule_type = 'null_fraction_max'").count() == 1
    worse = spark.createDataFrame([(None,), (None,), (None,), (1.0,)], "x double")
    res = {r.rule_type: r.success for r in Q.validate(worse, rules).collect()}
    assert res["null_fraction"] is True and res["null_fraction_max"] is False


def test_next_fixtures_time_order(spark):
    from rivalry.operators.ordering import next_fixtures

    df = spark.createDataFrame([(1, dt.date(2024, 1, 6), "12:30"), (2, dt.date(2024, 1, 6), "9:00")],
                               "id int, d date, t string")
    as_text = [r.id for r in next_fixtures(df, as_of="2024-01-01", date_col="d", time_text_col="t", tie="id").collect()]
    as_time = [r.id for r in next_fixtures(df, as_of="2024-01-01", date_col="d", time_text_col="t", tie="id",
                                           time_as_text=False).collect()]
    assert as_text == [1, 2] and as_time == [2, 1]


def test_models_beat_majority_baseline(spark):
    """Fixed seed: when the lower-numbered team always wins, the result model
    beats the majority class and the goal model beats predicting the mean."""
    import random

    rnd = random.Random(3)
    rows = []
    for i in range(600):
        a, b = rnd.sample(range(6), 2)
        hg, ag = (2, 0) if a < b else (0, 1)
        rows.append((i, f"T{a}", f"T{b}", float(rnd.random()), 0 if a < b else 2, hg, ag))
    df = spark.createDataFrame(rows, "id long, home_team string, away_team string, noise double, ftr int, "
                                     "fthg long, ftag long")
    train, test = M.split(df, key="id", ratio=0.8, seed=42)
    clf = M.train_result(train, target="ftr", categorical=["home_team", "away_team"], numeric=["noise"],
                         num_trees=20, seed=42)
    acc = M.result_accuracy(clf.transform(test), target="ftr")
    majority = test.groupBy("ftr").count().agg(F.max("count")).first()[0] / test.count()
    assert acc > majority + 0.2
    reg = M.train_goals(train, target="fthg", categorical=["home_team", "away_team"], numeric=["noise"], max_iter=10)
    pred = reg.transform(test)
    m = EV.regression_metrics(pred, actual="fthg", predicted="fthg_raw").first()
    assert m.r2 > 0.5


def test_drift_report_small_sample_matches_column_statistics(spark):
    import random

    from rivalry.operators import drift as D

    rnd = random.Random(1)
    rows = []
    for part, shift in (("reference", 0.0), ("current", 0.7)):
        for _ in range(300):
            rows.append((part, rnd.gauss(shift, 1.0), rnd.choice("abc" if part == "reference" else "abcc"),
                         int(rnd.random() < (0.3 if part == "reference" else 0.5))))
    df = spark.createDataFrame(rows, "part string, num double, cat string, flag int")
    chosen = D.preset(df)
    assert chosen == {"regime": "tests", "columns": ["num", "cat", "flag"], "categorical": ["cat", "flag"], "binary": ["flag"]}
    rep = {r.column: r for r in D.drift_report(df, **chosen).collect()}
    assert rep["num"].test == "ks" and rep["cat"].test == "chisquare" and rep["flag"].test == "z"
    assert rep["num"].score == pytest.approx(D.ks_statistic(df, "num").first().ks)
    assert rep["cat"].score == pytest.approx(D.chi_square(df, "cat").first().chi2)
    assert rep["flag"].score == pytest.approx(D.z_proportion(df, "flag").first().z)
    assert rep["num"].drifted and rep["num"].p_value < 0.05
    assert rep["__dataset__"].score == pytest.approx(sum(rep[c].drifted for c in ("num", "cat", "flag")) / 3)
    assert rep["__dataset__"].n_drifted == sum(rep[c].drifted for c in ("num", "cat", "flag")) and rep["__dataset__"].p_value is None


def test_drift_of_constant_empty_and_new_values(spark):
    from rivalry.operators import drift as D

    rows = [("reference", 5.0, None, "a", None) for _ in range(50)] + [("current", 5.0, None, "a" if i % 2 else "new", 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "part string, const double, none double, cat string, late double")
    for regime in ("tests", "distances"):
        rep = {r.column: r for r in D.drift_report(df, regime=regime).collect()}
        assert set(rep) == {"const", "none", "cat", "late", "__dataset__"}
        assert rep["const"].score == 0 and not rep["const"].drifted
        assert rep["none"].score is None and not rep["none"].drifted and rep["late"].score is None
        assert rep["cat"].drifted and rep["__dataset__"].n_drifted == 1 and rep["__dataset__"].score == 0.25
    assert D.chi_square(df, "cat").first().chi2 == float("inf")
    assert D.wasserstein_normed(df, "const").first().wasserstein == 0
    assert D.ks_statistic(df, "none").first().ks is None


def test_p_values_against_known_points(spark):
    import math

    from pyspark.sql import functions as F

    from rivalry.operators import drift as D

    # chi-square with 2 degrees is exp(-x/2), with 1 erfc(sqrt(x/2)); the Kolmogorov function at 1.3581 is 0.05
    n = 10_000_000
    root = math.sqrt(n / 2)
    rows = [("chisquare", 3.0, n, n, 2, math.exp(-1.5)), ("chisquare", 0.5, n, n, 1, math.erfc(0.5)), ("chisquare", 1200.0, n, n, 1000, None),
            ("chisquare", float("inf"), n, n, 3, 0.0), ("z", 1.959963984540054, n, n, 0, 0.05),
            ("ks", 1.3581015157406196 / (root + 0.12 + 0.11 / root), n, n, 0, 0.05), ("ks", 0.5 / root, n, n, 0, 0.9639), ("ks", 0.0, n, n, 0, 1.0)]
    df = spark.createDataFrame([r[:5] for r in rows], "t string, s double, a long, b long, d long")
    got = [r[0] for r in df.select(D.p_values(*[F.col(c) for c in "tsabd"])).collect()]
    for g, r in zip(got, rows):
        assert g == pytest.approx(r[5], abs=2e-4) if r[5] is not None else 1e-6 < g < 1e-4


def test_scan_seasons_quotes_and_layouts(spark, tmp_path):
    a = tmp_path / "9596"
    b = tmp_path / "0001"
    a.mkdir()
    b.mkdir()
    (a / "E0.csv").write_text('Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR\nE0,19/08/95,"Brighton, Hove",Leeds,1,0,H\n')
    (b / "E0.csv").write_text('Date,FTR,AwayTeam,HomeTeam,FTAG,FTHG,Referee\n19/08/2000,D,"The ""Saints""",Leeds,2,2,X\n'
                              '20/08/2000,A,Spurs,Leeds,1,,Y\n')
    got = SRC.scan_seasons(spark, [str(a / "E0.csv"), str(b / "E0.csv")],
                           required=["season", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"]).collect()
    rows = sorted((r.season, r.HomeTeam, r.AwayTeam, r.FTHG, r.FTR) for r in got)
    # the row with an empty goal count is dropped (any NULL)
    assert rows == [("1995-96", "Brighton, Hove", "Leeds", "1", "H"), ("2000-01", "Leeds", 'The "Saints"', "2", "D")]


def test_layouts_encodings_and_skipped_files(spark, tmp_path):
    for code in ("9596", "9697", "9798"):
        (tmp_path / code).mkdir()
    (tmp_path / "9596" / "E0.csv").write_bytes("Date,HomeTeam,AwayTeam\n1/1/95,Köln,HomeTeam\n".encode("latin-1"))
    (tmp_path / "9697" / "E0.csv").write_text("AwayTeam,Date,HomeTeam\nÅbo,2/2/96,Brest,extra\n")
    (tmp_path / "9798" / "E0.csv").write_text("nothing,here\n1,2\n")
    paths = f"{tmp_path}/*/E0.csv"
    got = SRC.scan_seasons(spark, paths, required=["season", "Date", "HomeTeam", "AwayTeam"]).collect()
    assert sorted(map(tuple, got)) == [("1995-96", "1/1/95", "Köln", "HomeTeam"), ("1996-97", "2/2/96", "Brest", "Åbo")]
    skipped = SRC.skipped_files(spark, paths, marker="Date").collect()
    assert [(r.file.split("/")[-2], r.first_line) for r in skipped] == [("9798", "nothing,here")]


def test_records_over_two_lines_and_bad_records(spark, tmp_path):
    for code in ("9596", "9697", "9798"):
        (tmp_path / code).mkdir()
    (tmp_path / "9596" / "E 0.csv").write_text(
        'Date,HomeTeam,Note,Date\n\n1/1/95,Ajax,"two\nlines, ""so""",x\n2/1/95,Brest,,y\nDate,HomeTeam,Note,Date\n3/1/95,Celtic\n4/1/95,Derby,a,b,c\n')
    (tmp_path / "9697" / "E 0.csv").write_bytes("Date,HomeTeam\n5/1/96,Köln\n6/1/96\n7/1/96,Lille,\n".encode("latin-1"))
    (tmp_path / "9798" / "E 0.csv").write_text("nothing\n1\n")
    files = SRC.HeaderedFiles(spark, f"{tmp_path}/*/E 0.csv")
    assert [(x.open_quotes, x.encoding) for x in files.layouts if "Date" in x.header] == [(False, "ISO-8859-1"), (True, "UTF-8")]
    got = SRC.scan_seasons(spark, files, required=["season", "Date", "HomeTeam"]).collect()
    assert sorted(map(tuple, got)) == [("1995-96", "1/1/95", "Ajax"), ("1995-96", "2/1/95", "Brest"), ("1995-96", "3/1/95", "Celtic"),
                                       ("1995-96", "4/1/95", "Derby"), ("1996-97", "5/1/96", "Köln"), ("1996-97", "7/1/96", "Lille")]
    notes = SRC.scan_encoded(spark, files, columns=["HomeTeam", "Note"]).collect()
    assert {r.HomeTeam: r.Note for r in notes if r.HomeTeam} == {
        "Ajax": 'two\nlines, "so"', "Brest": None, "Celtic": None, "Derby": "a", "Köln": None, "Lille": None}
    bad = files.bad_records(marker="Date").collect()
    assert sorted((r.problem, r.record.strip()) for r in bad) == [
        ("missing cells", "3/1/95,Celtic"), ("missing cells", "6/1/96"), ("surplus cells", "4/1/95,Derby,a,b,c"), ("surplus cells", "7/1/96,Lille,")]
    assert [r.first_line for r in SRC.skipped_files(spark, files, marker="Date").collect()] == ["nothing"]


def test_scan_of_one_line_records_is_pruned_and_split(spark, tmp_path):
    (tmp_path / "9596").mkdir()
    (tmp_path / "9596" / "E0.csv").write_text("Date,HomeTeam,Note\n1/1/95,Ajax,x\n")
    got = SRC.scan_seasons(spark, f"{tmp_path}/*/E0.csv", required=["season", "HomeTeam"])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c1:string>" in plan
    assert not SRC.HeaderedFiles(spark, f"{tmp_path}/*/E0.csv").layouts[0].open_quotes
