"""Report tables (RP1-RP5): upcoming fixtures, fixture detail, last five
results of both sides before a fixture, model error over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivalry.functions.scalars import display_date, month_name, result_phrase, weekday_name
from rivalry.operators.aggregates import best_per_group, pivot_metric
from rivalry.operators.ordering import ALL_SEASONS
from rivalry.operators.scan import ordered_scan
from rivalry.operators.teamgames import team_rows


def upcoming_table(upcoming: DataFrame) -> DataFrame:
    """RP1: Home, H, A, Away, Date, Time, Stadium (input: the next fixtures
    with predictions, date, time and location)."""
    return upcoming.select(
        F.col("home_team").alias("home"), F.col("home_prediction").alias("h"), F.col("away_prediction").alias("a"),
        F.col("away_team").alias("away"),
        display_date(weekday_name("fixture_date"), F.dayofmonth("fixture_date"), month_name("fixture_date")).alias("date"),
        F.col("fixture_time").alias("time"), F.col("location").alias("stadium"), "match_id",
    )


def choose_fixture(fixtures: DataFrame, label: str, *, home: str = "home_team", away: str = "away_team", season: str | None = None) -> DataFrame:
    """The fixture with the label 'Home v Away'; with ``season``, that of the
    latest season that has it."""
    one = fixtures.filter(F.concat(F.col(home), F.lit(" v "), F.col(away)) == label)
    return one if season is None else one.filter(F.col(season) == one.agg(F.max(season)).scalar())


def fixture_detail(upcoming: DataFrame, label: str | None = None) -> DataFrame:
    """RP2: per fixture: Home, Prediction ('2-1'), Away, Date, Time, Stadium;
    with ``label`` ('Home v Away') only that fixture."""
    t = upcoming_table(upcoming if label is None else choose_fixture(upcoming, label))
    return t.select("match_id", "home", F.concat(F.col("h").cast("string"), F.lit("-"), F.col("a").cast("string"))
                    .alias("prediction"), "away", "date", "time", "stadium")


def team_history(matches: DataFrame, upcoming: DataFrame) -> DataFrame:
    """The games of the fixtures' teams over all seasons, numbered per team,
    as :func:`last5_both` takes them. Other teams' matches are left out before
    anything is ordered: a semi join with the report's teams."""
    teams = upcoming.select(F.explode(F.array("home_team", "away_team")).alias("team")).distinct()
    if upcoming.count() <= MAX_BROADCAST_FIXTURES:
        teams = F.broadcast(teams)
    rows = team_rows(matches, cols=ALL_SEASONS).join(teams, "team", "left_semi")
    code = F.when(F.col("res") == "D", 1).when((F.col("res") == "W") == (F.col("venue") == "H"), 0).otherwise(2)
    at_home = F.col("venue") == "H"
    numbered = ordered_scan(rows.select("team", "match_date", "match_id", "opponent", "venue", "res"), ["team"], ["match_date", "match_id"], row_number="g")
    return numbered.select(
        "team", "g", "match_date", F.when(at_home, F.col("team")).otherwise(F.col("opponent")).alias("home_team"),
        F.when(at_home, F.col("opponent")).otherwise(F.col("team")).alias("away_team"), code.alias("ftr_code"))


# a report's fixture list is broadcast up to this many rows (checked)
MAX_BROADCAST_FIXTURES = 100_000


def last5_both(upcoming: DataFrame, history: DataFrame, *, n: int = 5) -> DataFrame:
    """RP3: for each upcoming fixture, the last ``n`` results of the home and
    the away team strictly before the fixture date, side by side by position
    (1 = oldest of the five); a side with no earlier match shows 'Not
    Available'.

    ``history`` is the per-team game table over the team's whole history
    (``team, g, match_date, home_team, away_team, ftr_code``, ``g`` counting a
    team's games from 1). Fixtures and games are put in one order per team,
    and the number of the last game before a fixture is filled forward by the
    ordered scan, so that no fixture meets all earlier games of its teams. Its
    ``n`` games are then looked up by (team, g): ``n`` rows a side."""
    sides = upcoming.select(
        "match_id", "fixture_date",
        F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home_team").alias("team")),
                          F.struct(F.lit("away").alias("side"), F.col("away_team").alias("team")))).alias("s"),
    ).select("match_id", "fixture_date", "s.side", "s.team").filter(F.col("team").isNotNull() & F.col("fixture_date").isNotNull())
    # a fixture stands before the games of its day
    tagged = sides.select("team", F.col("fixture_date").alias("day"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("g"), "match_id", "side").unionByName(
        history.filter(F.col("team").isNotNull() & F.col("match_date").isNotNull()).select(
            "team", F.col("match_date").alias("day"), F.lit(1).alias("kind"), F.col("g").cast("long").alias("g"),
            F.lit(None).cast(upcoming.schema["match_id"].dataType).alias("match_id"), F.lit(None).cast("string").alias("side")))
    filled = ordered_scan(tagged, ["team"], ["day", "kind", "g", "match_id", "side"], row_number=None, ffill={"nb": "g"})
    first = F.greatest(F.col("nb") - n + 1, F.lit(1))
    wanted = filled.filter((F.col("kind") == 0) & F.col("nb").isNotNull()).select(
        "match_id", "side", "team", F.posexplode(F.sequence(first, F.col("nb"))).alias("at", "g"))
    if upcoming.count() <= MAX_BROADCAST_FIXTURES:
        # 2n rows a fixture
        wanted = F.broadcast(wanted)
    picked = history.select("team", F.col("g").cast("long").alias("g"), "home_team", "away_team", "ftr_code").join(wanted, ["team", "g"]).select(
        "match_id", "side", (F.col("at") + 1).cast("long").alias("position"),
        result_phrase(F.col("team"), F.col("home_team"), F.col("away_team"), F.col("ftr_code")).alias("phrase"),
    )
    grid = upcoming.select("match_id", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("position"))
    home = picked.filter(F.col("side") == "home").select("match_id", "position", F.col("phrase").alias("home_result"))
    away = picked.filter(F.col("side") == "away").select("match_id", "position", F.col("phrase").alias("away_result"))
    out = grid.join(home, ["match_id", "position"], "left").join(away, ["match_id", "position"], "left")
    # one window partition per fixture: n rows each
    per_fixture = Window.partitionBy("match_id")
    has_home = F.max(F.col("home_result").isNotNull().cast("int")).over(per_fixture)
    has_away = F.max(F.col("away_result").isNotNull().cast("int")).over(per_fixture)
    return out.select(
        "match_id", F.col("position").cast("long").alias("position"),
        F.when(has_home == 0, F.lit("Not Available")).otherwise(F.col("home_result")).alias("home_result"),
        F.when(has_away == 0, F.lit("Not Available")).otherwise(F.col("away_result")).alias("away_result"),
    )


def goals_error_over_time(runs: DataFrame) -> DataFrame:
    """RP4: per run date the best (smallest mean_ae) home and away runs."""
    best = best_per_group(runs.filter(F.col("model_type").isin("home", "away")), ["run_date", "model_type"],
                          "mean_ae", "run_id")
    return pivot_metric(best, "run_date", "model_type", ["home", "away"], "mean_ae")


def result_metrics_over_time(runs: DataFrame) -> DataFrame:
    """RP5: per run date the result model run with the smallest ``mean_ae``
    (ties to the smallest run id): its mcc, accuracy and f1."""
    res = runs.filter(F.col("model_type") == "result")
    best = best_per_group(res.select("run_date", "run_id", "mean_ae", "mcc", "accuracy", "f1"), ["run_date"], "mean_ae", "run_id")
    return best.select("run_date", "run_id", "mcc", "accuracy", "f1")
