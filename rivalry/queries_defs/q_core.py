"""Queries for the core match operators: W1-W16, J7, PRJ10-11, RP6."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.catalog import query
from rivalry.operators.form import add_differences, add_form_cols, add_streaks
from rivalry.operators.standings import block_positions, fill_away_position, season_table
from rivalry.operators.teamgames import match_index, team_games
from rivalry.oracle_views import with_views
from rivalry.plans.features import block_state, build_features
from rivalry.sources import testdata as td

FORM_H = [f"hm{k}" for k in range(1, 6)]
FORM_A = [f"am{k}" for k in range(1, 6)]


def _block(spark, sf):
    return block_state(td.matches(spark, sf))


@query(
    "w1_match_week",
    with_views("select match_id, season, cast(i as bigint) as i, j, mw from blk", "blk"),
)
def w1(spark, sf):
    return match_index(td.matches(spark, sf)).select("match_id", "season", "i", "j", "mw")


@query(
    "w2_team_games",
    with_views(
        "select season, team, match_id, venue, gf, ga, res, pts, cast(g as bigint) as g, cast(n as bigint) as n, "
        "cum_gf, cum_ga, cum_pts from (select * from tg)",
        "tg",
    ),
)
def w2(spark, sf):
    return team_games(td.matches(spark, sf)).select(
        "season", "team", "match_id", "venue", "gf", "ga", "res", "pts", "g", "n", "cum_gf", "cum_ga", "cum_pts"
    )


@query("w6_match_results", with_views("select season, team, match_id, cast(g as bigint) as g, res from tg", "tg"))
def w6(spark, sf):
    return team_games(td.matches(spark, sf)).select("season", "team", "match_id", "g", "res")


@query("w3_goals_scored", with_views("select match_id, htgs, atgs from bstate", "bstate"))
def w3(spark, sf):
    return _block(spark, sf).select("match_id", "htgs", "atgs")


@query("w4_goals_conceded", with_views("select match_id, htgc, atgc from bstate", "bstate"))
def w4(spark, sf):
    return _block(spark, sf).select("match_id", "htgc", "atgc")


@query("w5_points_to_date", with_views("select match_id, htp, atp from bstate", "bstate"))
def w5(spark, sf):
    return _block(spark, sf).select("match_id", "htp", "atp")


@query(
    "j7_game_no_asof",
    with_views(
        "select match_id, season, j, hn as home_games, an as away_games, "
        "least(j, hn) as home_state_game, least(j, an) as away_state_game, htgs, htgc, htp, atgs, atgc, atp from bstate",
        "bstate",
    ),
)
def j7(spark, sf):
    from rivalry.operators.teamgames import attach_block_state, game_counts, match_index, team_games_scan

    m = td.matches(spark, sf)
    scan = team_games_scan(m)
    counts = game_counts(scan)
    out = attach_block_state(match_index(m), scan)
    hc = counts.select("season", F.col("team").alias("home_team"), F.col("n").alias("home_games"))
    ac = counts.select("season", F.col("team").alias("away_team"), F.col("n").alias("away_games"))
    out = out.join(hc, ["season", "home_team"], "left").join(ac, ["season", "away_team"], "left")
    return out.select(
        "match_id", "season", "j",
        F.coalesce("home_games", F.lit(0)).alias("home_games"), F.coalesce("away_games", F.lit(0)).alias("away_games"),
        F.least("j", F.coalesce("home_games", F.lit(0))).alias("home_state_game"),
        F.least("j", F.coalesce("away_games", F.lit(0))).alias("away_state_game"),
        "htgs", "htgc", "htp", "atgs", "atgc", "atp",
    )


@query("w7_form_k", with_views("select match_id, " + ", ".join(FORM_H + FORM_A) + " from bform", "bform"))
def w7(spark, sf):
    return _block(spark, sf).select("match_id", *FORM_H, *FORM_A)


@query(
    "w8_form_string_points",
    with_views("select match_id, htformptsstr, atformptsstr, htformpts, atformpts from bfeat", "bfeat"),
)
def w8(spark, sf):
    return add_form_cols(_block(spark, sf)).select(
        "match_id", "htformptsstr", "atformptsstr", "htformpts", "atformpts"
    )


_STREAK_SQL = ", ".join(
    f"cast(({expr}) as bigint) as {side}{name}"
    for side, col in (("ht", "htformptsstr"), ("at", "atformptsstr"))
    for name, expr in (
        ("winstreak3", f"right({col}, 3) = 'WWW'"),
        ("winstreak5", f"{col} = 'WWWWW'"),
        ("lossstreak3", f"right({col}, 3) = 'LLL'"),
        ("lossstreak5", f"{col} = 'LLLLL'"),
    )
)


@query("w9_streaks", with_views(f"select match_id, {_STREAK_SQL} from bfeat", "bfeat"))
def w9(spark, sf):
    out = add_streaks(add_form_cols(_block(spark, sf)))
    return out.select("match_id", *[c for c in out.columns if "streak" in c])


@query(
    "prj11_diff_cols",
    with_views("select match_id, htgd, atgd, diffpts, diffformpts from bfeat2", "bfeat2"),
)
def prj11(spark, sf):
    return add_differences(add_form_cols(_block(spark, sf))).select(
        "match_id", "htgd", "atgd", "diffpts", "diffformpts"
    )


def _positions(spark, sf):
    return block_positions(add_differences(add_form_cols(_block(spark, sf))))


@query(
    "w10_league_position",
    with_views("select match_id, mw, home_league_position, away_pos_raw from bpos", "bpos"),
)
def w10(spark, sf):
    return _positions(spark, sf).select("match_id", "mw", "home_league_position", "away_pos_raw")


def _filled(spark, sf):
    # the fill writes its rows: only what it and the queries need
    return fill_away_position(_positions(spark, sf).select("season", "match_id", "away_team", "i", "home_league_position", "away_pos_raw"))


@query("w11_position_ffill", with_views("select match_id, away_league_position from bfill", "bfill"))
def w11(spark, sf):
    return _filled(spark, sf).select("match_id", "away_league_position")


@query(
    "w12_position_diff",
    with_views(
        "select match_id, home_league_position - away_league_position as league_position_diff from bfill", "bfill"
    ),
)
def w12(spark, sf):
    return _filled(spark, sf).select("match_id", "league_position_diff")


@query("w13_all_rounds", with_views("select * from features_block", "features_block"))
def w13(spark, sf):
    return build_features(td.matches(spark, sf), mode="block")


@query(
    "prj10_scale_by_round",
    with_views("select match_id, mw, htgd, atgd, diffpts, diffformpts, htp, atp from features_block", "features_block"),
)
def prj10(spark, sf):
    return build_features(td.matches(spark, sf), mode="block").select(
        "match_id", "mw", "htgd", "atgd", "diffpts", "diffformpts", "htp", "atp"
    )


_ASOF_SQL = with_views(
    "select *, htformpts - atformpts as diffformpts from ("
    + """
select s.season, s.match_id, s.match_date, s.home_team, s.away_team,
  s.htgs, s.atgs, s.htgc, s.atgc, s.htp, s.atp, s.hm1, s.hm2, s.hm3, s.hm4, s.hm5, s.am1, s.am2, s.am3, s.am4, s.am5,
  b.mw,
  cast((case when s.hm1 = 'W' then 3 when s.hm1 = 'D' then 1 else 0 end) + (case when s.hm2 = 'W' then 3 when s.hm2 = 'D' then 1 else 0 end)
     + (case when s.hm3 = 'W' then 3 when s.hm3 = 'D' then 1 else 0 end) + (case when s.hm4 = 'W' then 3 when s.hm4 = 'D' then 1 else 0 end)
     + (case when s.hm5 = 'W' then 3 when s.hm5 = 'D' then 1 else 0 end) as bigint) as htformpts,
  cast((case when s.am1 = 'W' then 3 when s.am1 = 'D' then 1 else 0 end) + (case when s.am2 = 'W' then 3 when s.am2 = 'D' then 1 else 0 end)
     + (case when s.am3 = 'W' then 3 when s.am3 = 'D' then 1 else 0 end) + (case when s.am4 = 'W' then 3 when s.am4 = 'D' then 1 else 0 end)
     + (case when s.am5 = 'W' then 3 when s.am5 = 'D' then 1 else 0 end) as bigint) as atformpts,
  s.htgs - s.htgc as htgd, s.atgs - s.atgc as atgd, s.htp - s.atp as diffpts,
  cast(hp.pos as bigint) as home_league_position, cast(ap.pos as bigint) as away_league_position,
  cast(hp.pos - ap.pos as bigint) as league_position_diff,
  strftime(s.match_date, '%A') as match_day_day, strftime(s.match_date, '%B') as match_day_month,
  cast(day(s.match_date) as bigint) as match_day_date,
  cast(case when s.ftr = 'H' then 0 when s.ftr = 'D' then 1 else 2 end as bigint) as ftr
from astate s join blk b on b.match_id = s.match_id
left join apos hp on hp.season = s.season and hp.match_date = s.match_date and hp.team = s.home_team
left join apos ap on ap.season = s.season and ap.match_date = s.match_date and ap.team = s.away_team
"""
    + ")",
    "astate", "blk", "apos",
)


@query("features_asof", _ASOF_SQL)
def features_asof(spark, sf):
    return build_features(td.matches(spark, sf), mode="asof")


@query(
    "rp6_standings",
    with_views(
        """
select season, team, played, won, drawn, lost, goals_for, goals_against, points, goals_for - goals_against as goal_diff,
  row_number() over (partition by season order by points desc, goals_for - goals_against desc, goals_for desc, team asc) as position
from (select season, team, count(*) as played,
  cast(sum(case when res = 'W' then 1 else 0 end) as bigint) as won,
  cast(sum(case when res = 'D' then 1 else 0 end) as bigint) as drawn,
  cast(sum(case when res = 'L' then 1 else 0 end) as bigint) as lost,
  cast(sum(gf) as bigint) as goals_for, cast(sum(ga) as bigint) as goals_against,
  cast(sum(case res when 'W' then 3 when 'D' then 1 else 0 end) as bigint) as points
  from tr group by season, team)""",
        "tr",
    ),
)
def rp6(spark, sf):
    return season_table(td.matches(spark, sf))
