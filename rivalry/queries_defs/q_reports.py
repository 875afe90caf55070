"""Queries for report tables (RP1-RP5) and attributions (XP2-XP6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.catalog import query
from rivalry.functions import scalars as S
from rivalry.operators import explain as X
from rivalry.operators import joins as J
from rivalry.operators import ordering as O
from rivalry.operators import projections as P
from rivalry.operators import report as R
from rivalry.oracle_views import with_views
from rivalry.queries_defs.q_ingest import AS_OF
from rivalry.session import cut_lineage
from rivalry.sources import testdata as td

_UPCOMING_SQL = f"""
select u.*, cast(round_even(p.home_raw, 0) as bigint) as home_prediction, cast(round_even(p.away_raw, 0) as bigint) as away_prediction,
  f.location
from (select match_id, home_team, away_team, fixture_date, fixture_time from (
        select b.match_id, b.home_team, b.away_team,
          cast(strptime(substr(f.date_text, 1, 10), '%d/%m/%Y') as date) as fixture_date,
          cast(cast(substr(f.date_text, 12, 2) as int) as varchar) || substr(f.date_text, 14, 3) as fixture_time
        from matches b join fixtures f on f.season = b.season and f.home_team = b.home_team
          and f.away_team = b.away_team and f.match_number = b.match_id where f.result is null)
      where fixture_date >= date '{AS_OF}' order by fixture_date, fixture_time, match_id limit 12) u
join predictions p on p.match_id = u.match_id join fixtures f on f.match_number = u.match_id"""


def _ord(d: str) -> str:
    return (
        f"cast({d} as varchar) || case when ({d} between 4 and 20) or ({d} between 24 and 30) then 'th' "
        f"when {d} % 10 = 1 then 'st' when {d} % 10 = 2 then 'nd' else 'rd' end"
    )


_DISPLAY = f"strftime(fixture_date, '%A') || ' ' || {_ord('day(fixture_date)')} || ' ' || strftime(fixture_date, '%B')"


def _upcoming(spark, sf):
    # the report pairs fixtures with match rows; no feature column is read
    st = td.matches(spark, sf).select("match_id", "season", "home_team", "away_team")
    fx_all = td.fixtures(spark, sf)
    fx = P.filter_unplayed(fx_all).drop("result").withColumnRenamed("match_number", "match_id")
    cur = J.fixture_join(st, fx, on=["season", "home_team", "away_team", "match_id"]).select(
        "match_id", "home_team", "away_team", "location",
        F.to_date(S.fixture_date_text("date_text"), "dd/MM/yyyy").alias("fixture_date"),
        S.fixture_time("date_text").alias("fixture_time"),
    )
    nxt = O.next_fixtures(cur, as_of=AS_OF, date_col="fixture_date", time_text_col="fixture_time", tie="match_id")
    pred = td.predictions(spark, sf).select(
        "match_id", S.round_half_even("home_raw").alias("home_prediction"),
        S.round_half_even("away_raw").alias("away_prediction"),
    )
    return nxt.join(pred, "match_id")


@query(
    "rp1_upcoming_table",
    with_views(
        f"select home_team as home, home_prediction as h, away_prediction as a, away_team as away, {_DISPLAY} as date, "
        f"fixture_time as time, location as stadium, match_id from ({_UPCOMING_SQL})",
        "matches", "fixtures", "predictions",
    ),
)
def rp1(spark, sf):
    return R.upcoming_table(_upcoming(spark, sf))


@query(
    "rp2_fixture_detail",
    with_views(
        "select match_id, home_team as home, cast(home_prediction as varchar) || '-' || cast(away_prediction as varchar) as prediction, "
        f"away_team as away, {_DISPLAY} as date, fixture_time as time, location as stadium from ({_UPCOMING_SQL})",
        "matches", "fixtures", "predictions",
    ),
)
def rp2(spark, sf):
    return R.fixture_detail(_upcoming(spark, sf))


_PHRASE = (
    "case when t.home_team = t.team then (case m.ftr when 'H' then 'Win' when 'D' then 'Draw' else 'Loss' end) "
    "else (case m.ftr when 'H' then 'Loss' when 'D' then 'Draw' else 'Win' end) end || ' v ' || "
    "case when t.home_team = t.team then t.away_team else t.home_team end || ' (' || "
    "case when t.home_team = t.team then 'H' else 'A' end || ')'"
)

_RP3_SQL = f"""
with up as ({_UPCOMING_SQL}),
hist as (select match_id, match_date, home_team, away_team, ftr, home_team as team from matches
         union all select match_id, match_date, home_team, away_team, ftr, away_team from matches),
sides as (select match_id as fixture_id, fixture_date, 'home' as side, home_team as team from up
          union all select match_id, fixture_date, 'away', away_team from up),
ranked as (select s.fixture_id, s.side, h.*, row_number() over (partition by s.fixture_id, s.side
             order by h.match_date desc, h.match_id desc) as back
           from sides s join hist h on h.team = s.team and h.match_date < s.fixture_date),
cnt as (select fixture_id, side, least(count(*), 5) as k from ranked where back <= 5 group by 1, 2),
picked as (select r.fixture_id, r.side, cast(c.k - r.back + 1 as bigint) as position,
             {_PHRASE.replace('t.', 'r.').replace('m.ftr', 'r.ftr')} as phrase
           from ranked r join cnt c on c.fixture_id = r.fixture_id and c.side = r.side where r.back <= 5),
grid as (select match_id, cast(unnest(range(1, 6)) as bigint) as position from up)
select g.match_id, g.position,
  case when (select count(*) from picked where fixture_id = g.match_id and side = 'home') = 0 then 'Not Available' else ph.phrase end as home_result,
  case when (select count(*) from picked where fixture_id = g.match_id and side = 'away') = 0 then 'Not Available' else pa.phrase end as away_result
from grid g
left join picked ph on ph.fixture_id = g.match_id and ph.side = 'home' and ph.position = g.position
left join picked pa on pa.fixture_id = g.match_id and pa.side = 'away' and pa.position = g.position"""


def _rp3_sql() -> str:
    body = with_views("select 1", "matches", "fixtures", "predictions")
    ctes = body[len("WITH "):body.rindex("\nselect 1")]
    return "WITH " + ctes + ",\n" + _RP3_SQL.strip()[len("with "):]


@query("rp3_last5_both", _rp3_sql())
def rp3(spark, sf):
    # read by the team filter and by the report: one copy of a few rows
    upcoming = cut_lineage(_upcoming(spark, sf))
    return R.last5_both(upcoming, R.team_history(td.matches(spark, sf), upcoming))


@query(
    "rp4_goals_error_over_time",
    with_views(
        "select run_date, max(case when model_type = 'home' then mean_ae end) as home, "
        "max(case when model_type = 'away' then mean_ae end) as away from ("
        "select * from (select *, row_number() over (partition by run_date, model_type order by mean_ae, run_id) as rn "
        "from model_runs where model_type in ('home', 'away')) where rn = 1) group by run_date",
        "model_runs",
    ),
)
def rp4(spark, sf):
    return R.goals_error_over_time(td.model_runs(spark, sf))


@query(
    "rp5_result_metrics_over_time",
    with_views(
        "select run_date, run_id, mcc, accuracy, f1 from (select *, row_number() over (partition by run_date "
        "order by mean_ae, run_id) as rn from model_runs where model_type = 'result') where rn = 1",
        "model_runs",
    ),
)
def rp5(spark, sf):
    return R.result_metrics_over_time(td.model_runs(spark, sf))


# ----------------------------------------------------------- attributions
_GROUPS = ["f1", "f2"]
_COLLAPSE_SQL = (
    "select row_id, case when contains(feature, 'f1') then 'f1' when contains(feature, 'f2') then 'f2' else feature end as feature, "
    "sum(contribution) as contribution, min(pos) as pos from attributions group by 1, 2"
)


@query("xp2_attribution_collapse", with_views(
    f"select row_id, feature, round(contribution, 9) as contribution, pos from ({_COLLAPSE_SQL})", "attributions"))
def xp2(spark, sf):
    out = X.attribution_collapse(td.attributions(spark, sf), _GROUPS)
    return out.select("row_id", "feature", F.round("contribution", 9).alias("contribution"),
                      F.col("pos").cast("long").alias("pos"))


@query(
    "xp3_attribution_top3",
    with_views(
        "select row_id, max(case when rn = 1 then feature end) as top1, max(case when rn = 2 then feature end) as top2, "
        "max(case when rn = 3 then feature end) as top3 from (select row_id, feature, row_number() over (partition by row_id "
        f"order by contribution desc, pos asc) as rn from ({_COLLAPSE_SQL})) where rn <= 3 group by row_id",
        "attributions",
    ),
)
def xp3(spark, sf):
    return X.attribution_top3(X.attribution_collapse(td.attributions(spark, sf), _GROUPS))


@query(
    "xp4_attribution_summary",
    with_views("select feature, mean_abs, (select count(*) from m b where b.mean_abs > m.mean_abs) + "
               "((select count(*) from m b where b.mean_abs = m.mean_abs) + 1) / 2.0 as rank from m",
               "attributions",
               extra=[("m", "select feature, round(avg(abs(contribution)), 9) as mean_abs from attributions group by feature")]),
)
def xp4(spark, sf):
    s = X.attribution_summary(td.attributions(spark, sf))
    return s.select("feature", F.round("mean_abs", 9).alias("mean_abs"), "rank")


@query(
    "xp5_one_row_waterfall",
    with_views(
        "select feature, round(contribution, 9) as contribution, round(abs(contribution), 9) as abs_contribution "
        "from attributions where row_id = (select max(row_id) from attributions) union all "
        "select '__base__', round((select sum(contribution) from attributions) / (select count(distinct row_id) from attributions), 9), "
        "round(abs((select sum(contribution) from attributions) / (select count(distinct row_id) from attributions)), 9)",
        "attributions",
    ),
)
def xp5(spark, sf):
    a = td.attributions(spark, sf)
    latest = a.agg(F.max("row_id")).scalar()
    base = a.agg(F.sum("contribution") / F.countDistinct("row_id")).scalar()
    out = X.one_row_waterfall(a, latest, base_value=base)
    return out.select("feature", *[F.round(c, 9).alias(c) for c in ("contribution", "abs_contribution")])


@query(
    "xp6_residual_pairs",
    with_views("select fthg as actual, cast(round_even(home_raw, 0) as bigint) as predicted from predictions",
               "predictions"),
)
def xp6(spark, sf):
    p = td.predictions(spark, sf).withColumn("pred", S.round_half_even("home_raw"))
    return X.residual_pairs(p, actual="fthg", predicted="pred")
