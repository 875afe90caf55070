"""DuckDB definitions of the derived views (same rows as
``rivalry.sources.testdata``), used to build the oracle SQL strings."""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "matches": """
select o_orderkey as match_id, cast(o_orderdate as date) as match_date,
  case when month(o_orderdate) < 8
       then concat(cast(year(o_orderdate)-1 as varchar), '-', lpad(cast(year(o_orderdate) % 100 as varchar), 2, '0'))
       else concat(cast(year(o_orderdate) as varchar), '-', lpad(cast((year(o_orderdate)+1) % 100 as varchar), 2, '0')) end as season,
  concat('T', lpad(cast(o_custkey % 20 as varchar), 2, '0')) as home_team,
  concat('T', lpad(cast((o_custkey % 20 + 1 + o_orderkey % 19) % 20 as varchar), 2, '0')) as away_team,
  cast(floor(o_orderkey / 7) as bigint) % 5 as fthg,
  cast(floor(o_totalprice) as bigint) % 4 as ftag,
  case when cast(floor(o_orderkey / 7) as bigint) % 5 > cast(floor(o_totalprice) as bigint) % 4 then 'H'
       when cast(floor(o_orderkey / 7) as bigint) % 5 = cast(floor(o_totalprice) as bigint) % 4 then 'D' else 'A' end as ftr
from orders""",
    "raw_matches": """
select match_id, season, home_team, away_team, fthg, ftag, ftr,
  concat(lpad(cast(day(match_date) as varchar), 2, '0'), '/', lpad(cast(month(match_date) as varchar), 2, '0'), '/',
    case when year(match_date) < 1998 then lpad(cast(year(match_date) % 100 as varchar), 2, '0') else cast(year(match_date) as varchar) end) as date_text
from matches""",
    "fixtures": """
select match_id as match_number, match_id % 38 + 1 as round_number,
  concat(lpad(cast(day(match_date) as varchar), 2, '0'), '/', lpad(cast(month(match_date) as varchar), 2, '0'), '/', cast(year(match_date) as varchar),
    ' ', lpad(cast(match_id % 14 + 8 as varchar), 2, '0'), ':', case when match_id % 2 = 0 then '00' else '30' end) as date_text,
  concat('NATION_', cast(match_id % 25 as varchar)) as location, home_team, away_team,
  case when match_id % 17 = 0 then null else concat(cast(fthg as varchar), ' - ', cast(ftag as varchar)) end as result, season
from matches""",
    "locations": """
select n_name as location, cast(n_nationkey * 1234 + 15000 as bigint) as capacity from nation""",
    "predictions": """
select match_id, season, fthg, ftag,
  (fthg * 2 + match_id % 3 - 1) / cast(2 as double) as home_raw, (ftag * 2 + match_id % 2) / cast(2 as double) as away_raw,
  case ftr when 'H' then 0 when 'D' then 1 else 2 end as actual_class,
  case when match_id % 10 < 6 then case ftr when 'H' then 0 when 'D' then 1 else 2 end else cast(match_id % 3 as int) end as predicted_class
from matches""",
    "model_runs": """
select event_id as run_id, cast(ts as date) as run_date,
  case user_id % 3 when 0 then 'home' when 1 then 'away' else 'result' end as model_type,
  value as mean_ae, value / 100 as mcc, value / 90 as accuracy, value / 95 as f1
from events""",
    "drift_rows": """
select case when l_shipdate < timestamp '1998-01-01 00:00:00' then 'reference' else 'current' end as part,
  l_quantity as num_col, l_returnflag as cat_col, case when l_linestatus = 'F' then 1 else 0 end as flag_col
from lineitem""",
    "artifacts": """
select o_orderkey as id, concat('models/classifier_v', cast(o_orderkey % 3 as varchar), '_',
  case when o_orderkey % 50 = 0 then 'latest'
       else concat(cast(year(o_orderdate) as varchar), lpad(cast(month(o_orderdate) as varchar), 2, '0'), lpad(cast(day(o_orderdate) as varchar), 2, '0')) end, '.bin') as path
from orders""",
    "attributions": """
select vec_id as row_id, concat('f', cast(pos as varchar)) as feature, pos, cast(embedding[pos + 1] as double) as contribution
from (select vec_id, embedding, unnest(range(len(embedding))) as pos from embeddings)""",
}

# derived helper views built on the ones above (oracle only)
HELPERS: dict[str, str] = {
    # Row in season, block, round
    "blk": """
select *, cast(floor((i - 1) / 10) as bigint) as j, cast(floor((i - 1) / 10) as bigint) + 1 as mw
from (select *, row_number() over (partition by season order by match_date, match_id) as i from matches)""",
    # Two rows per match
    "tr": """
select season, match_id, match_date, home_team as team, away_team as opponent, 'H' as venue,
  cast(fthg as bigint) as gf, cast(ftag as bigint) as ga,
  case when ftr = 'H' then 'W' when ftr = 'A' then 'L' else 'D' end as res
from matches
union all
select season, match_id, match_date, away_team, home_team, 'A', cast(ftag as bigint), cast(fthg as bigint),
  case when ftr = 'A' then 'W' when ftr = 'H' then 'L' else 'D' end
from matches""",
    "tg": """
select *,
  row_number() over w as g,
  cast(sum(gf) over w as bigint) as cum_gf, cast(sum(ga) over w as bigint) as cum_ga,
  cast(sum(pts) over w as bigint) as cum_pts,
  lag(res, 1) over w as res_lag1, lag(res, 2) over w as res_lag2, lag(res, 3) over w as res_lag3,
  lag(res, 4) over w as res_lag4, lag(res, 5) over w as res_lag5,
  count(*) over (partition by season, team) as n
from (select *, cast(case res when 'W' then 3 when 'D' then 1 else 0 end as bigint) as pts from tr)
window w as (partition by season, team order by match_date, match_id rows between unbounded preceding and current row)""",
    # J7 + W3-W5 + W7, block mode
    "bs": """
select b.*, coalesce(hc.n, 0) as hn, coalesce(ac.n, 0) as an
from blk b
left join (select distinct season, team, n from tg) hc on hc.season = b.season and hc.team = b.home_team
left join (select distinct season, team, n from tg) ac on ac.season = b.season and ac.team = b.away_team""",
    "bstate": """
select s.*,
  coalesce(h.cum_gf, 0) as htgs, coalesce(h.cum_ga, 0) as htgc, coalesce(h.cum_pts, 0) as htp,
  coalesce(a.cum_gf, 0) as atgs, coalesce(a.cum_ga, 0) as atgc, coalesce(a.cum_pts, 0) as atp,
  h.res as h0, h.res_lag1 as h1, h.res_lag2 as h2, h.res_lag3 as h3, h.res_lag4 as h4,
  a.res as a0, a.res_lag1 as a1, a.res_lag2 as a2, a.res_lag3 as a3, a.res_lag4 as a4
from bs s
left join tg h on h.season = s.season and h.team = s.home_team and h.g = least(s.j, s.hn)
left join tg a on a.season = s.season and a.team = s.away_team and a.g = least(s.j, s.an)""",
}


def _form_sql(side: str, k: int) -> str:
    n = "hn" if side == "h" else "an"
    idx = f"(least(j, {n}) - (j - {k} + 1))"
    pick = " ".join(f"when {idx} = {li} then {side}{li}" for li in range(5))
    return f"case when j < {k} then 'M' when j - {k} + 1 > {n} then 'L' else case {pick} end end"


def _points_sql(c: str) -> str:
    return f"(case when {c} = 'W' then 3 when {c} = 'D' then 1 else 0 end)"


HELPERS["bform"] = (
    "select *, "
    + ", ".join(f"{_form_sql('h', k)} as hm{k}" for k in range(1, 6))
    + ", "
    + ", ".join(f"{_form_sql('a', k)} as am{k}" for k in range(1, 6))
    + " from bstate"
)
HELPERS["bfeat"] = (
    "select *, hm1 || hm2 || hm3 || hm4 || hm5 as htformptsstr, am1 || am2 || am3 || am4 || am5 as atformptsstr, "
    + "cast(" + " + ".join(_points_sql(f"hm{k}") for k in range(1, 6)) + " as bigint) as htformpts, "
    + "cast(" + " + ".join(_points_sql(f"am{k}") for k in range(1, 6)) + " as bigint) as atformpts, "
    + "htgs - htgc as htgd, atgs - atgc as atgd, htp - atp as diffpts from bform"
)
HELPERS["bfeat2"] = "select *, htformpts - atformpts as diffformpts from bfeat"
HELPERS["bent"] = """
select season, mw, team, max(p) as p, max(d) as d, max(h) as has_home from (
  select season, mw, home_team as team, htp as p, htgd as d, 1 as h from bfeat2
  union all
  select season, mw, away_team, atp, atgd, 0 from bfeat2) group by season, mw, team"""
HELPERS["brank"] = """
select *, row_number() over (partition by season, mw order by p desc, d asc, team asc) as pos from bent"""
HELPERS["bpos"] = """
select f.*, cast(hr.pos as bigint) as home_league_position,
  cast(case when ar.has_home = 1 then null else ar.pos end as bigint) as away_pos_raw
from bfeat2 f
left join brank hr on hr.season = f.season and hr.mw = f.mw and hr.team = f.home_team
left join brank ar on ar.season = f.season and ar.mw = f.mw and ar.team = f.away_team"""
HELPERS["bfill"] = """
select *, cast(coalesce(last_value(away_pos_raw ignore nulls) over (partition by season, away_team order by i
  rows between unbounded preceding and current row), 0) as bigint) as away_league_position
from bpos"""
HELPERS["features_block"] = """
select season, match_id, match_date, home_team, away_team,
  htgs, atgs, htgc, atgc, htp / cast(mw as double) as htp, atp / cast(mw as double) as atp,
  hm1, hm2, hm3, hm4, hm5, am1, am2, am3, am4, am5, mw, htformpts, atformpts,
  htgd / cast(mw as double) as htgd, atgd / cast(mw as double) as atgd,
  diffpts / cast(mw as double) as diffpts, diffformpts / cast(mw as double) as diffformpts,
  home_league_position, away_league_position, home_league_position - away_league_position as league_position_diff,
  strftime(match_date, '%A') as match_day_day, strftime(match_date, '%B') as match_day_month,
  cast(day(match_date) as bigint) as match_day_date,
  cast(case when ftr = 'H' then 0 when ftr = 'D' then 1 else 2 end as bigint) as ftr
from bfill"""

# as-of mode
HELPERS["aside"] = """
select match_id, venue, cum_gf - gf as gs, cum_ga - ga as gc, cum_pts - pts as p,
  coalesce(res_lag1, 'M') as m1, coalesce(res_lag2, 'M') as m2, coalesce(res_lag3, 'M') as m3,
  coalesce(res_lag4, 'M') as m4, coalesce(res_lag5, 'M') as m5
from tg"""
HELPERS["astate"] = """
select m.*, h.gs as htgs, h.gc as htgc, h.p as htp, a.gs as atgs, a.gc as atgc, a.p as atp,
  h.m1 as hm1, h.m2 as hm2, h.m3 as hm3, h.m4 as hm4, h.m5 as hm5,
  a.m1 as am1, a.m2 as am2, a.m3 as am3, a.m4 as am4, a.m5 as am5
from matches m join aside h on h.match_id = m.match_id and h.venue = 'H'
join aside a on a.match_id = m.match_id and a.venue = 'A'"""
HELPERS["asnap"] = """
select season, team, match_date, arg_max(cum_pts, g) as p, arg_max(cum_gf - cum_ga, g) as d
from tg group by season, team, match_date"""
HELPERS["agrid"] = """
select d.season, d.match_date, t.team from (select distinct season, match_date from matches) d
join (select distinct season, team from tr) t on t.season = d.season"""
HELPERS["apos"] = """
select season, match_date, team,
  row_number() over (partition by season, match_date order by p desc, d desc, team asc) as pos
from (
  select g.season, g.match_date, g.team,
    coalesce((select arg_max(s.p, s.match_date) from asnap s where s.season = g.season and s.team = g.team and s.match_date < g.match_date), 0) as p,
    coalesce((select arg_max(s.d, s.match_date) from asnap s where s.season = g.season and s.team = g.team and s.match_date < g.match_date), 0) as d
  from agrid g)"""


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies resolved in the
    order views are defined), then the ``extra`` (name, sql) CTEs."""
    allv = {**VIEWS, **HELPERS}
    deps = {
        "raw_matches": ["matches"], "fixtures": ["matches"], "predictions": ["matches"],
        "blk": ["matches"], "tr": ["matches"], "tg": ["tr"], "bs": ["blk", "tg"], "bstate": ["bs", "tg"],
        "bform": ["bstate"], "bfeat": ["bform"], "bfeat2": ["bfeat"], "bent": ["bfeat2"], "brank": ["bent"],
        "bpos": ["bfeat2", "brank"], "bfill": ["bpos"], "features_block": ["bfill"],
        "aside": ["tg"], "astate": ["matches", "aside"], "asnap": ["tg"], "agrid": ["matches", "tr"],
        "apos": ["agrid", "asnap"],
    }
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in deps.get(n, []):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    pairs = [(n, allv[n]) for n in order] + list(extra or [])
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in pairs)
    return f"WITH {ctes}\n{body}"
