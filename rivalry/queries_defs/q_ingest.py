"""Queries for scans (SRC*), projections (PRJ*), joins (J*), sets (U*),
ordering (T*, W14-W16) and scalar functions (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.catalog import query
from rivalry.functions import scalars as S
from rivalry.operators import joins as J
from rivalry.operators import ordering as O
from rivalry.operators import projections as P
from rivalry.operators import sets as U
from rivalry.operators.form import add_differences, add_form_cols
from rivalry.operators.standings import block_positions, block_ranking, season_table
from rivalry.operators.teamgames import team_games
from rivalry.oracle_views import with_views
from rivalry.plans.features import block_state
from rivalry.session import cut_lineage
from rivalry.sources import files as SRC
from rivalry.sources import testdata as td

AS_OF = "1998-06-01"
REFRESH_SEASON = "2000-01"


# ---------------------------------------------------------------- sources
@query(
    "src1_scan_seasons",
    with_views(
        "select season, date_text as match_date_text, home_team, away_team, fthg, ftag, ftr from raw_matches",
        "raw_matches",
    ),
)
def src1(spark, sf):
    raw = td.raw_matches(spark, sf)
    code = F.concat(F.substring("season", 3, 2), F.substring("season", 6, 2))
    base = SRC.scratch_dir(spark, "seasons")
    # two header layouts: column order and extra columns differ per group
    odd = F.substring("season", 4, 1).cast("int") % 2 == 1
    a = raw.filter(~odd).select(
        F.col("date_text").alias("Date"), F.col("home_team").alias("HomeTeam"), F.col("away_team").alias("AwayTeam"),
        F.col("fthg").alias("FTHG"), F.col("ftag").alias("FTAG"), F.col("ftr").alias("FTR"), code.alias("code"),
    )
    b = raw.filter(odd).select(
        F.col("match_id").alias("Id"), F.col("ftr").alias("FTR"), F.lit('René,\n"the whistle"').alias("Referee"),
        F.col("ftag").alias("FTAG"), F.col("fthg").alias("FTHG"), F.col("away_team").alias("AwayTeam"),
        F.col("home_team").alias("HomeTeam"), F.col("date_text").alias("Date"), code.alias("code"),
    )
    # one landed file per season, as the source publishes them
    a.repartition("code").write.partitionBy("code").option("header", True).csv(f"{base}/layout_a")
    b.repartition("code").write.partitionBy("code").option("header", True).option("encoding", "ISO-8859-1").csv(f"{base}/layout_b")
    scanned = SRC.scan_seasons(
        spark, [f"{base}/layout_a/*/*.csv", f"{base}/layout_b/*/*.csv"],
        required=["season", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR"],
        season_pattern=r"code=(\d{4})",
    )
    return scanned.select(
        "season", F.col("Date").alias("match_date_text"), F.col("HomeTeam").alias("home_team"),
        F.col("AwayTeam").alias("away_team"), F.col("FTHG").cast("long").alias("fthg"),
        F.col("FTAG").cast("long").alias("ftag"), F.col("FTR").alias("ftr"),
    )


@query(
    "src1_bad_records",
    with_views(
        """
select season, problem, record from (
  select season, case match_id % 7 when 0 then 'surplus cells' when 1 then 'missing cells' else '' end as problem,
    case match_id % 7 when 0 then concat_ws(',', date_text, home_team, away_team, ftr, 'x') else concat_ws(',', date_text, home_team) end as record
  from raw_matches where right(season, 2) not in ('98'))
where problem <> ''
union all select distinct season, 'no Date column', 'Day,HomeTeam,AwayTeam,FTR' from raw_matches where right(season, 2) = '98'""",
        "raw_matches",
    ),
)
def src1_bad(spark, sf):
    """What the season scan leaves out: records that do not fit their header,
    and files without the marker column, found by one pass over the files."""
    raw = td.raw_matches(spark, sf).withColumn("code", F.concat(F.substring("season", 3, 2), F.substring("season", 6, 2)))
    header = F.when(F.col("code").endswith("98"), "Day,HomeTeam,AwayTeam,FTR").otherwise("Date,HomeTeam,AwayTeam,FTR")
    line = F.when(F.col("match_id") % 7 == 0, F.concat_ws(",", "date_text", "home_team", "away_team", "ftr", F.lit("x"))).when(
        F.col("match_id") % 7 == 1, F.concat_ws(",", "date_text", "home_team")).otherwise(F.concat_ws(",", "date_text", "home_team", "away_team", "ftr"))
    base = SRC.scratch_dir(spark, "seasons")
    lines = raw.select("code", F.lit(1).alias("at"), line.alias("value")).unionByName(
        raw.select("code", F.lit(0).alias("at"), header.alias("value")).distinct())
    lines.repartition("code").sortWithinPartitions("code", "at").select("code", "value").write.partitionBy("code").text(base)
    files = SRC.HeaderedFiles(spark, f"{base}/*/*.txt")
    bad = files.bad_records(marker="Date").unionByName(files.skipped("Date").select(
        "file", F.lit("no Date column").alias("problem"), F.col("first_line").alias("record")))
    return bad.select(SRC.season_from_path(F.col("file"), r"code=(\d{4})").alias("season"), "problem", "record")


@query(
    "src2_season_calendar",
    """select cast(y as bigint) as start_year,
  lpad(cast(y % 100 as varchar), 2, '0') || lpad(cast((y + 1) % 100 as varchar), 2, '0') as code
from (select unnest(range(min_y - 5, max_y + 1)) as y
      from (select min(year(o_orderdate)) as min_y, max(year(o_orderdate)) as max_y from orders))""",
)
def src2(spark, sf):
    o = td.table(spark, sf, "orders")
    bounds = o.agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    start, end = F.col("lo") - 5, F.col("hi") + 1
    years = F.sequence(start, end - 1)
    codes = SRC.season_calendar(start, end)
    return bounds.select(F.explode(F.arrays_zip(years.alias("y"), codes.alias("c"))).alias("z")).select(
        F.col("z.y").cast("long").alias("start_year"), F.col("z.c").alias("code")
    )


@query(
    "src3_scan_encoded",
    "select n_name || ' é' as location, cast(n_nationkey * 1234 + 15000 as bigint) as capacity from nation",
)
def src3(spark, sf):
    loc = td.locations(spark, sf).select(F.concat("location", F.lit(" é")).alias("location"), "capacity")
    path = SRC.scratch_dir(spark, "encodings")
    # half the files were saved in Latin-1, half in UTF-8 with their columns the other way round
    latin = F.col("capacity") % 2 == 0
    loc.filter(latin).write.option("header", True).option("encoding", "ISO-8859-1").csv(f"{path}/latin1")
    loc.filter(~latin).select("capacity", F.lit("-").alias("city"), "location").write.option("header", True).csv(f"{path}/utf8")
    return SRC.scan_encoded(spark, [f"{path}/latin1", f"{path}/utf8"], columns=["location", "capacity"], schema="location string, capacity long")


_FIX_SCHEMA = (
    "match_number long, round_number long, date_text string, location string, home_team string, "
    "away_team string, result string, season string"
)


@query("src4_scan_fixtures", with_views(
    "select * replace (case when home_team = 'T00' then 'T00-renamed' else home_team end as home_team, "
    "case when away_team = 'T00' then 'T00-renamed' else away_team end as away_team) from fixtures where result is null", "fixtures"))
def src4(spark, sf):
    fx = td.fixtures(spark, sf)
    path = SRC.scratch_dir(spark, "fixtures")
    fx.write.partitionBy("season").option("header", True).csv(path)
    # the season comes back from the partition folder name
    return SRC.scan_fixtures(
        spark, f"{path}/*/*.csv", schema=_FIX_SCHEMA.replace(", season string", ""), aliases={"T00": "T00-renamed"}, season_pattern=r"season=([^/]+)"
    ).select(*[c.split()[0] for c in _FIX_SCHEMA.split(", ")])


@query("src5_read_write_table", with_views("select * from matches", "matches"))
def src5(spark, sf):
    m = td.matches(spark, sf)
    path = SRC.write_table(m, SRC.scratch_dir(spark, "matches"), fmt="parquet", partition_by=["season"])
    return SRC.read_table(spark, path, fmt="parquet").select(*m.columns)


_ART_SQL = (
    "select path, regexp_extract(path, '^(.*)_[^_/]*$', 1) as prefix, "
    "cast(try_strptime(regexp_extract(path, '^(.*)_([0-9]{8})[.][^./]+$', 2), '%Y%m%d') as date) as stamp "
    "from artifacts"
)


@query(
    "src6_latest_versioned",
    with_views(
        f"""
select p.prefix, b.path as latest_path, p.latest_date
from (select prefix, max(stamp) as latest_date from ({_ART_SQL}) group by prefix) p
left join (select prefix, path, row_number() over (partition by prefix order by stamp desc, path desc) as rn
           from ({_ART_SQL}) where stamp is not null) b on b.prefix = p.prefix and b.rn = 1""",
        "artifacts",
    ),
)
def src6(spark, sf):
    return SRC.latest_versioned(td.artifacts(spark, sf)).select("prefix", "latest_path", "latest_date")


@query(
    "src6_latest_in_storage",
    with_views(
        f"""
select replace(p.prefix, 'models/', '') as prefix, replace(b.path, 'models/', '') as latest_name, p.latest_date, p.n_artifacts
from (select prefix, max(stamp) as latest_date, count(distinct path) as n_artifacts from ({_ART_SQL}) group by prefix) p
left join (select prefix, path, row_number() over (partition by prefix order by stamp desc, path desc) as rn
           from ({_ART_SQL}) where stamp is not null) b on b.prefix = p.prefix and b.rn = 1""",
        "artifacts",
    ),
)
def src6_storage(spark, sf):
    """The newest of the artifact folders found in storage, by their names."""
    root = SRC.scratch_dir(spark, "artifacts")
    landed = td.artifacts(spark, sf).withColumn("name", F.regexp_extract("path", "[^/]*$", 0))
    # many small folders: a fixed number of tasks, which are not merged
    landed.repartition(2 * spark.sparkContext.defaultParallelism, "name").write.partitionBy("name").json(root)
    found = SRC.list_artifacts(spark, root, folders=True).withColumn("path", F.regexp_extract("path", "name=([^/]*)$", 1))
    n = found.groupBy(F.regexp_extract("path", r"^(.*)_[^_/]*$", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n_artifacts"))
    return SRC.latest_versioned(found).join(n, "prefix").select("prefix", F.col("latest_path").alias("latest_name"), "latest_date", "n_artifacts")


@query(
    "src7_dated_path",
    with_views(
        "select *, 'models/' || model_type || '_' || strftime(run_date, '%Y%m%d') || '.bin' as artifact from model_runs",
        "model_runs",
    ),
)
def src7(spark, sf):
    runs = td.model_runs(spark, sf)
    path = SRC.scratch_dir(spark, "runs")
    runs.write.partitionBy("run_date").parquet(path)
    return spark.read.parquet(path).withColumn(
        "artifact", SRC.dated_path(F.concat(F.lit("models/"), F.col("model_type")), F.col("run_date"), "bin")
    )


def _drift_rules(spark, sf):
    from rivalry.operators.quality import generate_rules, profile

    d = td.drift_rows(spark, sf)
    return generate_rules(profile(d.filter(F.col("part") == "reference")))


def _drift_rules_sql(numbered: bool = False) -> str:
    from rivalry.queries_defs.q_quality import REF, _rules_sql

    rules = _rules_sql("drift_rows", REF)
    if numbered:
        rules = f"select row_number() over (order by rule_id) as rule_id, * exclude (rule_id) from ({rules})"
    return with_views(rules, "drift_rows")


@query("src8_write_json", _drift_rules_sql())
def src8(spark, sf):
    path = SRC.write_json(_drift_rules(spark, sf), SRC.scratch_dir(spark, "rules"))
    return SRC.read_rules(spark, path).withColumn("value_set", F.array_join("value_set", ","))


@query("src9_read_rules", _drift_rules_sql())
def src9(spark, sf):
    path = SRC.write_json(SRC.rules_document(_drift_rules(spark, sf), "drift_rows"), SRC.scratch_dir(spark, "suite"))
    return SRC.explode_rules_document(spark.read.json(path)).withColumn("value_set", F.array_join("value_set", ","))


@query("src9_stored_suite", _drift_rules_sql(numbered=True))
def src9_suite(spark, sf):
    """Rules written as a stored suite document, read, written and read again."""
    path = SRC.write_suite(_drift_rules(spark, sf), SRC.scratch_dir(spark, "suite"))
    again = SRC.write_suite(SRC.read_suite(spark, path), SRC.scratch_dir(spark, "suite"))
    return SRC.read_suite(spark, again).drop("suite", "kwargs", "meta").withColumn("value_set", F.array_join("value_set", ","))


# ------------------------------------------------------------ projections
@query(
    "prj1_select_required",
    with_views("select season, date_text, home_team, away_team, fthg, ftag, ftr from raw_matches", "raw_matches"),
)
def prj1(spark, sf):
    return P.select_required(
        td.raw_matches(spark, sf), ["season", "date_text", "home_team", "away_team", "fthg", "ftag", "ftr"]
    )


_ALIASES = {"T00": "T00-renamed", "T05": "T05-renamed", **P.TEAM_ALIASES}


@query(
    "prj2_replace_values",
    with_views(
        "select match_number, "
        "case home_team when 'T00' then 'T00-renamed' when 'T05' then 'T05-renamed' else home_team end as home_team, "
        "case away_team when 'T00' then 'T00-renamed' when 'T05' then 'T05-renamed' else away_team end as away_team "
        "from fixtures",
        "fixtures",
    ),
)
def prj2(spark, sf):
    fx = td.fixtures(spark, sf).select("match_number", "home_team", "away_team")
    return P.replace_values(fx, _ALIASES, ["home_team", "away_team"])


@query(
    "prj3_drop_if_exists",
    with_views("select match_id, match_date, season, home_team, away_team, ftag, ftr from matches", "matches"),
)
def prj3(spark, sf):
    return P.drop_if_exists(td.matches(spark, sf), ["fthg", "not_a_column"])


@query(
    "prj4_align_columns",
    with_views("select match_id, season, fthg, cast(0 as bigint) as extra_feature from matches", "matches"),
)
def prj4(spark, sf):
    return P.align_columns(td.matches(spark, sf), ["match_id", "season", "fthg", "extra_feature"], fill=0).withColumn(
        "extra_feature", F.col("extra_feature").cast("long")
    )


@query("prj5_filter_unplayed", with_views("select * from fixtures where result is null", "fixtures"))
def prj5(spark, sf):
    return P.filter_unplayed(td.fixtures(spark, sf))


@query(
    "prj6_fill_placeholders",
    with_views(
        "select match_number, season, home_team, away_team, cast(0 as bigint) as fthg, cast(0 as bigint) as ftag, 'D' as ftr "
        "from fixtures where result is null",
        "fixtures",
    ),
)
def prj6(spark, sf):
    fx = P.filter_unplayed(td.fixtures(spark, sf)).select(
        "match_number", "season", "home_team", "away_team",
        F.lit(None).cast("long").alias("fthg"), F.lit(None).cast("long").alias("ftag"),
        F.lit(None).cast("string").alias("ftr"),
    )
    return P.fill_placeholders(fx)


@query("prj7_drop_nulls", with_views("select * from fixtures where result is not null", "fixtures"))
def prj7(spark, sf):
    return P.drop_nulls(td.fixtures(spark, sf))


@query(
    "prj8_encode_result",
    with_views(
        "select match_id, cast(case when ftr = 'H' then 0 when ftr = 'D' then 1 else 2 end as bigint) as ftr_code from matches",
        "matches",
    ),
)
def prj8(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", P.encode_result(F.col("ftr")).alias("ftr_code"))


@query(
    "prj9_cast_categories",
    with_views("select match_id, season, home_team, away_team from matches", "matches"),
)
def prj9(spark, sf):
    out = P.cast_categories(td.matches(spark, sf), target="ftr")
    cats = P.categorical_columns(out)
    return out.select("match_id", *cats)


# ----------------------------------------------------------------- joins
@query(
    "j1_merge_features",
    with_views(
        "select match_id, season, match_date, home_team, away_team, fthg, ftag, ftr, htgs, atgs, htp, atp, hm1, am1, mw "
        "from bform",
        "bform",
    ),
)
def j1(spark, sf):
    # read four times below: one copy
    st = cut_lineage(block_state(td.matches(spark, sf)))
    keys = ["match_id", "season", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr"]
    gs = st.select(*keys, "htgs", "atgs")
    pts = st.select(*keys, "htp", "atp")
    form = st.select(*keys, "hm1", "am1")
    mw = st.select(*keys, "mw")
    return J.merge_features([gs, pts, form, mw], keys)


_TABLE_SQL = """
select season, team, row_number() over (partition by season order by points desc, goals_for - goals_against desc, goals_for desc, team asc) as position
from (select season, team, cast(sum(gf) as bigint) as goals_for, cast(sum(ga) as bigint) as goals_against,
  cast(sum(case res when 'W' then 3 when 'D' then 1 else 0 end) as bigint) as points from tr group by season, team)"""


@query(
    "j2_left_enrich",
    with_views(
        "select m.match_id, m.home_team, m.away_team, cast(h.position as bigint) as home_team_position, "
        "cast(a.position as bigint) as away_team_position from matches m "
        f"left join ({_TABLE_SQL}) h on h.season = m.season and h.team = m.home_team "
        f"left join ({_TABLE_SQL}) a on a.season = m.season and a.team = m.away_team",
        "matches", "tr",
    ),
)
def j2(spark, sf):
    m = td.matches(spark, sf)
    table = season_table(m)
    out = J.left_enrich(m, table, keys=["season"], team_cols=["home_team", "away_team"], value="position")
    return out.select("match_id", "home_team", "away_team", "home_team_position", "away_team_position")


@query(
    "j2_round_ranking",
    with_views(
        "select m.match_id, m.mw, m.home_team, m.away_team, cast(h.pos as bigint) as home_team_position, "
        "cast(a.pos as bigint) as away_team_position from bfeat2 m "
        "left join brank h on h.season = m.season and h.mw = m.mw and h.team = m.home_team "
        "left join brank a on a.season = m.season and a.mw = m.mw and a.team = m.away_team",
        "bfeat2", "brank",
    ),
)
def j2_round(spark, sf):
    placed = block_positions(add_differences(add_form_cols(block_state(td.matches(spark, sf)))))
    out = J.left_enrich(placed, block_ranking(placed), keys=["season", "mw"], team_cols=["home_team", "away_team"], value="position")
    return out.select("match_id", "mw", "home_team", "away_team", "home_team_position", "away_team_position")


@query(
    "j3_fixture_join",
    with_views(
        "select b.match_id, b.season, b.home_team, b.away_team, b.htp, b.atp, f.date_text, f.location "
        "from bstate b join fixtures f on f.season = b.season and f.home_team = b.home_team "
        "and f.away_team = b.away_team and f.match_number = b.match_id where f.result is null",
        "bstate", "fixtures",
    ),
)
def j3(spark, sf):
    st = block_state(td.matches(spark, sf)).select("match_id", "season", "home_team", "away_team", "htp", "atp")
    fx = P.filter_unplayed(td.fixtures(spark, sf)).drop("result").withColumnRenamed("match_number", "match_id")
    out = J.fixture_join(st, fx, on=["season", "home_team", "away_team", "match_id"])
    return out.select("match_id", "season", "home_team", "away_team", "htp", "atp", "date_text", "location")


@query(
    "j4_dimension_lookup",
    with_views(
        "select f.match_number, f.location, l.capacity from fixtures f left join locations l on l.location = f.location",
        "fixtures", "locations",
    ),
)
def j4(spark, sf):
    fx = td.fixtures(spark, sf).select("match_number", "location")
    # the dimension is counted and broadcast only under the row bound
    return J.dimension_lookup(fx, td.locations(spark, sf), on="location")


@query(
    "j5_keyed_attach",
    with_views(
        "select p.match_id, cast(round_even(p.home_raw, 0) as bigint) as home_pred, "
        "cast(round_even(p.away_raw, 0) as bigint) as away_pred, m.fthg, m.ftag "
        "from predictions p join matches m on m.match_id = p.match_id",
        "predictions", "matches",
    ),
)
def j5(spark, sf):
    p = td.predictions(spark, sf).select(
        "match_id", S.round_half_even("home_raw").alias("home_pred"), S.round_half_even("away_raw").alias("away_pred")
    )
    goals = td.matches(spark, sf).select("match_id", "fthg", "ftag")
    return J.keyed_attach(p, goals, key="match_id")


@query(
    "j6_anti_split",
    with_views(
        "select m.* from matches m where not exists (select 1 from fixtures f where f.result is null and f.match_number = m.match_id)",
        "matches", "fixtures",
    ),
)
def j6(spark, sf):
    m = td.matches(spark, sf)
    unplayed = P.filter_unplayed(td.fixtures(spark, sf)).select(F.col("match_number").alias("match_id"))
    return J.anti_split(m, unplayed, key="match_id")


# ------------------------------------------------------------------- sets
@query(
    "u1_union_by_name",
    with_views(
        "select match_id, match_date, season, home_team, away_team, fthg, ftag, ftr, "
        "cast(null as bigint) as match_number, cast(null as bigint) as round_number, cast(null as varchar) as date_text, "
        "cast(null as varchar) as location, cast(null as varchar) as result from matches "
        "union all select null, null, season, home_team, away_team, null, null, null, match_number, round_number, "
        "date_text, location, result from fixtures",
        "matches", "fixtures",
    ),
)
def u1(spark, sf):
    return U.union_by_name(td.matches(spark, sf), td.fixtures(spark, sf))


@query("u2_distinct_rows", with_views("select distinct season, home_team, away_team, ftr from matches", "matches"))
def u2(spark, sf):
    return U.distinct_rows(td.matches(spark, sf).select("season", "home_team", "away_team", "ftr"))


@query(
    "u3_refresh_partition",
    with_views(
        f"select distinct * from (select * from matches where season <> '{REFRESH_SEASON}' "
        f"union all select * from matches where season = '{REFRESH_SEASON}' "
        f"union all select * from matches where season = '{REFRESH_SEASON}')",
        "matches",
    ),
)
def u3(spark, sf):
    m = td.matches(spark, sf)
    new = m.filter(F.col("season") == REFRESH_SEASON)
    return U.refresh_partition(m, new.unionByName(new), season=REFRESH_SEASON)


@query(
    "u4_append_fixtures",
    with_views(
        """
select season, date_text, home_team, away_team, fthg, ftag, ftr, match_id from (
  select *, row_number() over (partition by season, date_text, home_team, away_team order by src, match_id) as rn from (
    select season, date_text, home_team, away_team, fthg, ftag, ftr, match_id, 0 as src from raw_matches r
    where not exists (select 1 from fixtures f where f.result is null and f.match_number = r.match_id)
    union all
    select season, substr(date_text, 1, 10), home_team, away_team, 0, 0, 'D', match_number, 1 from fixtures where result is null))
where rn = 1""",
        "raw_matches", "fixtures",
    ),
)
def u4(spark, sf):
    raw = td.raw_matches(spark, sf).select("season", "date_text", "home_team", "away_team", "fthg", "ftag", "ftr",
                                           "match_id")
    fx = td.fixtures(spark, sf).withColumnRenamed("match_number", "match_id")
    played = J.anti_split(raw, P.filter_unplayed(fx), key="match_id")
    out = U.append_fixtures(played, fx, seq_col="match_id")
    return out.select("season", "date_text", "home_team", "away_team", "fthg", "ftag", "ftr", "match_id")


@query(
    "u5_home_away_stack",
    with_views(
        "select match_id, home_team as team, cast(round_even(home_raw, 0) as bigint) as value, 'H' as side "
        "from predictions p join matches m using (match_id) "
        "union all select match_id, away_team, cast(round_even(away_raw, 0) as bigint), 'A' "
        "from predictions p join matches m using (match_id)",
        "predictions", "matches",
    ),
)
def u5(spark, sf):
    p = td.predictions(spark, sf).join(td.matches(spark, sf).select("match_id", "home_team", "away_team"), "match_id")
    p = p.select("match_id", "home_team", "away_team", S.round_half_even("home_raw").alias("h"),
                 S.round_half_even("away_raw").alias("a"))
    return U.home_away_stack(p, home="home_team", away="away_team", home_value="h", away_value="a", keys=["match_id"])


@query(
    "w16_dedupe_keep_first",
    with_views(
        "select * exclude (rn) from (select *, row_number() over (partition by season, home_team, away_team "
        "order by match_date, match_id) as rn from matches) where rn = 1",
        "matches",
    ),
)
def w16(spark, sf):
    return U.dedupe_keep_first(td.matches(spark, sf), ["season", "home_team", "away_team"], ["match_date", "match_id"])


# --------------------------------------------------------------- ordering
@query(
    "t1_next_fixtures",
    with_views(
        f"""
select match_id, home_team, away_team, fixture_date, fixture_time, home_team || ' v ' || away_team as fixture
from (select b.match_id, b.home_team, b.away_team,
        cast(strptime(substr(f.date_text, 1, 10), '%d/%m/%Y') as date) as fixture_date,
        cast(cast(substr(f.date_text, 12, 2) as int) as varchar) || substr(f.date_text, 14, 3) as fixture_time
      from matches b join fixtures f on f.season = b.season and f.home_team = b.home_team
        and f.away_team = b.away_team and f.match_number = b.match_id where f.result is null)
where fixture_date >= date '{AS_OF}'
order by fixture_date, fixture_time, match_id limit 12""",
        "matches", "fixtures",
    ),
)
def t1(spark, sf):
    # the report pairs fixtures with match rows; no feature column is read
    st = td.matches(spark, sf).select("match_id", "season", "home_team", "away_team")
    fx = P.filter_unplayed(td.fixtures(spark, sf)).drop("result").withColumnRenamed("match_number", "match_id")
    cur = J.fixture_join(st, fx, on=["season", "home_team", "away_team", "match_id"]).select(
        "match_id", "home_team", "away_team",
        F.to_date(S.fixture_date_text("date_text"), "dd/MM/yyyy").alias("fixture_date"),
        S.fixture_time("date_text").alias("fixture_time"),
        S.fixture_label("home_team", "away_team").alias("fixture"),
    )
    return O.next_fixtures(cur, as_of=AS_OF, date_col="fixture_date", time_text_col="fixture_time", tie="match_id")


@query(
    "t2_trim_multiple",
    with_views(
        "select match_id, season from (select *, row_number() over (partition by season order by match_date, match_id) as rn, "
        "count(*) over (partition by season) as n from matches) where rn <= n - n % 20",
        "matches",
    ),
)
def t2(spark, sf):
    m = td.matches(spark, sf)
    return O.trim_multiple(m, keys=["season"], order=["match_date", "match_id"]).select("match_id", "season")


_IMPORTANCE_SQL = "select feature, round(avg(abs(contribution)), 2) as importance from attributions group by feature"


def _importances(spark, sf):
    a = td.attributions(spark, sf)
    return a.groupBy("feature").agg(F.round(F.avg(F.abs("contribution")), 2).alias("importance"))


@query(
    "w14_rank_average",
    with_views(
        "select feature, importance, rank() over (order by importance desc) + (count(*) over (partition by importance) - 1) / 2.0 as rank "
        f"from ({_IMPORTANCE_SQL})",
        "attributions",
    ),
)
def w14(spark, sf):
    return O.rank_average(_importances(spark, sf), "importance")


@query(
    "t3_top_features",
    with_views(
        f"""
select feature, importance, rank,
  case when hi = lo then 0.0 else (importance - lo) / (hi - lo) * 100.0 end as scaled
from (select *, min(importance) over () as lo, max(importance) over () as hi from (
  select * from (select feature, importance,
      rank() over (order by importance desc) + (count(*) over (partition by importance) - 1) / 2.0 as rank
    from ({_IMPORTANCE_SQL})) where feature <> 'f0' order by rank, feature limit 10))""",
        "attributions",
    ),
)
def t3(spark, sf):
    return O.top_features(_importances(spark, sf), exclude=["f0"], n=10)


@query(
    "t4_top3_per_row",
    with_views(
        """
select row_id, max(case when rn = 1 then feature end) as top1, max(case when rn = 2 then feature end) as top2,
  max(case when rn = 3 then feature end) as top3
from (select row_id, feature, row_number() over (partition by row_id order by contribution desc, pos asc) as rn
      from attributions) where rn <= 3 group by row_id""",
        "attributions",
    ),
)
def t4(spark, sf):
    return O.top3_per_row(td.attributions(spark, sf))


@query("t5_sort_keys", with_views("select * from matches order by season, home_team, match_date, match_id", "matches"))
def t5(spark, sf):
    return O.sort_keys(td.matches(spark, sf), ["season", "home_team", "match_date", "match_id"])


def _w15_sql(where: str = "true") -> str:
    return with_views(
        "select season, team, match_id, match_date, opponent, venue, gf, ga, res, games_back from (select *, "
        f"row_number() over (partition by team order by match_date desc, match_id desc) as games_back from tr where {where}) where games_back <= 5",
        "tr",
    )


@query("w15_last_n_per_team", _w15_sql())
def w15(spark, sf):
    return O.last_n_per_team(td.matches(spark, sf))


@query("w15_last_n_before", _w15_sql("match_date < date '1996-06-01'"))
def w15_before(spark, sf):
    return O.last_n_per_team(td.matches(spark, sf), before="1996-06-01")


# ---------------------------------------------------------------- scalars
@query(
    "f1_parse_match_date",
    with_views(
        "select match_id, date_text, cast(case when length(date_text) < 10 then strptime(date_text, '%d/%m/%y') "
        "else strptime(date_text, '%d/%m/%Y') end as date) as parsed from raw_matches",
        "raw_matches",
    ),
)
def f1(spark, sf):
    r = td.raw_matches(spark, sf)
    return r.select("match_id", "date_text", S.parse_match_date("date_text").alias("parsed"))


@query(
    "f2_date_parts",
    with_views(
        "select match_id, strftime(match_date, '%A') as day_name, strftime(match_date, '%B') as month_name, "
        "cast(day(match_date) as bigint) as day_of_month from matches",
        "matches",
    ),
)
def f2(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", S.weekday_name("match_date").alias("day_name"),
                    S.month_name("match_date").alias("month_name"), S.day_of_month("match_date").alias("day_of_month"))


@query(
    "f3_season_from_date",
    with_views("select match_id, season as derived_season from matches", "matches"),
)
def f3(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", S.season_from_date("match_date").alias("derived_season"))


@query(
    "f4_season_code",
    with_views(
        "select match_id, case when month(match_date) < 8 then lpad(cast((year(match_date) - 1) % 100 as varchar), 2, '0') "
        "|| lpad(cast(year(match_date) % 100 as varchar), 2, '0') else lpad(cast(year(match_date) % 100 as varchar), 2, '0') "
        "|| lpad(cast((year(match_date) + 1) % 100 as varchar), 2, '0') end as code from matches",
        "matches",
    ),
)
def f4(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", S.season_code("match_date").alias("code"))


@query(
    "f5_season_years",
    with_views(
        "select distinct season, cast(substr(season, 1, 4) as bigint) as start_year, "
        "cast(substr(season, 1, 2) || substr(season, 6, 2) as bigint) as end_year_literal, "
        "cast(substr(season, 1, 4) as bigint) + 1 as end_year from matches",
        "matches",
    ),
)
def f5(spark, sf):
    m = td.matches(spark, sf).select("season").distinct()
    return m.select("season", S.season_start_year("season").alias("start_year"),
                    S.season_end_year("season").alias("end_year_literal"),
                    S.season_end_year("season", literal=False).alias("end_year"))


@query(
    "f6_rebuild_date",
    with_views(
        "select match_id, match_date, cast(try_strptime(strftime(match_date, '%B') || '/' || cast(day(match_date) as varchar) "
        "|| '/' || cast(case when month(match_date) >= 8 then cast(substr(season, 1, 4) as int) "
        "else cast(substr(season, 1, 4) as int) + 1 end as varchar), '%B/%d/%Y') as date) as rebuilt from matches",
        "matches",
    ),
)
def f6(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", "match_date", S.rebuild_date(S.month_name("match_date"), S.day_of_month("match_date"),
                                                              "season", literal_end_year=False).alias("rebuilt"))


@query(
    "f7_fixture_time",
    with_views(
        "select match_number, substr(date_text, 1, 10) as fixture_date_text, "
        "cast(cast(substr(date_text, 12, 2) as int) as varchar) || substr(date_text, 14, 3) as fixture_time from fixtures",
        "fixtures",
    ),
)
def f7(spark, sf):
    fx = td.fixtures(spark, sf)
    return fx.select("match_number", S.fixture_date_text("date_text").alias("fixture_date_text"),
                     S.fixture_time("date_text").alias("fixture_time"))


@query(
    "f8_fixture_label",
    with_views(
        "select match_id, home_team || ' v ' || away_team as fixture, home_team as home_back, away_team as away_back "
        "from matches",
        "matches",
    ),
)
def f8(spark, sf):
    m = td.matches(spark, sf).select("match_id", S.fixture_label("home_team", "away_team").alias("fixture"))
    h, a = S.split_label("fixture")
    return m.select("match_id", "fixture", h.alias("home_back"), a.alias("away_back"))


def _ord_sql(d: str) -> str:
    return (
        f"cast({d} as varchar) || case when ({d} between 4 and 20) or ({d} between 24 and 30) then 'th' "
        f"when {d} % 10 = 1 then 'st' when {d} % 10 = 2 then 'nd' else 'rd' end"
    )


_ORD_SQL = _ord_sql("d")


@query(
    "f9_ordinal_day",
    with_views(f"select match_id, {_ORD_SQL} as day_label from (select match_id, day(match_date) as d from matches)",
               "matches"),
)
def f9(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", S.ordinal_day(F.dayofmonth("match_date")).alias("day_label"))


@query(
    "f10_pad_left_max",
    with_views(
        "select match_number, lpad(location, cast((select max(length(location)) from fixtures) as integer), ' ') as padded from fixtures",
        "fixtures",
    ),
)
def f10(spark, sf):
    fx = td.fixtures(spark, sf).select("match_number", "location")
    width = fx.agg(F.max(F.length("location"))).scalar()  # A9 as a scalar subquery
    return fx.select("match_number", S.pad_left("location", width).alias("padded"))


@query(
    "f11_score_label",
    with_views(
        "select match_id, cast(fthg as varchar) || '-' || cast(ftag as varchar) as score, "
        f"strftime(match_date, '%A') || ' ' || {_ord_sql('day(match_date)')} "
        "|| ' ' || strftime(match_date, '%B') as display_date from matches",
        "matches",
    ),
)
def f11(spark, sf):
    m = td.matches(spark, sf)
    return m.select("match_id", S.score_label("fthg", "ftag").alias("score"),
                    S.display_date(S.weekday_name("match_date"), F.dayofmonth("match_date"),
                                   S.month_name("match_date")).alias("display_date"))


@query(
    "f12_result_phrase",
    with_views(
        "select match_id, team, case when venue = 'H' then (case ftr when 'H' then 'Win' when 'D' then 'Draw' else 'Loss' end) "
        "else (case ftr when 'H' then 'Loss' when 'D' then 'Draw' else 'Win' end) end || ' v ' || opponent || ' (' || venue || ')' as phrase "
        "from (select t.*, m.ftr from tr t join matches m using (match_id))",
        "tr", "matches",
    ),
)
def f12(spark, sf):
    m = td.matches(spark, sf)
    tg = team_games(m).select("match_id", "team")
    code = F.when(F.col("ftr") == "H", 0).when(F.col("ftr") == "D", 1).otherwise(2)
    j = tg.join(m.select("match_id", "home_team", "away_team", code.alias("code")), "match_id")
    return j.select("match_id", "team", S.result_phrase("team", "home_team", "away_team", "code").alias("phrase"))


@query(
    "f13_result_from_scores",
    with_views(
        "select match_id, case when round_even(home_raw, 0) > round_even(away_raw, 0) then 'H' "
        "when round_even(home_raw, 0) < round_even(away_raw, 0) then 'A' else 'D' end as result_prediction from predictions",
        "predictions",
    ),
)
def f13(spark, sf):
    p = td.predictions(spark, sf)
    return p.select("match_id", S.result_from_scores(S.round_half_even("home_raw"), S.round_half_even("away_raw"))
                    .alias("result_prediction"))


@query(
    "f14_round_half_even",
    with_views(
        "select match_id, cast(round_even(home_raw, 0) as bigint) as home_pred, "
        "cast(round_even(away_raw, 0) as bigint) as away_pred from predictions",
        "predictions",
    ),
)
def f14(spark, sf):
    p = td.predictions(spark, sf)
    return p.select("match_id", S.round_half_even("home_raw").alias("home_pred"),
                    S.round_half_even("away_raw").alias("away_pred"))


@query(
    "f15_colour_map",
    with_views(
        "select match_id, team, case split_part(w, ' ', 1) when 'Loss' then 'red' when 'Draw' then 'orange' "
        "when 'Win' then 'green' else 'gray' end as colour from (select match_id, team, case res when 'W' then 'Win v x' "
        "when 'D' then 'Draw v x' else 'Loss v x' end as w from tr)",
        "tr",
    ),
)
def f15(spark, sf):
    tg = team_games(td.matches(spark, sf))
    word = F.when(F.col("res") == "W", "Win v x").when(F.col("res") == "D", "Draw v x").otherwise("Loss v x")
    return tg.select("match_id", "team", S.colour_of(word).alias("colour"))


@query(
    "f16_thousands",
    with_views("select location, format('{:,}', capacity) as capacity_text from locations", "locations"),
)
def f16(spark, sf):
    loc = td.locations(spark, sf)
    return loc.select("location", S.thousands("capacity").alias("capacity_text"))


@query(
    "f17_map_merge",
    with_views(
        "select run_id, 3 as n_keys, cast(mean_ae as varchar) as mean_ae_value, model_type as type_value, "
        "cast(run_id as varchar) as run_id_value from model_runs",
        "model_runs",
    ),
)
def f17(spark, sf):
    r = td.model_runs(spark, sf)
    params = F.create_map(F.lit("model_type"), F.col("model_type"), F.lit("mean_ae"), F.lit("stale"))
    metrics = F.create_map(F.lit("mean_ae"), F.col("mean_ae").cast("string"))
    tags = F.create_map(F.lit("run_id"), F.col("run_id").cast("string"))
    merged = S.merge_maps(params, metrics, tags)
    return r.select("run_id", merged.alias("m")).select(
        "run_id", F.size("m").alias("n_keys"), F.col("m")["mean_ae"].alias("mean_ae_value"),
        F.col("m")["model_type"].alias("type_value"), F.col("m")["run_id"].alias("run_id_value"),
    )


@query(
    "f19_timestamp_text",
    "select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts_text from events",
)
def f19(spark, sf):
    e = td.table(spark, sf, "events")
    return e.select("event_id", S.timestamp_text("ts").alias("ts_text"))
