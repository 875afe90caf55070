"""Queries for aggregates (A1-A9), data quality (DQ1-DQ9), drift (DR1-DR6),
evaluation (EV1-EV3) and the map-to-columns function (F18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rivalry.catalog import query
from rivalry.functions import scalars as S
from rivalry.operators import aggregates as A
from rivalry.operators import drift as D
from rivalry.operators import evaluate as EV
from rivalry.operators import quality as Q
from rivalry.oracle_views import with_views
from rivalry.sources import testdata as td

# drift_rows columns: (name, spark type, numeric)
DRIFT_COLS = [("part", "string", False), ("num_col", "double", True), ("cat_col", "string", False),
              ("flag_col", "int", True)]


def _profile_sql(view: str, where: str = "") -> str:
    parts = []
    w = f" where {where}" if where else ""
    for pos, (c, t, num) in enumerate(DRIFT_COLS):
        mn = f"cast(min({c}) as double)" if num else "cast(null as double)"
        mx = f"cast(max({c}) as double)" if num else "cast(null as double)"
        parts.append(
            f"select '{c}' as \"column\", cast({pos} as bigint) as position, '{t}' as type_name, {str(num).lower()} as is_numeric, "
            f"count(*) as n_rows, count(*) - count({c}) as nulls, {mn} as min_value, {mx} as max_value, "
            f"count({c}) as non_null, case when count(*) > 0 then round((count(*) - count({c})) / count(*), 3) else 0.0 end as null_frac, "
            f"count(distinct {c}) as distinct_count, case when count(distinct {c}) <= 100 then "
            f"array_to_string(list_sort(list(distinct cast({c} as varchar))), ',') end as value_set "
            f"from {view}{w}"
        )
    return " union all ".join(parts)


def _rules_sql(view: str, where: str = "") -> str:
    prof = f"({_profile_sql(view, where)})"
    cols = ",".join(c for c, _, _ in DRIFT_COLS)
    nd, ns = "cast(null as double)", "cast(null as varchar)"
    return f"""
select cast(0 as bigint) as rule_id, 'columns_match_set' as rule_type, {ns} as "column", {ns} as type_name,
  {nd} as mostly, {nd} as min_value, {nd} as max_value, '{cols}' as value_set
union all select (position + 1) * 10 + 1, 'column_type', "column", type_name, {nd}, {nd}, {nd}, {ns} from {prof}
union all select (position + 1) * 10 + 2, 'null_fraction', "column", {ns},
  case when null_frac > 0.1 then null_frac - 0.1 else 0.0 end, {nd}, {nd}, {ns} from {prof}
union all select (position + 1) * 10 + 3, 'between', "column", {ns}, {nd},
  min_value - (max_value - min_value) * 0.1, max_value + (max_value - min_value) * 0.1, {ns}
  from {prof} where is_numeric and non_null > 0
union all select (position + 1) * 10 + 4, 'in_set', "column", {ns}, {nd}, {nd}, {nd},
  case when not is_numeric then value_set else '0,1' end from {prof}
  where (not is_numeric and value_set is not null and distinct_count <= 10)
     or (is_numeric and distinct_count = 2 and nulls = 0 and min_value = 0 and max_value = 1)"""


REF = "part = 'reference'"
CUR = "part <> 'reference'"


def _validate_sql() -> str:
    rules = f"({_rules_sql('drift_rows', REF)})"
    per_rule = []
    for c, _, num in DRIFT_COLS:
        between = (
            f"when 'between' then (select count(*) from drift_rows where {CUR} and {c} is not null "
            f"and ({c} < r.min_value or {c} > r.max_value)) " if num else ""
        )
        per_rule.append(
            f"select r.rule_id, r.rule_type, r.\"column\", n.n as element_count, "
            f"case r.rule_type when 'null_fraction' then n.nn_{c} "
            + between +
            f"when 'in_set' then (select count(*) from drift_rows where {CUR} and {c} is not null and not list_contains(string_split(r.value_set, ','), cast({c} as varchar))) "
            f"else 0 end as unexpected_count, "
            f"case r.rule_type when 'null_fraction' then (case when n.n > 0 then n.nulls_{c} / n.n else 1.0 end) >= r.mostly - 1e-12 "
            f"else null end as null_ok "
            f"from {rules} r, (select count(*) as n, "
            + ", ".join(f"count(*) - count({x}) as nulls_{x}, count({x}) as nn_{x}" for x, _, _ in DRIFT_COLS)
            + f" from drift_rows where {CUR}) n where r.\"column\" = '{c}' "
            "and r.rule_type in ('null_fraction', 'between', 'in_set')"
        )
    meta = (
        f"select rule_id, rule_type, \"column\", (select count(*) from drift_rows where {CUR}) as element_count, "
        f"0 as unexpected_count, true as null_ok from {rules} where rule_type in ('columns_match_set', 'column_type')"
    )
    body = " union all ".join(per_rule)
    return (
        "select rule_id, rule_type, \"column\", case when rule_type = 'null_fraction' then null_ok "
        "when rule_type in ('columns_match_set', 'column_type') then true else unexpected_count = 0 end as success, "
        "cast(element_count as bigint) as element_count, cast(unexpected_count as bigint) as unexpected_count "
        f"from ({body} union all {meta})"
    )


def _drift(spark, sf):
    return td.drift_rows(spark, sf)


def _ref_rules(spark, sf):
    d = _drift(spark, sf)
    return Q.generate_rules(Q.profile(d.filter(F.col("part") == "reference")))


def _joined(rules):
    """Rules or a profile with the value set as text, for the value check."""
    return rules.withColumn("value_set", F.array_join("value_set", ","))


def _validated(spark, sf):
    d = _drift(spark, sf)
    return Q.validate(d.filter(F.col("part") != "reference"), _ref_rules(spark, sf))


# ------------------------------------------------------------- profiles
@query("a6_column_profile", with_views(_profile_sql("drift_rows"), "drift_rows"))
def a6(spark, sf):
    return _joined(Q.profile(_drift(spark, sf), exact=True))


@query(
    "a6_sketched_profile",
    with_views(
        "select * exclude (distinct_count), case when distinct_count <= 100 then distinct_count end as distinct_count "
        f"from ({_profile_sql('drift_rows')})",
        "drift_rows",
    ),
)
def a6_sketched(spark, sf):
    """The profile by sketches; estimates, which SQL cannot repeat, are left out."""
    known = F.when(F.col("distinct_count") <= 100, F.col("distinct_count"))
    return _joined(Q.profile(_drift(spark, sf))).withColumn("distinct_count", known)


@query("dq1_generate_rules", with_views(_rules_sql("drift_rows", REF), "drift_rows"))
def dq1(spark, sf):
    return _joined(_ref_rules(spark, sf))


# rows that rules are made from, and rows that keep some and break others: a
# comma inside a value, a flag stored as a double, NaNs as missing values
_KEPT = """(select part, num_col, case when cat_col = 'A' then 'a,b' else lower(cat_col) end as txt, cast(flag_col as double) as flag,
  case when num_col > 25 then null else num_col end as gap from drift_rows where part = 'reference')"""
_CHANGED = """(select part, num_col * 2 as num_col, case when num_col > 40 then 'x,y' when cat_col = 'A' then 'a,b' else lower(cat_col) end as txt,
  case when num_col > 48 then 0.5 else cast(flag_col as double) end as flag, case when num_col > 45 then null else num_col end as gap
  from drift_rows where part <> 'reference')"""
_POSITION = {"part": 0, "num_col": 1, "txt": 2, "flag": 3, "gap": 4}


def _kept_and_changed(spark, sf):
    d = _drift(spark, sf)
    txt = F.when(F.col("cat_col") == "A", "a,b").otherwise(F.lower("cat_col"))
    flag, n, nan = F.col("flag_col").cast("double"), F.col("num_col"), F.lit(float("nan"))
    kept = d.filter("part = 'reference'").select("part", "num_col", txt.alias("txt"), flag.alias("flag"), F.when(n > 25, nan).otherwise(n).alias("gap"))
    changed = d.filter("part <> 'reference'").select(
        "part", (n * 2).alias("num_col"), F.when(n > 40, "x,y").otherwise(txt).alias("txt"), F.when(n > 48, 0.5).otherwise(flag).alias("flag"),
        F.when(n > 45, nan).otherwise(n).alias("gap"))
    return kept, changed


def _evaluate(spark, sf, kind: str, change=lambda df: df, only=None):
    """The rules of one kind, made from the kept rows, on both."""
    kept, changed = _kept_and_changed(spark, sf)
    rules = Q.generate_rules(Q.profile(kept)).filter(F.col("rule_type") == kind)
    if only:
        rules = rules.filter(F.col("column").isin(only))
    return Q.validate(kept, rules).withColumn("data", F.lit("kept")).unionByName(
        Q.validate(change(changed), rules).withColumn("data", F.lit("changed")))


def _results_sql(kind: str, order: int, columns, unexpected: str, ok: str) -> str:
    """One row per column and data set; ``{c}`` is the column, ``{x}`` its rule's facts."""
    rows = []
    for name, frame in (("kept", _KEPT), ("changed", _CHANGED)):
        for c in columns:
            facts = f"(select min({c}) as lo, max({c}) as hi, round((count(*) - count({c})) / count(*), 3) as nf from {_KEPT})"
            cells = {"c": c, "data": name}
            rows.append(
                f"select cast({(_POSITION[c] + 1) * 10 + order} as bigint) as rule_id, '{kind}' as rule_type, '{c}' as \"column\", "
                f"{ok.format(**cells)} as success, count(*) as element_count, cast({unexpected.format(**cells)} as bigint) as unexpected_count, '{name}' as data "
                f"from {frame} d, {facts} f group by f.lo, f.hi, f.nf")
    return with_views(" union all ".join(rows), "drift_rows")


@query("dq2_columns_match_set", with_views(
    f"select cast(0 as bigint) as rule_id, 'columns_match_set' as rule_type, cast(null as varchar) as \"column\", true as success, count(*) as element_count, "
    f"cast(0 as bigint) as unexpected_count, 'kept' as data from {_KEPT} union all "
    f"select 0, 'columns_match_set', null, false, count(*), 0, 'changed' from {_CHANGED}", "drift_rows"))
def dq2(spark, sf):
    """The changed rows lack a column."""
    return _evaluate(spark, sf, "columns_match_set", lambda df: df.drop("gap"))


@query("dq3_column_type", _results_sql("column_type", 1, _POSITION, "0", "'{data}' = 'kept' or '{c}' <> 'flag'"))
def dq3(spark, sf):
    """The changed rows have another type in one column."""
    return _evaluate(spark, sf, "column_type", lambda df: df.withColumn("flag", F.col("flag").cast("int")))


@query("dq4_null_fraction", _results_sql(
    "null_fraction", 2, _POSITION, "count(d.{c})",
    "(count(*) - count(d.{c})) / count(*) >= case when f.nf > 0.1 then f.nf - 0.1 else 0 end - 1e-12"))
def dq4(spark, sf):
    return _evaluate(spark, sf, "null_fraction")


_OUTSIDE = "sum(case when d.{c} < f.lo - (f.hi - f.lo) * 0.1 or d.{c} > f.hi + (f.hi - f.lo) * 0.1 then 1 else 0 end)"


@query("dq5_numeric_range", _results_sql("between", 3, ["num_col", "flag", "gap"], _OUTSIDE, _OUTSIDE + " = 0"))
def dq5(spark, sf):
    return _evaluate(spark, sf, "between")


def _outside_set(frame: str) -> str:
    return f"sum(case when d.{{c}} not in (select {{c}} from {frame} where {{c}} is not null) then 1 else 0 end)"


@query("dq6_value_set_text", _results_sql("in_set", 4, ["part", "txt"], _outside_set(_KEPT), _outside_set(_KEPT) + " = 0"))
def dq6(spark, sf):
    return _evaluate(spark, sf, "in_set", only=["part", "txt"])


@query("dq7_value_set_flag", _results_sql("in_set", 4, ["flag"], "sum(case when d.flag not in (0, 1) then 1 else 0 end)",
                                          "sum(case when d.flag not in (0, 1) then 1 else 0 end) = 0"))
def dq7(spark, sf):
    return _evaluate(spark, sf, "in_set", only=["flag"])


@query("dq8_validate", with_views(_validate_sql(), "drift_rows"))
def dq8(spark, sf):
    return _validated(spark, sf)


@query(
    "dq8_validation_summary",
    with_views(
        "select count(*) as evaluated, cast(sum(case when success then 1 else 0 end) as bigint) as successful, "
        "cast(sum(case when success then 0 else 1 end) as bigint) as unsuccessful, "
        f"sum(case when success then 1 else 0 end) / count(*) * 100.0 as success_percent from ({_validate_sql()})",
        "drift_rows",
    ),
)
def dq8s(spark, sf):
    return Q.validation_summary(_validated(spark, sf))


@query(
    "dq9_alerts",
    with_views(
        "select 'Red' as level, 'validation' as kind, \"column\" as subject, "
        "'validation check failed for ' || coalesce(\"column\", 'table') as message "
        f"from ({_validate_sql()}) where not success",
        "drift_rows",
    ),
)
def dq9(spark, sf):
    return Q.alerts(_validated(spark, sf), kind="validation")


@query(
    "a7_suite_summary",
    with_views(
        f"select rule_type, count(*) as n_rules from ({_rules_sql('drift_rows', REF)}) group by rule_type "
        f"union all select 'total', count(*) from ({_rules_sql('drift_rows', REF)})",
        "drift_rows",
    ),
)
def a7(spark, sf):
    return Q.suite_summary(_ref_rules(spark, sf))


# ------------------------------------------------------------ aggregates
@query(
    "a1_count_by_value",
    with_views(
        "select 'home' as side, diff, count(season) as n from (select p.season, cast(round_even(home_raw, 0) as bigint) - p.fthg as diff "
        "from predictions p) where diff is not null group by diff "
        "union all select 'away', diff, count(season) from (select p.season, cast(round_even(away_raw, 0) as bigint) - p.ftag as diff "
        "from predictions p) where diff is not null group by diff",
        "predictions",
    ),
)
def a1(spark, sf):
    p = td.predictions(spark, sf)
    h = p.select("season", (S.round_half_even("home_raw") - F.col("fthg")).alias("diff"))
    a = p.select("season", (S.round_half_even("away_raw") - F.col("ftag")).alias("diff"))
    return A.count_by_value(h, "diff", counted="season").select(F.lit("home").alias("side"), "diff", "n").unionByName(
        A.count_by_value(a, "diff", counted="season").select(F.lit("away").alias("side"), "diff", "n")
    )


_BEST_SQL = (
    "select * exclude (rn) from (select *, row_number() over (partition by run_date, model_type "
    "order by mean_ae, run_id) as rn from model_runs) where rn = 1"
)


@query("a2_best_per_group", with_views(_BEST_SQL, "model_runs"))
def a2(spark, sf):
    return A.best_per_group(td.model_runs(spark, sf), ["run_date", "model_type"], "mean_ae", "run_id")


@query(
    "a3_pivot_metric",
    with_views(
        "select run_date, max(case when model_type = 'home' then mean_ae end) as home, "
        f"max(case when model_type = 'away' then mean_ae end) as away from ({_BEST_SQL}) group by run_date",
        "model_runs",
    ),
)
def a3(spark, sf):
    best = A.best_per_group(td.model_runs(spark, sf), ["run_date", "model_type"], "mean_ae", "run_id")
    return A.pivot_metric(best, "run_date", "model_type", ["home", "away"], "mean_ae")


@query(
    "a4_value_counts",
    with_views("select location, count(*) as n from fixtures where location is not null group by location", "fixtures"),
)
def a4(spark, sf):
    return A.value_counts(td.fixtures(spark, sf), "location")


@query("a5_distinct_values", with_views("select distinct result from fixtures", "fixtures"))
def a5(spark, sf):
    return A.distinct_values(td.fixtures(spark, sf), "result")


@query(
    "a8_confusion_matrix",
    with_views(
        "select l1.l as actual, l2.l as predicted, cast(coalesce(c.n, 0) as bigint) as n "
        "from (select distinct actual_class as l from predictions union select distinct predicted_class from predictions) l1 "
        "join (select distinct actual_class as l from predictions union select distinct predicted_class from predictions) l2 on true "
        "left join (select actual_class, predicted_class, count(*) as n from predictions group by 1, 2) c "
        "on c.actual_class = l1.l and c.predicted_class = l2.l",
        "predictions",
    ),
)
def a8(spark, sf):
    return A.confusion_matrix(td.predictions(spark, sf), "actual_class", "predicted_class")


@query("a9_max_len", with_views("select cast(max(length(location)) as bigint) as max_len from fixtures", "fixtures"))
def a9(spark, sf):
    return A.max_len(td.fixtures(spark, sf), "location")


# ------------------------------------------------------------ evaluation
_CLASS_CTES = [
    ("cells", "select actual_class as a, predicted_class as p, count(*) as n from predictions group by 1, 2"),
    ("ks", "select a as k from cells union select p from cells"),
    ("per", """select ks.k, cast(coalesce((select sum(n) from cells where a = ks.k), 0) as double) as t,
  cast(coalesce((select sum(n) from cells where p = ks.k), 0) as double) as pp,
  cast(coalesce((select sum(n) from cells where a = ks.k and p = ks.k), 0) as double) as tp from ks"""),
    ("agg", """select sum(t) as s, sum(tp) as c,
  sum(t * case when t + pp > 0 then 2 * tp / (t + pp) else 0.0 end) as wf1,
  sum(pp * t) as pt, sum(pp * pp) as pp2, sum(t * t) as tt2 from per"""),
]


@query(
    "ev1_class_metrics",
    with_views(
        """select cast(s as bigint) as n, round(c / s, 9) as accuracy, round(wf1 / s, 9) as f1_weighted,
  round(case when (s * s - pp2) * (s * s - tt2) > 0 then (c * s - pt) / sqrt((s * s - pp2) * (s * s - tt2)) else 0.0 end, 9) as mcc
from agg""",
        "predictions",
        extra=_CLASS_CTES,
    ),
)
def ev1(spark, sf):
    out = EV.class_metrics(td.predictions(spark, sf), actual="actual_class", predicted="predicted_class")
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1_weighted", "mcc")])


@query(
    "ev2_regression_metrics",
    with_views(
        "select round(1 - sum((fthg - pred) * (fthg - pred)) / (sum(fthg * fthg) - sum(fthg) * sum(fthg) / count(*)), 9) as r2, "
        "round(cast(median(abs(fthg - pred)) as double), 9) as median_ae, round(avg(abs(fthg - pred)), 9) as mean_ae "
        "from (select fthg, cast(round_even(home_raw, 0) as bigint) as pred from predictions)",
        "predictions",
    ),
)
def ev2(spark, sf):
    p = td.predictions(spark, sf).select("fthg", S.round_half_even("home_raw").alias("pred"))
    out = EV.regression_metrics(p, actual="fthg", predicted="pred")
    return out.select(*[F.round(c, 9).alias(c) for c in ("r2", "median_ae", "mean_ae")])


def _runs(spark, sf):
    r = td.model_runs(spark, sf).withColumn("mean_ae_cents", F.round(F.col("mean_ae") * 100).cast("long"))
    return EV.run_log(r, run_id="run_id", params=["model_type"], metrics=["mean_ae_cents"], tags=["run_date"])


@query(
    "ev3_run_log",
    with_views(
        "select run_id, model_type, cast(cast(round(mean_ae * 100) as bigint) as varchar) as mean_ae_cents, "
        "cast(run_date as varchar) as run_date, cast(run_id as varchar) as run_id_text from model_runs",
        "model_runs",
    ),
)
def ev3(spark, sf):
    log = _runs(spark, sf)
    return EV.maps_to_columns(log, "all", ["model_type", "mean_ae_cents", "run_date"]).join(
        log.select("run_id", F.col("all")["run_id"].alias("run_id_text")), "run_id"
    )


@query(
    "f18_maps_to_columns",
    with_views(
        "select run_id, model_type, cast(cast(round(mean_ae * 100) as bigint) as varchar) as mean_ae_cents, "
        "cast(run_date as varchar) as run_date from model_runs",
        "model_runs",
    ),
)
def f18(spark, sf):
    log = _runs(spark, sf)
    merged = log.select("run_id", S.merge_maps("params", "metrics", "tags").alias("m"))
    return EV.maps_to_columns(merged, "m")


# ----------------------------------------------------------------- drift
_COUNTS = (
    "select {c} as value, sum(case when part = 'reference' then 1 else 0 end) as c_ref, "
    "sum(case when part <> 'reference' then 1 else 0 end) as c_cur from drift_rows where {c} is not null group by {c}"
)


def _ecdf_sql(c: str) -> str:
    return (
        f"select value, c_ref, c_cur, sum(c_ref) over (order by value) as cr, sum(c_cur) over (order by value) as cc, "
        f"lag(value) over (order by value) as prev, (select sum(c_ref) from ({_COUNTS.format(c=c)})) as n_ref, "
        f"(select sum(c_cur) from ({_COUNTS.format(c=c)})) as n_cur from ({_COUNTS.format(c=c)})"
    )


@query(
    "dr1_ks_statistic",
    with_views(
        f"select round(max(abs(cr / n_ref - cc / n_cur)), 9) as ks, cast(max(n_ref) as bigint) as n_ref, "
        f"cast(max(n_cur) as bigint) as n_cur from ({_ecdf_sql('num_col')})",
        "drift_rows",
    ),
)
def dr1(spark, sf):
    out = D.ks_statistic(_drift(spark, sf), "num_col")
    return out.select(F.round("ks", 9).alias("ks"), "n_ref", "n_cur")


def _shares_sql(c: str) -> str:
    return (
        f"select value, c_ref, c_cur, c_ref / n_ref as p, c_cur / n_cur as q, n_ref, n_cur from "
        f"(select *, sum(c_ref) over () as n_ref, sum(c_cur) over () as n_cur from ({_COUNTS.format(c=c)}))"
    )


@query(
    "dr2_chi_square",
    with_views(
        f"select round(sum(case when p > 0 then (c_cur - p * n_cur) * (c_cur - p * n_cur) / (p * n_cur) when c_cur > 0 then 'inf'::double else 0 end), 6) as chi2, "
        f"count(*) - 1 as dof from ({_shares_sql('cat_col')})",
        "drift_rows",
    ),
)
def dr2(spark, sf):
    out = D.chi_square(_drift(spark, sf), "cat_col")
    return out.select(F.round("chi2", 6).alias("chi2"), "dof")


@query(
    "dr3_z_proportion",
    with_views(
        """
select round(case when se > 0 then (x1 / n1 - x2 / n2) / se else 0.0 end, 9) as z, cast(n1 as bigint) as n_ref, cast(n2 as bigint) as n_cur
from (select *, sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) as se from (
  select sum(case when part = 'reference' then 1 else 0 end) as n1, sum(case when part <> 'reference' then 1 else 0 end) as n2,
    sum(case when part = 'reference' and flag_col = (select max(flag_col) from drift_rows) then 1.0 else 0.0 end) as x1,
    sum(case when part <> 'reference' and flag_col = (select max(flag_col) from drift_rows) then 1.0 else 0.0 end) as x2
  from drift_rows where flag_col is not null))""",
        "drift_rows",
    ),
)
def dr3(spark, sf):
    out = D.z_proportion(_drift(spark, sf), "flag_col")
    return out.select(F.round("z", 9).alias("z"), "n_ref", "n_cur")


_W_SQL = (
    "round(sum(case when prev is not null then abs((cr - c_ref) / n_ref - (cc - c_cur) / n_cur) * (value - prev) else 0.0 end) "
    "/ (select stddev_pop(num_col) from drift_rows where part = 'reference'), 9)"
)


@query(
    "dr4_wasserstein_normed",
    with_views(f"select {_W_SQL} as wasserstein from ({_ecdf_sql('num_col')})", "drift_rows"),
)
def dr4(spark, sf):
    out = D.wasserstein_normed(_drift(spark, sf), "num_col")
    return out.select(F.round("wasserstein", 9).alias("wasserstein"))


def _js_sql(c: str) -> str:
    return (
        "round(sqrt(greatest(0.0, 0.5 * sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0.0 end) "
        "+ 0.5 * sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0.0 end))), 9)"
    )


@query("dr5_js_distance", with_views(f"select {_js_sql('cat_col')} as js from ({_shares_sql('cat_col')})", "drift_rows"))
def dr5(spark, sf):
    out = D.js_distance(_drift(spark, sf), "cat_col")
    return out.select(F.round("js", 9).alias("js"))


_REPORT_ROWS = (
    f"select 'num_col' as \"column\", 'numeric' as kind, 'wasserstein' as test, (select {_W_SQL} from ({_ecdf_sql('num_col')})) as score "
    f"union all select 'cat_col', 'categorical', 'jensenshannon', (select {_js_sql('cat_col')} from ({_shares_sql('cat_col')})) "
    f"union all select 'flag_col', 'categorical', 'jensenshannon', (select {_js_sql('flag_col')} from ({_shares_sql('flag_col')}))"
)


def _with_summary(rows: str, threshold: str) -> str:
    """Report rows (column, kind, test, score, drifted) with the data set's."""
    return (
        f"select \"column\", kind, test, score, cast({threshold} as double) as threshold, drifted, cast(null as bigint) as n_drifted from ({rows}) "
        "union all select '__dataset__', 'dataset', 'share', round(sum(case when drifted then 1 else 0 end) / count(*), 9), "
        "cast(0.5 as double), sum(case when drifted then 1 else 0 end) / count(*) >= 0.5, "
        f"cast(sum(case when drifted then 1 else 0 end) as bigint) from ({rows})"
    )


def _report(d, **how):
    return D.drift_report(d, **how).drop("p_value").withColumn("score", F.round("score", 9))


@query("dr6_drift_report", with_views(_with_summary(f"select *, score >= 0.1 as drifted from ({_REPORT_ROWS})", "0.1"), "drift_rows"))
def dr6(spark, sf):
    return _report(_drift(spark, sf), regime="distances", categorical=["cat_col", "flag_col"])


# the p-value of a chi-square with two degrees of freedom is exp(-x / 2); z and the Kolmogorov function by their 5 % points
_TEST_ROWS = (
    f"select 'num_col' as \"column\", 'numeric' as kind, 'ks' as test, round(ks, 9) as score, "
    "(sqrt(n1 * n2 / (n1 + n2)) + 0.12 + 0.11 / sqrt(n1 * n2 / (n1 + n2))) * ks > 1.3581015157406196 as drifted "
    f"from (select max(abs(cr / n_ref - cc / n_cur)) as ks, cast(max(n_ref) as double) as n1, cast(max(n_cur) as double) as n2 from ({_ecdf_sql('num_col')})) "
    "union all select 'cat_col', 'categorical', 'chisquare', round(x, 9), exp(-x / 2) < 0.05 from "
    f"(select sum((c_cur - p * n_cur) * (c_cur - p * n_cur) / (p * n_cur)) as x from ({_shares_sql('cat_col')})) "
    "union all select 'flag_col', 'categorical', 'z', round(z, 9), abs(z) > 1.959963984540054 from (select (x1 / n1 - x2 / n2) / "
    "sqrt(((x1 + x2) / (n1 + n2)) * (1 - (x1 + x2) / (n1 + n2)) * (1.0 / n1 + 1.0 / n2)) as z from (select "
    "sum(case when part = 'reference' then 1.0 else 0 end) as n1, sum(case when part <> 'reference' then 1.0 else 0 end) as n2, "
    "sum(case when part = 'reference' then flag_col else 0 end) as x1, sum(case when part <> 'reference' then flag_col else 0 end) as x2 from drift_rows))"
)


@query("dr6_drift_report_tests", with_views(_with_summary(_TEST_ROWS, "0.05"), "drift_rows"))
def dr6_tests(spark, sf):
    return _report(_drift(spark, sf), regime="tests", categorical=["cat_col", "flag_col"], binary=["flag_col"])


_EDGE_ROWS = (
    "select 'const_col' as \"column\", 'numeric' as kind, 'wasserstein' as test, 0.0 as score, false as drifted "
    "union all select 'null_col', 'numeric', 'wasserstein', null, false "
    "union all select 'new_cat', 'categorical', 'jensenshannon', round(js, 9), js >= 0.1 from (select sqrt(greatest(0.0, "
    "0.5 * sum(case when p > 0 then p * ln(p / ((p + q) / 2)) else 0 end) + 0.5 * sum(case when q > 0 then q * ln(q / ((p + q) / 2)) else 0 end))) as js from "
    "(select sum(case when part = 'reference' then 1.0 else 0 end) / (select count(*) from drift_rows where part = 'reference') as p, "
    "sum(case when part <> 'reference' then 1.0 else 0 end) / (select count(*) from drift_rows where part <> 'reference') as q "
    "from (select part, case when part <> 'reference' and num_col > 25 then 'new' else cat_col end as v from drift_rows) group by v))"
)


@query("dr6_drift_report_edges", with_views(_with_summary(_EDGE_ROWS, "0.1"), "drift_rows"))
def dr6_edges(spark, sf):
    """A constant column, one without values, and a category the reference never had."""
    d = _drift(spark, sf)
    new = F.when((F.col("part") != "reference") & (F.col("num_col") > 25), "new").otherwise(F.col("cat_col"))
    return _report(d.select("part", F.lit(5.0).alias("const_col"), F.lit(None).cast("double").alias("null_col"), new.alias("new_cat")), regime="distances")


@query(
    "dq9_drift_alerts",
    with_views(
        "select 'Amber' as level, 'drift' as kind, \"column\" as subject, 'drift check failed for ' || \"column\" as message "
        f"from ({_TEST_ROWS} union all {_EDGE_ROWS}) where drifted",
        "drift_rows",
    ),
)
def dq9_drift(spark, sf):
    both = dr6_tests(spark, sf).unionByName(dr6_edges(spark, sf)).filter(F.col("column") != "__dataset__")
    # a drifted column is a failed check
    return Q.alerts(both.withColumn("ok", ~F.col("drifted")), kind="drift", ok_col="ok")
