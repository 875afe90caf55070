"""Column profile (A6), rule generation (DQ1-DQ7), validation (DQ8), suite
summary (A7) and alerts (DQ9).

The profile is two passes regardless of column count: one aggregate for
row/null counts, numeric min/max and a mergeable sketch of each column's
distinct values, and one distinct count over the (column, value) pairs of the
columns whose sketch is small. A high-cardinality column is neither shuffled
by its values (unless exact counts are asked for) nor gathered into one group. A NaN counts as a missing value throughout.
Value sets are arrays of text; on numeric columns they are compared as numbers.
Validation checks all rules in one aggregate pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.session import cut_lineage

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)

RULE_ORDER = {"columns_match_set": 0, "column_type": 1, "null_fraction": 2, "between": 3, "in_set": 4,
              "null_fraction_max": 5}


def _is_numeric(dt) -> bool:
    return isinstance(dt, _NUMERIC)


def _present(f: T.StructField) -> Column:
    """The column with NaN as NULL."""
    c = F.col(f.name)
    return F.when(~F.isnan(c), c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c


# registers of a distinct sketch as a power of two: a standard error of 1.6 %
_SKETCH = 12


def profile(df: DataFrame, *, set_limit: int = 100, exact: bool = False) -> DataFrame:
    """One row per column: ``column, position, type_name, is_numeric,
    n_rows, nulls (NaN included), null_frac (3 dp), non_null, min_value,
    max_value (numeric only), distinct_count (non-missing), value_set``
    (sorted distinct values as text, an array, when distinct_count <=
    ``set_limit``, else NULL). ``set_limit`` only bounds what the profile
    carries; which columns get a value-set rule is for
    :func:`generate_rules` to say.

    ``distinct_count`` is exact for a column that may be within ``set_limit``
    (its sketch estimates at most twice that) and the sketch's estimate for
    others; ``exact`` counts every column exactly, which shuffles all its
    values. Without ``exact`` the first pass runs when the profile is built."""
    fields = df.schema.fields
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.sum(_present(f).isNull().cast("long")).alias(f"nl{i}"))
        if _is_numeric(f.dataType):
            aggs.append(F.min(_present(f)).cast("double").alias(f"mn{i}"))
            aggs.append(F.max(_present(f)).cast("double").alias(f"mx{i}"))
        if not exact:
            sketch = F.hll_sketch_agg(_present(f).cast("string"), F.lit(_SKETCH))
            aggs.append(F.coalesce(F.hll_sketch_estimate(sketch), F.lit(0)).cast("long").alias(f"ds{i}"))
    one = df.agg(*aggs)
    counted = fields
    if not exact:
        one = cut_lineage(one)
        found = one.first()
        counted = [f for i, f in enumerate(fields) if found[f"ds{i}"] <= 2 * set_limit]
    per_col = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"), F.lit(i).cast("long").alias("position"),
                    F.lit(f.dataType.simpleString()).alias("type_name"),
                    F.lit(_is_numeric(f.dataType)).alias("is_numeric"),
                    F.col("n").alias("n_rows"), F.col(f"nl{i}").alias("nulls"),
                    (F.col(f"mn{i}") if _is_numeric(f.dataType) else F.lit(None).cast("double")).alias("min_value"),
                    (F.col(f"mx{i}") if _is_numeric(f.dataType) else F.lit(None).cast("double")).alias("max_value"),
                    # a counted column without a count has no value
                    (F.lit(0) if f in counted else F.col(f"ds{i}")).cast("long").alias("_estimate"),
                )
                for i, f in enumerate(fields)
            ]
        )
    )
    base = one.select(per_col.alias("c")).select("c.*")
    base = base.withColumn("non_null", F.col("n_rows") - F.col("nulls")).withColumn(
        "null_frac", F.when(F.col("n_rows") > 0, F.round(F.col("nulls") / F.col("n_rows"), 3)).otherwise(0.0)
    )
    if counted:
        pairs = df.select(
            F.explode(
                F.array(*[F.struct(F.lit(f.name).alias("column"), _present(f).cast("string").alias("value"))
                          for f in counted])
            ).alias("p")
        ).select("p.*").filter(F.col("value").isNotNull()).distinct()
        counts = pairs.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
        small = counts.filter(F.col("distinct_count") <= set_limit).select("column")
        sets = pairs.join(small, "column").groupBy("column").agg(
            F.array_sort(F.collect_list("value")).alias("value_set")
        )
        out = base.join(counts, "column", "left").join(sets, "column", "left")
    else:
        out = base.withColumn("distinct_count", F.lit(None).cast("long")).withColumn("value_set", F.lit(None).cast("array<string>"))
    return out.withColumn("distinct_count", F.coalesce("distinct_count", "_estimate").cast("long")).drop("_estimate")


def generate_rules(
    prof: DataFrame,
    *,
    match_set: bool = True,
    col_types: bool = True,
    missing: bool = True,
    min_max: bool = True,
    categorical: bool = True,
    categorical_threshold: int = 10,
    missing_buffer: float = 10,
    min_buffer: float = 10,
    max_buffer: float = 10,
    missing_upper: bool = False,
) -> DataFrame:
    """DQ1: rules from a profile, in suite order (the column set first, then
    per column: type, null fraction, range, value set). Columns:
    ``rule_id, rule_type, column, type_name, mostly, min_value, max_value,
    value_set``.

    * null fraction: ``mostly = null_frac - buffer`` when above the buffer,
      else 0; passes when the NULL share is at least ``mostly``.
    * range: numeric columns with a value: [min - b*(max-min), max + b*(max-min)].
    * value set: text columns with at most ``categorical_threshold`` distinct
      values (at most the profile's ``set_limit``), or numeric columns whose
      values are exactly {0, 1} with none missing.
    * ``missing_upper`` adds ``null_fraction_max``: the NULL share must stay
      at most ``null_frac + buffer`` (the original bounds it from below only,
      so extra NULLs pass).
    """
    p = prof
    rid = lambda kind: (F.col("position") + 1) * 10 + RULE_ORDER[kind]
    null_d = F.lit(None).cast("double")
    null_s = F.lit(None).cast("string")
    null_set = F.lit(None).cast("array<string>")
    parts = []

    def rule(kind, cond, *, type_name=null_s, mostly=null_d, lo=null_d, hi=null_d, vset=null_set):
        return p.filter(cond).select(
            rid(kind).cast("long").alias("rule_id"), F.lit(kind).alias("rule_type"), "column",
            type_name.alias("type_name"), mostly.alias("mostly"), lo.alias("min_value"), hi.alias("max_value"),
            vset.alias("value_set"),
        )

    if match_set:
        parts.append(
            p.agg(
                F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda s: s["column"]).alias("value_set")
            ).select(
                F.lit(0).cast("long").alias("rule_id"), F.lit("columns_match_set").alias("rule_type"),
                F.lit(None).cast("string").alias("column"), null_s.alias("type_name"), null_d.alias("mostly"),
                null_d.alias("min_value"), null_d.alias("max_value"), "value_set",
            )
        )
    if col_types:
        parts.append(rule("column_type", F.lit(True), type_name=F.col("type_name")))
    if missing:
        b = missing_buffer / 100.0
        mostly = F.when(F.col("null_frac") > b, F.col("null_frac") - b).otherwise(0.0)
        parts.append(rule("null_fraction", F.lit(True), mostly=mostly))
    if missing and missing_upper:
        b = missing_buffer / 100.0
        parts.append(rule("null_fraction_max", F.lit(True), mostly=F.least(F.col("null_frac") + b, F.lit(1.0))))
    if min_max:
        span = F.col("max_value") - F.col("min_value")
        parts.append(
            rule("between", F.col("is_numeric") & (F.col("non_null") > 0),
                 lo=F.col("min_value") - span * (min_buffer / 100.0),
                 hi=F.col("max_value") + span * (max_buffer / 100.0))
        )
    if categorical:
        text_set = ~F.col("is_numeric") & F.col("value_set").isNotNull() & (F.col("distinct_count") <= categorical_threshold)
        flag_set = (
            F.col("is_numeric") & (F.col("distinct_count") == 2) & (F.col("nulls") == 0)
            & (F.col("min_value") == 0) & (F.col("max_value") == 1)
        )
        parts.append(
            rule("in_set", text_set | flag_set,
                 vset=F.when(text_set, F.col("value_set")).otherwise(F.array(F.lit("0"), F.lit("1"))))
        )
    out = parts[0]
    for q in parts[1:]:
        out = out.unionByName(q)
    return out


def validate(df: DataFrame, rules: DataFrame, *, raise_on_failure: bool = False) -> DataFrame:
    """DQ2-DQ8: evaluate every rule against ``df`` in one aggregate pass.

    Returns one row per rule: ``rule_id, rule_type, column, success,
    element_count, unexpected_count``. The rule table is metadata (a few rows
    per column) and is read on the driver to build the aggregate; the data
    itself is only aggregated on the executors.
    """
    spark = df.sparkSession
    rule_rows = rules.orderBy("rule_id").collect()
    fields = {f.name: f for f in df.schema.fields}
    aggs, rows = [F.count(F.lit(1)).alias("n")], []
    for k, r in enumerate(rule_rows):
        c, found = r.column, F.col(f"r{k}")
        if r.rule_type == "columns_match_set":
            ok, unexpected = F.lit(set(r.value_set) == set(df.columns)), F.lit(0)
        elif c not in fields:
            ok, unexpected = F.lit(False), F.lit(None)
        elif r.rule_type == "column_type":
            ok, unexpected = F.lit(fields[c].dataType.simpleString() == r.type_name), F.lit(0)
        else:
            value = _present(fields[c])
            if r.rule_type in ("null_fraction", "null_fraction_max"):
                bad = value.isNull()
            elif r.rule_type == "between":
                bad = value.isNotNull() & ((value < r.min_value) | (value > r.max_value))
            elif r.rule_type == "in_set" and _is_numeric(fields[c].dataType):
                bad = value.isNotNull() & ~value.cast("double").isin([float(v) for v in r.value_set])
            elif r.rule_type == "in_set":
                bad = value.isNotNull() & ~value.cast("string").isin(list(r.value_set))
            else:
                raise ValueError(f"unknown rule type {r.rule_type!r}")
            aggs.append(F.coalesce(F.sum(bad.cast("long")), F.lit(0)).alias(f"r{k}"))
            if r.rule_type == "null_fraction":
                ok = F.coalesce(F.try_divide(found, "n"), F.lit(1.0)) >= F.lit(r.mostly - 1e-12)
                unexpected = F.col("n") - found
            elif r.rule_type == "null_fraction_max":
                ok, unexpected = F.coalesce(F.try_divide(found, "n"), F.lit(0.0)) <= F.lit(r.mostly + 1e-12), found
            else:
                ok, unexpected = found == 0, found
        rows.append(F.struct(
            F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.rule_type).alias("rule_type"), F.lit(c).cast("string").alias("column"),
            ok.alias("success"), F.col("n").alias("element_count"), unexpected.cast("long").alias("unexpected_count")))
    if not rows:
        return spark.createDataFrame([], "rule_id long, rule_type string, column string, success boolean, "
                                         "element_count long, unexpected_count long")
    out = df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    if raise_on_failure and not out.filter(~F.col("success")).isEmpty():
        raise ValueError("data validation failed")
    return out


def validation_summary(results: DataFrame) -> DataFrame:
    """DQ8 summary: evaluated, successful, unsuccessful, success percent."""
    return results.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.sum(F.col("success").cast("long")).alias("successful"),
        F.sum((~F.col("success")).cast("long")).alias("unsuccessful"),
    ).withColumn("success_percent", F.col("successful") / F.col("evaluated") * 100.0)


def suite_summary(rules: DataFrame) -> DataFrame:
    """Rules per rule type plus a total row (``rule_type`` = 'total')."""
    per = rules.groupBy("rule_type").agg(F.count(F.lit(1)).alias("n_rules"))
    total = rules.agg(F.count(F.lit(1)).alias("n_rules")).select(F.lit("total").alias("rule_type"), "n_rules")
    return per.unionByName(total)


# fixed values: alert colour per check kind
ALERT_LEVELS = {"validation": "Red", "drift": "Amber"}


def alerts(results: DataFrame, *, kind: str, name_col: str = "column", ok_col: str = "success") -> DataFrame:
    """DQ9: one alert row per failed check: level Red for validation, Amber
    for drift; an unknown kind raises."""
    if kind not in ALERT_LEVELS:
        raise ValueError(f"unknown alert kind {kind!r}")
    failed = results.filter(~F.col(ok_col))
    return failed.select(
        F.lit(ALERT_LEVELS[kind]).alias("level"),
        F.lit(kind).alias("kind"),
        F.col(name_col).alias("subject"),
        F.format_string(f"{kind} check failed for %s", F.coalesce(F.col(name_col), F.lit("table"))).alias("message"),
    )
