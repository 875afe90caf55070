"""Drift between a reference and a current sample (DR1-DR6).

Statistics are distributed: per-value counts of both samples (hash
aggregate), then a prefix sum over the ordered distinct values with
:func:`ordered_scan` (range-partitioned, never one global window). Only
the final per-column numbers become p-values, in a vectorised pandas UDF
that runs on the executors.

The report has two regimes, chosen by the caller: ``tests`` (KS for numeric
columns, z for two-valued and chi-square for other categorical ones; drift
when p < ``p``) and ``distances`` (normed Wasserstein and Jensen-Shannon with
the natural log; drift when >= ``distance``). :func:`preset` makes the usual
choice from a reference's size and distinct counts and says what it chose. The
data set drifts when at least half of its columns drift.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.operators.scan import ordered_scan
from rivalry.session import cut_lineage


# fixed value: the smallest standard deviation a distance is normed by
LEAST_SPREAD = 0.001


def _split(df: DataFrame, part: str, ref: str) -> tuple[Column, Column]:
    is_ref = (F.col(part) == ref).cast("long")
    return is_ref, (1 - is_ref)


def value_counts_2(df: DataFrame, column: str, *, part: str, ref: str) -> DataFrame:
    """Per distinct non-NULL value: counts in the reference and current parts."""
    is_ref, is_cur = _split(df, part, ref)
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.sum(is_ref).alias("c_ref"), F.sum(is_cur).alias("c_cur"))
    )


def _ecdf(counts: DataFrame) -> DataFrame:
    return ordered_scan(
        counts.select("value", "c_ref", "c_cur"), [], ["value"], row_number=None,
        sums={"cum_ref": "c_ref", "cum_cur": "c_cur"}, lags={"value": 1},
    )


def ks_statistic(df: DataFrame, column: str, *, part: str = "part", ref: str = "reference") -> DataFrame:
    """DR1: max |F_ref(x) - F_cur(x)| over the pooled values; one row
    ``ks, n_ref, n_cur`` (``ks`` NULL if a part has no values)."""
    counts = value_counts_2(df, column, part=part, ref=ref)
    n_ref = counts.agg(F.sum("c_ref")).scalar()
    n_cur = counts.agg(F.sum("c_cur")).scalar()
    e = _ecdf(counts)
    gap = F.abs(F.try_divide("cum_ref", n_ref) - F.try_divide("cum_cur", n_cur))
    return e.agg(F.max(gap).alias("ks")).select(
        "ks", n_ref.cast("long").alias("n_ref"), n_cur.cast("long").alias("n_cur")
    )


def wasserstein_normed(df: DataFrame, column: str, *, part: str = "part", ref: str = "reference") -> DataFrame:
    """DR4: integral of |F_ref - F_cur| divided by the reference's population
    standard deviation, which counts as at least ``LEAST_SPREAD`` (a constant
    reference has none); one row ``wasserstein`` (NULL if a part has no
    values)."""
    counts = value_counts_2(df, column, part=part, ref=ref)
    n_ref = counts.agg(F.sum("c_ref")).scalar()
    n_cur = counts.agg(F.sum("c_cur")).scalar()
    std_ref = df.filter(F.col(part) == ref).agg(F.stddev_pop(F.col(column).cast("double"))).scalar()
    e = _ecdf(counts)
    # ECDF gap just before this value (after the previous one) times the step
    prev_gap = F.abs(F.try_divide(F.col("cum_ref") - F.col("c_ref"), n_ref) - F.try_divide(F.col("cum_cur") - F.col("c_cur"), n_cur))
    step = F.col("value").cast("double") - F.col("value_lag1").cast("double")
    area = F.sum(F.when(F.col("value_lag1").isNotNull(), prev_gap * step).otherwise(prev_gap * 0.0))
    return e.agg(area.alias("w")).select((F.col("w") / F.greatest(std_ref, F.lit(LEAST_SPREAD))).alias("wasserstein"))


def _shares(df: DataFrame, column: str, *, part: str, ref: str) -> DataFrame:
    counts = value_counts_2(df, column, part=part, ref=ref)
    n_ref = counts.agg(F.sum("c_ref")).scalar()
    n_cur = counts.agg(F.sum("c_cur")).scalar()
    return counts.select(
        "value", "c_ref", "c_cur", F.try_divide("c_ref", n_ref).alias("p"), F.try_divide("c_cur", n_cur).alias("q"),
        n_ref.alias("n_ref"), n_cur.alias("n_cur"),
    )


def _chi_term(seen: Column, expected: Column) -> Column:
    """(observed - expected)^2 / expected; infinite for a category that the
    reference never had."""
    return F.when(expected > 0, F.try_divide((seen - expected) ** 2, expected)).when(seen > 0, F.lit(float("inf"))).otherwise(0.0)


def chi_square(df: DataFrame, column: str, *, part: str = "part", ref: str = "reference") -> DataFrame:
    """DR2: sum over all categories of either part of (observed - expected)^2
    / expected, with expected = reference share x current rows; one row
    ``chi2, dof``. A category that the reference never had makes the
    statistic infinite."""
    s = _shares(df, column, part=part, ref=ref)
    return s.agg(F.sum(_chi_term(F.col("c_cur"), F.col("p") * F.col("n_cur"))).alias("chi2"), (F.count(F.lit(1)) - 1).alias("dof"))


def _z(x1: str, x2: str, n1: str, n2: str) -> Column:
    """Pooled z; 0 without spread, NULL if a part has no rows."""
    pool = F.try_divide(F.col(x1) + F.col(x2), F.col(n1) + F.col(n2))
    se = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    gap = F.try_divide(x1, n1) - F.try_divide(x2, n2)
    return F.when(se > 0, F.try_divide(gap, se)).when(se == 0, F.lit(0.0))


def z_proportion(df: DataFrame, column: str, *, part: str = "part", ref: str = "reference") -> DataFrame:
    """DR3: pooled two-sample z statistic for the share of the larger value
    of a two-valued column; one row ``z, n_ref, n_cur``."""
    top = df.agg(F.max(column)).scalar()
    is_ref = F.col(part) == ref
    hit = (F.col(column) == top).cast("double")
    st = df.filter(F.col(column).isNotNull()).agg(
        F.sum(F.when(is_ref, 1).otherwise(0)).alias("n1"), F.sum(F.when(~is_ref, 1).otherwise(0)).alias("n2"),
        F.sum(F.when(is_ref, hit).otherwise(0.0)).alias("x1"), F.sum(F.when(~is_ref, hit).otherwise(0.0)).alias("x2"),
    )
    return st.select(
        _z("x1", "x2", "n1", "n2").alias("z"), F.col("n1").cast("long").alias("n_ref"),
        F.col("n2").cast("long").alias("n_cur"),
    )


def js_distance(df: DataFrame, column: str, *, part: str = "part", ref: str = "reference") -> DataFrame:
    """DR5: square root of the Jensen-Shannon divergence (natural log) of
    the category shares; one row ``js``."""
    s = _shares(df, column, part=part, ref=ref)
    m = (F.col("p") + F.col("q")) / 2

    def kl(x):
        return F.when(x > 0, x * F.log(x / m)).when(x == 0, F.lit(0.0))

    return s.agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(kl(F.col("p"))) + 0.5 * F.sum(kl(F.col("q"))))).alias("js"))


# ------------------------------------------------------------- p-values
def p_values(test: Column, stat: Column, n1: Column, n2: Column, dof: Column) -> Column:
    """p-value of each statistic, in one vectorised pass over one row per
    column of the report."""

    def gamma_q(a: float, x: float) -> float:
        # regularised upper incomplete gamma: series below a + 1, continued fraction above
        if x <= 0:
            return 1.0
        if math.isinf(x):
            return 0.0
        scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
        if x < a + 1:
            term = total = 1.0 / a
            n = a
            while abs(term) > abs(total) * 1e-15:
                n += 1
                term *= x / n
                total += term
            return max(0.0, 1.0 - total * scale)
        tiny = 1e-300
        b = x + 1 - a
        c, d = 1 / tiny, 1 / b
        h, i, delta = d, 0, 0.0
        while abs(delta - 1) > 1e-14:
            i += 1
            an = -i * (i - a)
            b += 2
            d = 1 / ((an * d + b) or tiny)
            c = (b + an / c) or tiny
            delta = c * d
            h *= delta
            if i > 1_000_000:
                raise ArithmeticError(f"incomplete gamma did not converge for a={a}, x={x}")
        return scale * h

    def kolmogorov_q(lam: float) -> float:
        # two series of the same function: each converges in a few terms on its side
        if lam <= 0:
            return 1.0
        if lam < 1.18:
            y = math.exp(-math.pi ** 2 / (8 * lam * lam))
            total, k, term = 0.0, 1, 1.0
            while term > 1e-18 and k < 400:
                term = y ** (k * k)
                total += term
                k += 2
            return 1.0 - math.sqrt(2 * math.pi) / lam * total
        total, k, term = 0.0, 1, 1.0
        while term > 1e-18:
            term = math.exp(-2 * k * k * lam * lam)
            total += term if k % 2 else -term
            k += 1
        return min(1.0, max(0.0, 2 * total))

    def values(test: pd.Series, stat: pd.Series, n1: pd.Series, n2: pd.Series, dof: pd.Series) -> pd.Series:
        out = []
        for t, s, a, b, d in zip(test, stat, n1, n2, dof):
            if s is None or s != s:
                out.append(None)
            elif t == "ks":
                root = math.sqrt(a * b / (a + b))
                out.append(kolmogorov_q((root + 0.12 + 0.11 / root) * s))
            elif t == "z":
                out.append(math.erfc(abs(s) / math.sqrt(2)))
            elif t == "chisquare":
                out.append(gamma_q(max(d, 1) / 2.0, s / 2.0))
            else:
                out.append(None)
        return pd.Series(out, dtype="float64")

    # defined here, so it travels by value and the executors need no copy of this package
    return F.pandas_udf(values, T.DoubleType())(test, stat, n1, n2, dof)


NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _numeric_columns(df: DataFrame) -> set[str]:
    return {f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)}


def _stacked(df: DataFrame, columns: Sequence[str], kind: str, extra: Sequence[Column | str] = ()) -> DataFrame:
    """(column, value) rows of several columns, NULLs left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    return df.select(*extra, F.explode(pairs).alias("x")).select(*extra, "x.*").filter(F.col("value").isNotNull())


def preset(
    df: DataFrame, *, part: str = "part", ref: str = "reference", columns: Sequence[str] | None = None, small_limit: int = 1000,
    few_values: int = 5,
) -> dict:
    """The usual choice of arguments for :func:`drift_report`: ``tests`` up to
    ``small_limit`` reference rows, else ``distances``; numeric columns with at
    most ``few_values`` distinct values count as categorical, two-valued ones
    as ``binary``. One pass over the stacked columns; the result is one entry
    per column, so the caller can see and change it."""
    cols = list(columns or [c for c in df.columns if c != part])
    n_ref = df.filter(F.col(part) == ref).count()
    values = _stacked(df, cols, "string").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    distinct = {r["column"]: r["n"] for r in values.collect()}  # one row per column
    numeric = _numeric_columns(df)
    return {
        "regime": "tests" if n_ref <= small_limit else "distances",
        "columns": cols,
        "categorical": [c for c in cols if c not in numeric or distinct.get(c, 0) <= few_values],
        "binary": [c for c in cols if distinct.get(c, 0) == 2],
    }


def drift_report(
    df: DataFrame, *, regime: str, categorical: Sequence[str] | None = None, binary: Sequence[str] = (), part: str = "part",
    ref: str = "reference", columns: Sequence[str] | None = None, p: float = 0.05, distance: float = 0.1,
) -> DataFrame:
    """DR6: one row per column (``column, kind, test, score, p_value,
    threshold, drifted, n_drifted``) plus a summary row (column '__dataset__':
    score = share of drifted columns, n_drifted = their count, drifted = share
    >= 0.5).

    ``regime`` is ``tests`` or ``distances``. ``categorical`` names the
    columns compared by category (by default those that are not numeric) and
    ``binary`` those among them with two values, which take the z-test. Every
    column has a row: without values in one of the parts its score is NULL
    and it has not drifted.

    Passes over the data do not grow with the column count: one aggregate
    for spreads and largest values; all numeric columns stacked as (column,
    value) through one ordered scan keyed by column; all categorical columns
    stacked through one grouped count."""
    if regime not in ("tests", "distances"):
        raise ValueError(f"regime must be tests or distances, not {regime!r}")
    cols = list(columns or [c for c in df.columns if c != part])
    in_categories = set(cols) - _numeric_columns(df) if categorical is None else set(categorical)
    numeric = [c for c in cols if c not in in_categories]
    by_category = [c for c in cols if c in in_categories]
    small = regime == "tests"
    tests = {c: "ks" if small else "wasserstein" for c in numeric}
    tests |= {c: ("z" if c in set(binary) else "chisquare") if small else "jensenshannon" for c in by_category}
    is_ref = F.col(part) == ref

    aggs = [F.stddev_pop(F.when(is_ref, F.col(c).cast("double"))).alias(f"s{i}") for i, c in enumerate(cols) if c in numeric]
    aggs += [F.max(c).cast("string").alias(f"m{i}") for i, c in enumerate(cols) if c in by_category]
    facts = df.agg(*aggs).select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(c).alias("column"), F.lit("numeric" if c in numeric else "categorical").alias("kind"),
                 F.lit(tests[c]).alias("test"), (F.col(f"s{i}") if c in numeric else F.lit(None).cast("double")).alias("spread"),
                 (F.col(f"m{i}") if c in by_category else F.lit(None).cast("string")).alias("top"))
        for i, c in enumerate(cols)])).alias("x")).select("x.*")
    # one row per column: small by construction
    facts = F.broadcast(cut_lineage(facts))

    stats = []
    if numeric:
        counts = _stacked(df, numeric, "double", [part]).groupBy("column", "value").agg(
            F.sum(is_ref.cast("long")).alias("c_ref"), F.sum((~is_ref).cast("long")).alias("c_cur"))
        counts = cut_lineage(counts)
        tot = counts.groupBy("column").agg(F.sum("c_ref").alias("n1"), F.sum("c_cur").alias("n2"))
        e = ordered_scan(counts, ["column"], ["value"], row_number=None, sums={"cum_ref": "c_ref", "cum_cur": "c_cur"}, lags={"value": 1})
        e = e.join(F.broadcast(tot), "column").join(facts.select("column", "spread"), "column")
        gap = F.abs(F.try_divide("cum_ref", "n1") - F.try_divide("cum_cur", "n2"))
        prev_gap = F.abs(F.try_divide(F.col("cum_ref") - F.col("c_ref"), "n1") - F.try_divide(F.col("cum_cur") - F.col("c_cur"), "n2"))
        step = F.col("value") - F.col("value_lag1")
        area = F.sum(F.when(F.col("value_lag1").isNotNull(), prev_gap * step).otherwise(prev_gap * 0.0))
        stats.append(e.groupBy("column").agg(
            (F.max(gap) if small else area / F.greatest(F.max("spread"), F.lit(LEAST_SPREAD))).alias("score"),
            F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.lit(0).cast("long").alias("dof")))
    if by_category:
        counts = _stacked(df, by_category, "string", [part]).groupBy("column", "value").agg(
            F.sum(is_ref.cast("long")).alias("c_ref"), F.sum((~is_ref).cast("long")).alias("c_cur"))
        counts = cut_lineage(counts)
        tot = counts.groupBy("column").agg(F.sum("c_ref").alias("n1"), F.sum("c_cur").alias("n2"))
        sh = counts.join(F.broadcast(tot), "column").join(facts.select("column", "test", "top"), "column")
        sh = sh.withColumn("p", F.try_divide("c_ref", "n1")).withColumn("q", F.try_divide("c_cur", "n2"))
        m = (F.col("p") + F.col("q")) / 2

        def kl(x):
            return F.when(x > 0, x * F.log(x / m)).when(x == 0, F.lit(0.0))

        is_top = F.col("value") == F.col("top")
        per = sh.groupBy("column").agg(
            F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(kl(F.col("p"))) + 0.5 * F.sum(kl(F.col("q"))))).alias("js"),
            F.sum(_chi_term(F.col("c_cur"), F.col("p") * F.col("n2"))).alias("chi2"),
            F.sum(F.when(is_top, F.col("c_ref")).otherwise(0)).cast("double").alias("x1"),
            F.sum(F.when(is_top, F.col("c_cur")).otherwise(0)).cast("double").alias("x2"),
            F.max("n1").alias("n1"), F.max("n2").alias("n2"), F.max("test").alias("test"), (F.count(F.lit(1)) - 1).alias("dof"))
        score = F.when((F.col("n1") == 0) | (F.col("n2") == 0), None).when(F.col("test") == "jensenshannon", F.col("js")).when(
            F.col("test") == "z", _z("x1", "x2", "n1", "n2")).otherwise(F.col("chi2"))
        stats.append(per.select("column", score.alias("score"), "n1", "n2", "dof"))
    found = stats[0] if len(stats) == 1 else stats[0].unionByName(stats[1])
    out = facts.select("pos", "column", "kind", "test").join(found, "column", "left")
    if small:
        out = out.withColumn("p_value", p_values(F.col("test"), F.col("score"), F.col("n1"), F.col("n2"), F.col("dof")))
        drifted, limit = F.col("p_value") < p, p
    else:
        out = out.withColumn("p_value", F.lit(None).cast("double"))
        drifted, limit = F.col("score") >= distance, distance
    out = cut_lineage(out.select("column", "kind", "test", "score", "p_value", F.lit(limit).alias("threshold"),
                                 F.coalesce(drifted, F.lit(False)).alias("drifted"), F.lit(None).cast("long").alias("n_drifted")))
    summary = out.agg(F.sum(F.col("drifted").cast("long")).alias("n"), F.count(F.lit(1)).alias("of")).select(
        F.lit("__dataset__").alias("column"), F.lit("dataset").alias("kind"), F.lit("share").alias("test"),
        F.try_divide("n", "of").alias("score"), F.lit(None).cast("double").alias("p_value"), F.lit(0.5).alias("threshold"),
        F.coalesce(F.try_divide("n", "of") >= 0.5, F.lit(False)).alias("drifted"), F.col("n").alias("n_drifted"))
    return out.unionByName(summary)
