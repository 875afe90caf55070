"""Order-dependent match operators: match week (W1), the long per-team game
table (W2, W6), running goals/points (W3-W5) and the "value after the first
j games" lookup (J7).

Every order-dependent step goes through :func:`ordered_scan`, so a season or
team holding a large share of the rows is still split across many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.operators.scan import ordered_scan
from rivalry.session import cut_lineage

FORM_DEPTH = 5


@dataclass(frozen=True)
class MatchCols:
    """Column roles of a two-sided match table."""

    keys: tuple[str, ...] = ("season",)
    match_id: str = "match_id"
    order: tuple[str, ...] = ("match_date", "match_id")
    home: str = "home_team"
    away: str = "away_team"
    hg: str = "fthg"
    ag: str = "ftag"
    result: str = "ftr"
    # more match columns to carry along
    extra: tuple[str, ...] = field(default_factory=tuple)


DEFAULT = MatchCols()

# fixed values: points per result letter
POINTS = {"W": 3, "D": 1, "L": 0}


def points_of(result: Column) -> Column:
    """W=3, D=1, anything else 0."""
    return F.when(result == "W", 3).when(result == "D", 1).otherwise(0)


def match_index(matches: DataFrame, *, cols: MatchCols = DEFAULT, block: int = 10) -> DataFrame:
    """``i`` = 1-based row of the match in its season (by ``order``),
    ``j`` = (i-1) div ``block`` (0-based block), ``mw`` = j + 1."""
    scanned = ordered_scan(matches, cols.keys, cols.order, row_number="i")
    j = F.floor((F.col("i") - 1) / F.lit(block)).cast("long")
    return scanned.withColumn("j", j).withColumn("mw", j + 1)


# rows of a season that one task scans at a time
SLICE_ROWS = 16_384


def block_slice(block: int) -> Column:
    """The number of the match's slice: whole blocks, about ``SLICE_ROWS``
    matches of a season in their order."""
    return F.floor((F.col("mw") - 1) * F.lit(block) / F.lit(SLICE_ROWS)).cast("long")


def side_result(venue: Column, result: Column) -> Column:
    """Result from one side's view. Taken from the result code, not the
    goals: H and A as expected, any other code (NULL too) is a draw."""
    return (
        F.when(venue == "H", F.when(result == "H", "W").when(result == "A", "L").otherwise("D"))
        .otherwise(F.when(result == "A", "W").when(result == "H", "L").otherwise("D"))
    )


def team_rows(matches: DataFrame, *, cols: MatchCols = DEFAULT) -> DataFrame:
    """Two rows per match, one per side: team, opponent, venue, goals for and
    against, W/D/L and points. A narrow transformation (no shuffle)."""
    home = F.struct(
        F.col(cols.home).alias("team"), F.col(cols.away).alias("opponent"), F.lit("H").alias("venue"),
        F.col(cols.hg).cast("long").alias("gf"), F.col(cols.ag).cast("long").alias("ga"),
    )
    away = F.struct(
        F.col(cols.away).alias("team"), F.col(cols.home).alias("opponent"), F.lit("A").alias("venue"),
        F.col(cols.ag).cast("long").alias("gf"), F.col(cols.hg).cast("long").alias("ga"),
    )
    order_extra = [c for c in cols.order if c not in cols.keys and c != cols.match_id]
    base = [*cols.keys, cols.match_id, *order_extra, *cols.extra, cols.result]
    rows = matches.select(*base, F.explode(F.array(home, away)).alias("s")).select(*base, "s.*")
    res = side_result(F.col("venue"), F.col(cols.result))
    return rows.withColumn("res", res).withColumn("pts", points_of(res).cast("long")).drop(cols.result)


def team_games_scan(matches: DataFrame, *, cols: MatchCols = DEFAULT, form_depth: int = FORM_DEPTH, keep: Sequence[str] | None = None
                    ) -> DataFrame:
    """Per (keys, team): game number ``g`` in match order, running goals
    for/against and points (inclusive of game ``g``) and the results of the
    previous ``form_depth`` games (``res_lag1..``). ``keep``: the columns of
    :func:`team_rows` to write besides (default all)."""
    rows = team_rows(matches, cols=cols)
    return ordered_scan(
        rows,
        [*cols.keys, "team"],
        list(cols.order),
        row_number="g",
        sums={"cum_gf": "gf", "cum_ga": "ga", "cum_pts": "pts"},
        lags={"res": form_depth},
        keep=keep,
    )


def indexed_games_scan(indexed: DataFrame, *, cols: MatchCols = DEFAULT, block: int = 10, form_depth: int = FORM_DEPTH,
                       keep: Sequence[str] | None = None) -> DataFrame:
    """:func:`team_games_scan` of matches that :func:`match_index` has numbered:
    the row numbers give the order and its slices. Matches are dealt by slice
    before they become two rows each, so a game is shuffled once, not four times."""
    used = dict.fromkeys([*cols.keys, cols.match_id, cols.home, cols.away, cols.hg, cols.ag, cols.result, *cols.extra, "i"])
    dealt = indexed.select(*used, block_slice(block).alias("_slice")).repartition(*cols.keys, "_slice")
    rows = team_rows(dealt, cols=replace(cols, order=("i",), extra=(*cols.extra, "_slice")))
    return ordered_scan(
        rows, [*cols.keys, "team"], ["i"], row_number="g",
        sums={"cum_gf": "gf", "cum_ga": "ga", "cum_pts": "pts"}, lags={"res": form_depth}, keep=keep, slices="_slice",
    )


def game_counts(scan: DataFrame, *, cols: MatchCols = DEFAULT) -> DataFrame:
    """Games per (keys, team); map-side partial aggregation keeps the
    shuffle to one row per team and task."""
    return scan.groupBy(*cols.keys, "team").agg(F.max("g").alias("n"))


# a per-(keys, team) table is broadcast up to this many rows (counted)
GROUPS_BROADCAST_MAX = 1_000_000


def sized_group_table(table: DataFrame) -> DataFrame:
    """Write a per-group table once and broadcast it when its counted row
    count is under the bound. Few groups means hot join keys, and exactly
    then the table is small and broadcast; many groups means no key is hot,
    and the sort-merge join (with AQE skew splitting) is used."""
    held = cut_lineage(table)
    return F.broadcast(held) if held.count() <= GROUPS_BROADCAST_MAX else held


def team_games(matches: DataFrame, *, cols: MatchCols = DEFAULT, form_depth: int = FORM_DEPTH) -> DataFrame:
    """The long table plus ``n``, the team's game count in its group."""
    scan = team_games_scan(matches, cols=cols, form_depth=form_depth)
    return scan.join(sized_group_table(game_counts(scan, cols=cols)), on=[*cols.keys, "team"], how="inner")


def _attach_side(m: DataFrame, counts: DataFrame, states: DataFrame, *, prefix: str, team_col: str,
                 cols: MatchCols) -> DataFrame:
    c = counts.alias("c")
    cond = [F.col(f"m.{k}") == F.col(f"c.{k}") for k in cols.keys] + [F.col(f"m.{team_col}") == F.col("c.team")]
    m = m.alias("m").join(c, on=cond, how="left").select(
        F.col("m.*"), F.least(F.col("m.j"), F.coalesce(F.col("c.n"), F.lit(0))).alias("_g")
    )
    s = states.alias("s")
    # the number first: the join sorts by it, and few rows share one
    cond = [F.col("m._g") == F.col("s.g")] + [F.col(f"m.{k}") == F.col(f"s.{k}") for k in cols.keys]
    cond += [F.col(f"m.{team_col}") == F.col("s.team")]
    # the state's letters behind an 'L' for every missing game, no more than j of them, 'M' for the rest
    j, missing = F.col("m.j"), F.col("m.j") - F.col("m._g")
    letters = F.concat(F.repeat(F.lit("L"), F.least(missing, F.lit(FORM_DEPTH)).cast("int")), F.coalesce(F.col("s.letters"), F.lit("")))
    form = F.rpad(F.substring(letters, F.lit(1), F.least(j, F.lit(FORM_DEPTH)).cast("int")), FORM_DEPTH, "M")
    joined = m.alias("m").join(s, on=cond, how="left").select(
        F.col("m.*"),
        F.coalesce(F.col("s.cum_gf"), F.lit(0)).alias(f"{prefix}tgs"),
        F.coalesce(F.col("s.cum_ga"), F.lit(0)).alias(f"{prefix}tgc"),
        F.coalesce(F.col("s.cum_pts"), F.lit(0)).alias(f"{prefix}tp"),
        form.alias(f"{prefix}form"),
    )
    return joined.drop("_g")


def form_letters(df: DataFrame) -> DataFrame:
    """The five form letters of both sides from the texts ``hform``/``aform``."""
    letters = [F.substring(f"{p}form", k, 1).alias(f"{p}m{k}") for p in ("h", "a") for k in range(1, FORM_DEPTH + 1)]
    return df.select("*", *letters).drop("hform", "aform")


def attach_block_state(indexed: DataFrame, scan: DataFrame, *, cols: MatchCols = DEFAULT, letters: bool = True) -> DataFrame:
    """J7 for both sides: each side's totals after its first ``min(j, n)``
    games (0 when j = 0) and its five form letters ``hm1..5`` / ``am1..5``.

    Form letter k (1 = newest): 'M' when j < k; otherwise the result of game
    j-k+1, or 'L' when the team has fewer games than that (padding).
    The state at game ``min(j, n)`` carries its own result and the four
    before it as one text, which covers all five letters. Both sides probe the
    same state table (same plan, so its exchange can be reused). Without
    ``letters`` the forms stay the texts ``hform``/``aform`` of five letters
    (:func:`form_letters` splits them), which later shuffles carry at less cost.
    """
    counts = sized_group_table(game_counts(scan, cols=cols))
    states = scan.select(
        *cols.keys, "team", "g", "cum_gf", "cum_ga", "cum_pts",
        # games before the first are NULL and leave no letter
        F.concat_ws("", "res", *[f"res_lag{k}" for k in range(1, FORM_DEPTH)]).alias("letters"),
    )
    out = _attach_side(indexed, counts, states, prefix="h", team_col=cols.home, cols=cols)
    out = _attach_side(out, counts, states, prefix="a", team_col=cols.away, cols=cols)
    return form_letters(out) if letters else out
