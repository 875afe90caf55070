"""League position per block (W10-W13), forward-filled away position,
as-of-date positions and the season table (RP6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rivalry.operators.scan import ordered_scan
from rivalry.operators.teamgames import DEFAULT, MatchCols, team_rows
from rivalry.session import cut_lineage


def _rank_in(entries: Column, team: Column, pts: Column, gd: Column, gd_desc: bool) -> Column:
    """1 + number of distinct teams ahead of ``team`` in ``entries``
    (points desc, goal difference asc or desc, team asc)."""

    def ahead(e):
        better_gd = (e["d"] > gd) if gd_desc else (e["d"] < gd)
        return (e["p"] > pts) | ((e["p"] == pts) & (better_gd | ((e["d"] == gd) & (e["team"] < team))))

    return F.size(F.array_distinct(F.transform(F.filter(entries, ahead), lambda e: e["team"]))) + 1


_LAST = "\U0010ffff"  # stands for a NULL team: behind every name


def _place_text(team: str, pts: str, gd: str, null_team: str) -> Column:
    """Points desc, goal difference asc and team asc as one text that sorts
    in this order: texts are compared, sorted and looked up without a lambda."""
    low = F.lit(-(2**63))
    p = F.bitwise_not(F.col(pts).cast("long")).bitwiseXOR(low)
    d = F.col(gd).cast("long").bitwiseXOR(low)
    return F.concat(F.lpad(F.hex(p), 16, "0"), F.lpad(F.hex(d), 16, "0"), F.coalesce(F.col(team), F.lit(null_team)))


def _rank_in_texts(team: str, own: Column, least: Column) -> Column:
    """:func:`_rank_in` over ``_order``, the sorted place texts of a block.
    With one entry a team (``_plain``) a rank is the place in that list."""
    ahead = F.transform(F.filter("_order", lambda x: x < least), lambda x: F.substring(x, 33, 2**31 - 1))
    return F.when(F.col("_plain") & F.col(team).isNotNull(), F.array_position("_order", own)).otherwise(F.size(F.array_distinct(ahead)) + 1)


def block_positions(
    df: DataFrame,
    *,
    cols: MatchCols = DEFAULT,
    home_pts: str = "htp",
    away_pts: str = "atp",
    home_gd: str = "htgd",
    away_gd: str = "atgd",
    within: Sequence[str] = (),
) -> DataFrame:
    """League position of both sides among the teams appearing in the
    match's block (``mw``), all blocks of all seasons in one window.

    Order: points desc, goal difference **asc**, team asc, one entry per team.
    The home side always gets its rank; the away side only when its team has
    no home match in the block (``away_pos_raw`` is NULL otherwise).
    Each window partition is one block, so it holds at most ``block`` rows.
    ``within``: columns that do not change inside a block; rows that lie by
    them and the keys are not shuffled again.
    """
    # the number first: the window sorts by it, and few rows share one
    w = Window.partitionBy("mw", *cols.keys, *within)
    home_e = F.struct(
        F.col(cols.home).alias("team"), F.col(home_pts).alias("p"), F.col(home_gd).alias("d"),
        F.lit(True).alias("h"),
    )
    away_e = F.struct(
        F.col(cols.away).alias("team"), F.col(away_pts).alias("p"), F.col(away_gd).alias("d"),
        F.lit(False).alias("h"),
    )
    entries = F.concat(F.collect_list(home_e).over(w), F.collect_list(away_e).over(w))
    out, e = df.withColumn("_entries", entries), F.col("_entries")
    home_pos = _rank_in(e, F.col(cols.home), F.col(home_pts), F.col(home_gd), gd_desc=False)
    away_pos = _rank_in(e, F.col(cols.away), F.col(away_pts), F.col(away_gd), gd_desc=False)
    away_home = F.exists(e, lambda x: (x["team"] == F.col(cols.away)) & x["h"])
    fields = {f.name: f for f in df.schema.fields}
    numbers, teams = [fields[c] for c in (home_pts, away_pts, home_gd, away_gd)], [fields[c] for c in (cols.home, cols.away)]
    if all(isinstance(f.dataType, T.IntegralType) and not f.nullable for f in numbers) and all(f.dataType == T.StringType() for f in teams):
        out = df.withColumn("_hs", _place_text(cols.home, home_pts, home_gd, _LAST)).withColumn("_as", _place_text(cols.away, away_pts, away_gd, _LAST))
        held = {"_homes": F.coalesce(cols.home, F.lit(_LAST)), "_aways": F.coalesce(cols.away, F.lit(_LAST)), "_hset": F.col("_hs"), "_aset": F.col("_as")}
        out = out.select("*", *[F.collect_set(c).over(w).alias(n) for n, c in held.items()]).withColumn(
            "_order", F.sort_array(F.array_union("_hset", "_aset"))
        ).withColumn("_plain", F.size("_order") == F.size(F.array_union("_homes", "_aways")))
        home_pos = _rank_in_texts(cols.home, F.col("_hs"), _place_text(cols.home, home_pts, home_gd, ""))
        away_pos = _rank_in_texts(cols.away, F.col("_as"), _place_text(cols.away, away_pts, away_gd, ""))
        away_home = F.array_contains("_homes", F.col(cols.away))
    return (
        out.withColumn("home_league_position", home_pos.cast("long"))
        .withColumn("away_pos_raw", F.when(away_home, F.lit(None)).otherwise(away_pos).cast("long"))
        .drop("_entries", "_hs", "_as", "_homes", "_aways", "_hset", "_aset", "_order", "_plain")
    )


def block_ranking(placed: DataFrame, *, cols: MatchCols = DEFAULT) -> DataFrame:
    """W10's table: ``keys, mw, team, position`` of every team that appears in
    a block, one row each, from the output of :func:`block_positions`. Joined
    back by J2 on keys, ``mw`` and team."""
    sides = F.array(
        F.struct(F.col(cols.home).alias("team"), F.col("home_league_position").alias("position")),
        F.struct(F.col(cols.away).alias("team"), F.col("away_pos_raw").alias("position")),
    )
    rows = placed.select(*cols.keys, "mw", F.explode(sides).alias("_s")).select(*cols.keys, "mw", "_s.*")
    return rows.filter(F.col("position").isNotNull()).groupBy(*cols.keys, "mw", "team").agg(F.min("position").alias("position"))


def fill_away_position(df: DataFrame, *, cols: MatchCols = DEFAULT, order: str = "i", slices: str | None = None) -> DataFrame:
    """Forward fill ``away_pos_raw`` within (keys, away team) in
    match order; leading NULL -> 0. Adds ``away_league_position`` and
    ``league_position_diff``. ``slices``: a column of slice numbers of the
    order (:func:`ordered_scan`), which is dropped."""
    # without slices the scan reads its input twice, for their bounds and to
    # fill them: the blocks are ranked once
    filled = ordered_scan(
        df if slices else cut_lineage(df), [*cols.keys, cols.away], [order], row_number=None, ffill={"_alp": "away_pos_raw"}, slices=slices
    )
    return (
        filled.withColumn("away_league_position", F.coalesce(F.col("_alp"), F.lit(0)).cast("long"))
        .withColumn("league_position_diff", F.col("home_league_position") - F.col("away_league_position"))
        .drop("_alp", "away_pos_raw")
    )


def season_table(
    matches: DataFrame, *, cols: MatchCols = DEFAULT, max_mw: int | None = None, indexed: bool = False
) -> DataFrame:
    """RP6: the league table per key group: played, won, drawn, lost, goals
    for/against, goal difference, points and position (points desc, goal
    difference desc, goals for desc, team asc).

    ``max_mw`` keeps only matches of blocks up to that round (needs ``mw``,
    i.e. ``indexed=True`` input from :func:`match_index`).
    """
    src = matches
    if max_mw is not None:
        if not indexed:
            raise ValueError("max_mw needs an indexed match table (with mw)")
        src = src.filter(F.col("mw") <= max_mw)
    rows = team_rows(src, cols=cols)
    table = rows.groupBy(*cols.keys, "team").agg(
        F.count(F.lit(1)).alias("played"),
        F.sum(F.when(F.col("res") == "W", 1).otherwise(0)).cast("long").alias("won"),
        F.sum(F.when(F.col("res") == "D", 1).otherwise(0)).cast("long").alias("drawn"),
        F.sum(F.when(F.col("res") == "L", 1).otherwise(0)).cast("long").alias("lost"),
        F.sum("gf").cast("long").alias("goals_for"),
        F.sum("ga").cast("long").alias("goals_against"),
        F.sum("pts").cast("long").alias("points"),
    ).withColumn("goal_diff", F.col("goals_for") - F.col("goals_against"))
    # a group may have any number of teams: its places are numbered by the scan
    placed = table.select("*", (-F.col("points")).alias("_p"), (-F.col("goal_diff")).alias("_d"), (-F.col("goals_for")).alias("_f"))
    return ordered_scan(placed, list(cols.keys), ["_p", "_d", "_f", "team"], row_number="position").drop("_p", "_d", "_f")


# a place is counted among its _BLOCK neighbours, then by three bits of the
# block's number a level
_BLOCK, _DIGIT = 128, 3


def _spans(scan: DataFrame, keys: list[str], day: str) -> DataFrame:
    """One row per state of a team: points ``_p`` and goal difference ``_d``
    that hold after day ``_from`` (from the start where ``_first``) up to and
    including ``_to``, the day of the team's next game (``_closed``), if any.

    The state after a day and the state before the team's next day are one
    span; both name it by the number of games behind it, so that two rows meet
    in a hash aggregate and a team's games need no window."""
    gf, ga, pts = (F.coalesce(F.col(c), F.lit(0)) for c in ("gf", "ga", "pts"))
    days = scan.groupBy(*keys, "team", day).agg(
        (F.min("g") - 1).alias("_g0"), F.max("g").alias("_g1"),
        F.min_by(F.col("cum_pts") - pts, "g").alias("_p0"), F.max_by("cum_pts", "g").alias("_p1"),
        F.min_by(F.col("cum_gf") - gf - F.col("cum_ga") + ga, "g").alias("_d0"),
        F.max_by(F.col("cum_gf") - F.col("cum_ga"), "g").alias("_d1"),
    )
    ends = F.array(
        F.struct(F.col("_g0").alias("_g"), F.col("_p0").alias("_p"), F.col("_d0").alias("_d"),
                 F.lit(None).alias("_from"), F.col(day).alias("_to"), F.lit(True).alias("_closed")),
        F.struct(F.col("_g1").alias("_g"), F.col("_p1").alias("_p"), F.col("_d1").alias("_d"),
                 F.col(day).alias("_from"), F.lit(None).alias("_to"), F.lit(False).alias("_closed")),
    )
    return days.select(*keys, "team", F.explode(ends).alias("_s")).select(*keys, "team", "_s.*").groupBy(*keys, "team", "_g").agg(
        F.max("_p").alias("_p"), F.max("_d").alias("_d"), F.max("_from").alias("_from"), F.max("_to").alias("_to"),
        F.max("_closed").alias("_closed"), (F.col("_g") == 0).alias("_first"),
    )


def _places(spans: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``keys, team, day, pos``: the place of every team that plays on a day.

    All spans of a group are numbered by place order. A team's place is one
    more than the number of spans that hold on its day and have a smaller
    number. Those of its own block of numbers are compared one by one. Blocks
    before it are taken digit by digit of the block's number: per level, those
    that share its higher digits and have a smaller one. Such counts change on
    game days only: running sums over the days of (level, higher digits). Work
    is (games x digits), whatever the number of days and teams of a group."""
    order = spans.select("*", (-F.col("_p")).alias("_np"), (-F.col("_d")).alias("_nd"))
    numbered = ordered_scan(order, keys, ["_np", "_nd", "team", "_g"], row_number="_r").select(
        *keys, "team", "_from", "_to", "_closed", "_first", (F.col("_r") - 1).alias("_r")
    ).withColumn("_block", F.floor(F.col("_r") / _BLOCK).cast("long"))

    # a game without a date is earlier than all others
    def holds(y, on):
        return (y["_first"] | y["_from"].isNull() | (y["_from"] < on)) & (~y["_closed"] | F.coalesce(y["_to"] >= on, F.lit(False)))

    block = F.collect_list(F.struct("team", "_r", "_from", "_to", "_closed", "_first"))
    near = numbered.groupBy(*keys, "_block").agg(block.alias("_b")).select(*keys, F.explode(F.transform(
        F.filter("_b", lambda x: x["_to"].isNotNull()),
        lambda x: F.struct(
            x["team"].alias("team"), x["_to"].alias(day),
            F.size(F.filter("_b", lambda y: (y["_r"] < x["_r"]) & holds(y, x["_to"]))).cast("long").alias("_n")),
    )).alias("_e")).select(*keys, "_e.*")

    top = numbered.agg(F.max("_block")).first()[0] or 0
    levels = -(-top.bit_length() // _DIGIT)
    ahead = near
    if levels:
        def at_levels(df):
            shift = F.col("_level") * _DIGIT
            leveled = df.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn(
                "_node", F.call_function("shiftright", F.col("_block"), shift + _DIGIT))
            return leveled.withColumn("_digit", (F.call_function("shiftright", F.col("_block"), shift) - F.col("_node") * 2**_DIGIT).cast("int"))

        digits = range(2**_DIGIT - 1)
        start = F.struct(F.col("_from").alias(day), F.lit(1).alias("_sign"))
        end = F.struct(F.col("_to").alias(day), F.lit(-1).alias("_sign"))
        changes = at_levels(numbered.select(
            *keys, "_block", F.explode(F.when(F.col("_closed"), F.array(start, end)).otherwise(F.array(start))).alias("_e")
        ).select(*keys, "_block", "_e.*").groupBy(*keys, "_block", day).agg(F.sum("_sign").alias("_sign")))
        by_day = changes.groupBy(*keys, "_level", "_node", day).agg(
            *[F.sum(F.when(F.col("_digit") <= x, F.col("_sign")).otherwise(0)).alias(f"_e{x}") for x in digits])
        counted = ordered_scan(by_day, [*keys, "_level", "_node"], [day], row_number=None, sums={f"_c{x}": f"_e{x}" for x in digits})
        # places are read before the day's games change them; a span that ends on the day has a row there
        before = counted.select(*keys, "_level", "_node", day, F.array(*[F.col(f"_c{x}") - F.col(f"_e{x}") for x in digits]).alias("_n"))
        reads = at_levels(numbered.filter(F.col("_to").isNotNull()).select(*keys, "team", "_block", F.col("_to").alias(day))).filter("_digit > 0")
        far = reads.join(before, [*keys, "_level", "_node", day]).select(*keys, "team", day, F.get("_n", F.col("_digit") - 1).alias("_n"))
        ahead = near.unionByName(far)
    return ahead.groupBy(*keys, "team", day).agg((F.sum("_n") + 1).cast("long").alias("pos"))


def _grid_places(scan: DataFrame, keys: list[str], day: str) -> DataFrame:
    """``keys, team, day, pos`` of every team on every match day: one snapshot
    per team and day, carried forward by an ordered scan, one window a day."""
    # state of each team at the end of each day it played
    # primitive max_by values keep this a hash aggregate
    snap = scan.groupBy(*keys, "team", day).agg(
        F.max_by("cum_pts", "g").alias("p_snap"),
        F.max_by(F.col("cum_gf") - F.col("cum_ga"), F.col("g")).alias("d_snap"),
    )
    dates = scan.select(*keys, day).distinct()
    teams = scan.select(*keys, "team").distinct()
    # without keys the whole table is one group
    grid = dates.join(teams, on=keys) if keys else dates.withColumn("_g", F.lit(0)).join(
        teams.withColumn("_g", F.lit(0)), "_g").drop("_g")
    # a snapshot of day d applies from the next match day on: a grid row
    # (order 1) sorts before the same day's snapshot (order 2), so the value
    # it carries comes from earlier days only
    probe = grid.select(
        *keys, "team", day, F.lit(1).alias("_probe_order"),
        F.lit(None).cast("long").alias("p_snap"), F.lit(None).cast("long").alias("d_snap"),
    )
    snaps = snap.select(*keys, "team", day, F.lit(2).alias("_probe_order"), "p_snap", "d_snap")
    both = probe.unionByName(snaps)
    carried = ordered_scan(
        both, [*keys, "team"], [day, "_probe_order"], row_number=None,
        ffill={"p_before": "p_snap", "d_before": "d_snap"},
    ).filter(F.col("_probe_order") == 1)
    state = carried.select(
        *keys, "team", day,
        F.coalesce("p_before", F.lit(0)).alias("p"), F.coalesce("d_before", F.lit(0)).alias("d"),
    )
    w = Window.partitionBy(*keys, day).orderBy(F.desc("p"), F.desc("d"), F.asc("team"))
    return state.withColumn("pos", F.row_number().over(w).cast("long"))


# a grid takes at most this many rows per row of team games, a day's window this many teams
_GRID_SHARE, _GRID_TEAMS = 2, 10_000


def _small_grid(scan: DataFrame, keys: list[str], day: str) -> bool:
    """Whether a (day x team) grid is about as small as the games themselves,
    as in leagues whose teams play often. One pass that combines before its
    shuffle; estimates suffice, as either way gives the same places."""
    groups = scan.groupBy(*keys).agg(
        F.approx_count_distinct("team").alias("t"), F.approx_count_distinct(day).alias("d"), F.count(F.lit(1)).alias("n"))
    most, grid, rows = groups.agg(F.max("t"), F.sum(F.col("t") * F.col("d")), F.sum("n")).first()
    return most is None or (most <= _GRID_TEAMS and grid <= _GRID_SHARE * rows)


def asof_positions(matches: DataFrame, scan: DataFrame, *, cols: MatchCols = DEFAULT) -> DataFrame:
    """Leak-free league position of both sides: the table built from all
    matches of the group strictly before the match date, every team of the
    group included (0 points, 0 goal difference before its first game),
    ordered by points desc, goal difference desc, team asc. A match without a
    date has no position.

    Where teams play seldom, or are many, work is proportional to games times
    the digits of their number: neither a (day x team) grid nor a window over
    a group's teams is built. Where the counted grid is no larger than a small
    multiple of the games, it is the shorter way to the same places.
    """
    keys = list(cols.keys)
    day = [c for c in cols.order if c != cols.match_id][0]
    pos = _grid_places(scan, keys, day) if _small_grid(scan, keys, day) else _places(_spans(scan, keys, day), keys, day)
    hp = pos.select(*keys, F.col("team").alias(cols.home), day, F.col("pos").alias("home_league_position"))
    ap = pos.select(*keys, F.col("team").alias(cols.away), day, F.col("pos").alias("away_league_position"))
    out = matches.join(hp, on=[*keys, cols.home, day], how="left").join(ap, on=[*keys, cols.away, day], how="left")
    return out.withColumn(
        "league_position_diff", F.col("home_league_position") - F.col("away_league_position")
    )
