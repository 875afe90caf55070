"""build_features: the whole per-match feature table (M3) as one lineage.

Block mode reproduces the reference: rounds are cut every ``block`` rows of a
season in match order and every team's state is read after its first
``min(j, n)`` games. As-of mode is leak-free: each side's state strictly
before the match, form from its previous games, table position from all
matches before the match date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivalry.functions.scalars import day_of_month, month_name, weekday_name
from rivalry.operators.form import add_differences, add_form_cols, add_streaks, scale_by_round
from rivalry.operators.joins import keyed_attach
from rivalry.operators.projections import encode_result
from rivalry.operators.standings import asof_positions, block_positions, fill_away_position
from rivalry.operators.teamgames import (
    DEFAULT,
    FORM_DEPTH,
    MatchCols,
    attach_block_state,
    block_slice,
    form_letters,
    indexed_games_scan,
    match_index,
    team_games_scan,
)


def block_state(matches: DataFrame, *, cols: MatchCols = DEFAULT, block: int = 10, letters: bool = True) -> DataFrame:
    """W1 + W3-W5 + W7 in block mode: one row per match with ``i, j, mw``,
    ``htgs atgs htgc atgc htp atp`` and form letters ``hm1..5 am1..5`` (or,
    without ``letters``, the form texts ``hform aform``)."""
    indexed = match_index(matches, cols=cols, block=block)
    # the states need a team's running values only
    scan = indexed_games_scan(indexed, cols=cols, block=block, form_depth=FORM_DEPTH - 1, keep=[*cols.keys, "team", "res"])
    return attach_block_state(indexed, scan, cols=cols, letters=letters)


def asof_state(matches: DataFrame, *, cols: MatchCols = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """W3-W5 + W7 in as-of mode: each side's totals over its earlier games
    of the group and its previous five results ('M' where fewer)."""
    scan = team_games_scan(matches, cols=cols, form_depth=FORM_DEPTH)
    side = scan.select(
        cols.match_id, "venue",
        (F.col("cum_gf") - F.col("gf")).alias("gs"),
        (F.col("cum_ga") - F.col("ga")).alias("gc"),
        (F.col("cum_pts") - F.col("pts")).alias("p"),
        *[F.coalesce(F.col(f"res_lag{k}"), F.lit("M")).alias(f"m{k}") for k in range(1, FORM_DEPTH + 1)],
    )
    h = side.filter(F.col("venue") == "H").drop("venue")
    a = side.filter(F.col("venue") == "A").drop("venue")
    h = h.select(cols.match_id, *[F.col(c).alias(f"h{c if c.startswith('m') else 't' + c}") for c in h.columns[1:]])
    a = a.select(cols.match_id, *[F.col(c).alias(f"a{c if c.startswith('m') else 't' + c}") for c in a.columns[1:]])
    out = matches.join(h, on=cols.match_id, how="inner").join(a, on=cols.match_id, how="inner")
    return out, scan


def build_features(
    matches: DataFrame,
    *,
    cols: MatchCols = DEFAULT,
    block: int = 10,
    mode: str = "block",
    scale: bool = True,
    streaks: bool = False,
    date_col: str = "match_date",
    values: DataFrame | None = None,
) -> DataFrame:
    """M3 feature table, one row per match.

    Columns: keys, match id, teams, ``htgs atgs htgc atgc htp atp``,
    ``hm1..5 am1..5``, ``mw``, ``htformpts atformpts htgd atgd diffpts
    diffformpts``, ``home_league_position away_league_position
    league_position_diff``, ``match_day_day match_day_month match_day_date``
    and ``ftr`` encoded 0/1/2. ``scale`` divides the six point/goal columns
    by ``mw`` (block mode only). ``values`` (match id and more columns) are
    attached by match id (J5) to the few columns that the rest is derived from;
    they come last, with the mark for :func:`raise_unmatched`.
    """
    if mode == "block":
        state = block_state(matches, cols=cols, block=block, letters=False)
        state = state.withColumn("htgd", F.col("htgs") - F.col("htgc")).withColumn("atgd", F.col("atgs") - F.col("atgc"))
        # what is derived in the row comes behind the steps that shuffle and write
        carried = [*cols.keys, cols.match_id, date_col, cols.home, cols.away, cols.result, "i", "mw",
                   "htgs", "atgs", "htgc", "atgc", "htp", "atp", "hform", "aform", "home_league_position", "away_pos_raw"]
        # dealt by slice once: a block lies in one slice, and so does what the fill scans at a time
        state = state.withColumn("_slice", block_slice(block)).repartition(*cols.keys, "_slice")
        placed = block_positions(state, cols=cols, within=["_slice"]).select(*dict.fromkeys(carried), "_slice")
        feats = fill_away_position(placed, cols=cols, slices="_slice")
        if values is not None:
            feats = keyed_attach(feats, values, key=cols.match_id, mark=True)
        feats = add_differences(add_form_cols(form_letters(feats)))
    elif mode == "asof":
        state, scan = asof_state(matches, cols=cols)
        feats = add_differences(add_form_cols(state))
        idx = match_index(matches.select(*cols.keys, *cols.order), cols=cols, block=block).select(
            cols.match_id, "mw"
        )
        feats = feats.join(idx, on=cols.match_id, how="inner")
        pos = asof_positions(matches, scan, cols=cols).select(
            cols.match_id, "home_league_position", "away_league_position", "league_position_diff"
        )
        feats = feats.join(pos, on=cols.match_id, how="inner")
        if values is not None:
            feats = keyed_attach(feats, values, key=cols.match_id, mark=True)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if streaks:
        feats = add_streaks(feats, newest_three=(mode == "asof"))
    if scale and mode == "block":
        feats = scale_by_round(feats)
    d = F.col(date_col)
    feats = (
        feats.withColumn("match_day_day", weekday_name(d))
        .withColumn("match_day_month", month_name(d))
        .withColumn("match_day_date", day_of_month(d))
        .withColumn(cols.result, encode_result(F.col(cols.result)))
    )
    keep = [
        *cols.keys, cols.match_id, date_col, cols.home, cols.away,
        "htgs", "atgs", "htgc", "atgc", "htp", "atp",
        *[f"hm{k}" for k in range(1, 6)], *[f"am{k}" for k in range(1, 6)],
        "mw", "htformpts", "atformpts", "htgd", "atgd", "diffpts", "diffformpts",
        "home_league_position", "away_league_position", "league_position_diff",
        "match_day_day", "match_day_month", "match_day_date", cols.result,
    ]
    if streaks:
        keep += [c for c in feats.columns if "streak" in c]
    if values is not None:
        keep += [*[c for c in values.columns if c != cols.match_id], "_unmatched"]
    seen, cols_out = set(), []
    for c in keep:
        if c not in seen:
            seen.add(c)
            cols_out.append(c)
    return feats.select(*cols_out)
