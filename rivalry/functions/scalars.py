"""Scalar column functions (F1-F19). Every one is a built-in Spark
expression, so it stays inside whole-stage codegen: no Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: colour per outcome word (anything else is gray)
OUTCOME_COLOURS = {"Loss": "red", "Draw": "orange", "Win": "green"}
OTHER_COLOUR = "gray"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def parse_match_date(text, *, strict: bool = True) -> Column:
    """'dd/MM/yy' when shorter than 10 characters, else 'dd/MM/yyyy'.

    Two-digit years follow the 1969-2068 pivot (69..99 -> 19xx); Spark's own
    ``yy`` would give 20xx, so years past 2068 move back a century.
    ``strict`` raises on unparsable text (ANSI ``to_date``); otherwise NULL.
    """
    t = _c(text)
    if strict:
        short, long_ = F.to_date(t, "dd/MM/yy"), F.to_date(t, "dd/MM/yyyy")
    else:
        short, long_ = F.try_to_date(t, "dd/MM/yy"), F.try_to_date(t, "dd/MM/yyyy")
    short = F.when(F.year(short) > 2068, F.add_months(short, -1200)).otherwise(short)
    return F.when(F.length(t) < 10, short).otherwise(long_)


def weekday_name(d) -> Column:
    return F.date_format(_c(d), "EEEE")


def month_name(d) -> Column:
    return F.date_format(_c(d), "MMMM")


def day_of_month(d) -> Column:
    """F2 day part ('%d' then int in the reference)."""
    return F.dayofmonth(_c(d)).cast("long")


def season_from_date(d) -> Column:
    """August starts a season: '2023-24'."""
    d = _c(d)
    y = F.year(d)
    return F.when(F.month(d) < 8, F.concat((y - 1).cast("string"), F.lit("-"), _two(y % 100))).otherwise(
        F.concat(y.cast("string"), F.lit("-"), _two((y + 1) % 100))
    )


def season_code(d) -> Column:
    """four-digit code 'yyYY' of the season containing ``d``: '2324'."""
    d = _c(d)
    y = F.year(d)
    return F.when(F.month(d) < 8, F.concat(_two((y - 1) % 100), _two(y % 100))).otherwise(
        F.concat(_two(y % 100), _two((y + 1) % 100))
    )


def season_start_year(season) -> Column:
    """F5 start year: first four characters."""
    return F.substring(_c(season), 1, 4).cast("long")


def season_end_year(season, *, literal: bool = True) -> Column:
    """F5 end year. ``literal`` keeps the reference's reading (first two
    characters + last two: '1999-00' -> 1900); otherwise start + 1."""
    s = _c(season)
    if literal:
        return F.concat(F.substring(s, 1, 2), F.substring(s, 6, 2)).cast("long")
    return season_start_year(s) + 1


def rebuild_date(month, day, season, *, literal_end_year: bool = True) -> Column:
    """date from month name, day and season: August..December use the
    start year, other months the end year. Invalid -> NULL."""
    m = _c(month)
    mnum = F.month(F.try_to_date(F.concat(m, F.lit("/1/2000")), "MMMM/d/yyyy"))
    year = F.when((mnum >= 8) & (mnum <= 12), season_start_year(season)).otherwise(
        season_end_year(season, literal=literal_end_year)
    )
    text = F.concat_ws("/", m, _c(day).cast("string"), year.cast("string"))
    return F.try_to_date(text, "MMMM/d/yyyy")


def fixture_date_text(date_time_text) -> Column:
    """The date part (first 10 characters) of 'dd/MM/yyyy HH:mm'."""
    return F.substring(_c(date_time_text), 1, 10)


def fixture_time(date_time_text) -> Column:
    """kick-off 'H:mm' (hour without leading zero) from 'dd/MM/yyyy HH:mm'."""
    t = _c(date_time_text)
    return F.concat(F.substring(t, 12, 2).cast("int").cast("string"), F.substring(t, 14, 3))


def fixture_label(home, away) -> Column:
    """F8: 'A v B'."""
    return F.concat_ws(" v ", _c(home), _c(away))


def split_label(label) -> tuple[Column, Column]:
    """F8 inverse: ('A', 'B') from 'A v B'."""
    parts = F.split(_c(label), " v ", 2)
    return parts.getItem(0), parts.getItem(1)


def ordinal_day(day) -> Column:
    """1st 2nd 3rd 4th ... 'th' for 4-20 and 24-30."""
    d = _c(day).cast("int")
    suffix = (
        F.when(((d >= 4) & (d <= 20)) | ((d >= 24) & (d <= 30)), "th")
        .when(d % 10 == 1, "st")
        .when(d % 10 == 2, "nd")
        .otherwise("rd")
    )
    return F.concat(d.cast("string"), suffix)


def pad_left(c, width) -> Column:
    """F10 core: left pad with spaces to ``width`` (a column or int)."""
    w = width if isinstance(width, Column) else F.lit(int(width))
    return F.lpad(_c(c), w.cast("int"), " ")


def score_label(home_goals, away_goals) -> Column:
    """'2-1'."""
    return F.concat(_c(home_goals).cast("string"), F.lit("-"), _c(away_goals).cast("string"))


def display_date(weekday, day, month) -> Column:
    """F11 display date: 'Saturday 2nd December'."""
    return F.concat_ws(" ", _c(weekday), ordinal_day(day), _c(month))


def outcome_word(is_home: Column, code) -> Column:
    """Outcome word of one side from the 0/1/2 result code; 'NA' if unknown."""
    code = _c(code)
    return F.when(
        is_home, F.when(code == 0, "Win").when(code == 1, "Draw").when(code == 2, "Loss")
    ).otherwise(F.when(code == 0, "Loss").when(code == 1, "Draw").when(code == 2, "Win"))


def result_phrase(team, home, away, code) -> Column:
    """'Win v X (H)' from ``team``'s side."""
    is_home = _c(home) == _c(team)
    word = F.coalesce(outcome_word(is_home, code), F.lit("NA"))
    opponent = F.when(is_home, _c(away)).otherwise(_c(home))
    return F.format_string("%s v %s (%s)", word, opponent, F.when(is_home, "H").otherwise("A"))


def result_from_scores(home_pred, away_pred) -> Column:
    """'H' / 'A' / 'D' from two predicted scores."""
    h, a = _c(home_pred), _c(away_pred)
    return F.when(h > a, "H").when(h < a, "A").otherwise("D")


def round_half_even(x) -> Column:
    """banker's rounding to an integer (2.5 -> 2, 3.5 -> 4)."""
    return F.bround(_c(x), 0).cast("long")


def colour_of(word) -> Column:
    """outcome word (first word of a phrase) to colour name."""
    first = F.split(_c(word), " ").getItem(0)
    expr = F.lit(OTHER_COLOUR)
    for k, v in reversed(list(OUTCOME_COLOURS.items())):
        expr = F.when(first == k, v).otherwise(expr)
    return expr


def thousands(x) -> Column:
    """F16: '12,345'."""
    return F.format_number(_c(x).cast("double"), 0)


def merge_maps(*maps) -> Column:
    """union of maps, later keys win. Spark raises on duplicate keys
    unless ``spark.sql.mapKeyDedupPolicy=LAST_WIN``; here duplicates are
    resolved explicitly so the session setting does not matter."""
    cols = [_c(m) for m in maps]
    entries = F.flatten(F.array(*[F.map_entries(m) for m in cols]))
    # keep the last entry per key: reverse, drop later duplicates, rebuild
    rev = F.reverse(entries)
    keys_rev = F.transform(rev, lambda e: e["key"])
    kept = F.filter(
        rev, lambda e, i: F.array_position(keys_rev, e["key"]) == i + 1
    )
    return F.map_from_entries(F.reverse(kept))


def timestamp_text(ts) -> Column:
    """'yyyy-MM-dd HH:mm:ss'."""
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")
