"""Form strings, form points and streak flags (W8, W9), goal and points
differences (PRJ11) and scaling by round (PRJ10). All are in-row column
expressions: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivalry.operators.teamgames import FORM_DEPTH


def letter_points(c: Column) -> Column:
    return F.when(c == "W", 3).when(c == "D", 1).otherwise(0)


def form_string(prefix: str, depth: int = FORM_DEPTH) -> Column:
    """Concatenated letters, newest first (``hm1 || hm2 || ...``)."""
    return F.concat(*[F.col(f"{prefix}{k}") for k in range(1, depth + 1)])


def form_points(prefix: str, depth: int = FORM_DEPTH) -> Column:
    """Sum of points of the form letters; M and L count 0."""
    total = letter_points(F.col(f"{prefix}1"))
    for k in range(2, depth + 1):
        total = total + letter_points(F.col(f"{prefix}{k}"))
    return total.cast("long")


def add_form_cols(df: DataFrame, home: str = "hm", away: str = "am") -> DataFrame:
    """``htformptsstr``/``atformptsstr`` and ``htformpts``/``atformpts``."""
    return (
        df.withColumn("htformptsstr", form_string(home))
        .withColumn("atformptsstr", form_string(away))
        .withColumn("htformpts", form_points(home))
        .withColumn("atformpts", form_points(away))
    )


def add_streaks(df: DataFrame, *, newest_three: bool = False) -> DataFrame:
    """Eight 0/1 flags, win/loss streaks of 3 and 5, home and away.

    Block mode (default) reads the last three characters of the newest-first
    form string, i.e. the oldest three games of the five; ``newest_three``
    reads the first three instead (as-of mode)."""
    out = df
    for side, col in (("ht", "htformptsstr"), ("at", "atformptsstr")):
        s = F.col(col)
        three = F.substring(s, 1, 3) if newest_three else F.substring(s, -3, 3)
        out = (
            out.withColumn(f"{side}winstreak3", (three == "WWW").cast("long"))
            .withColumn(f"{side}winstreak5", (s == "WWWWW").cast("long"))
            .withColumn(f"{side}lossstreak3", (three == "LLL").cast("long"))
            .withColumn(f"{side}lossstreak5", (s == "LLLLL").cast("long"))
        )
    return out


def add_differences(df: DataFrame) -> DataFrame:
    """PRJ11: goal differences and points differences."""
    return (
        df.withColumn("htgd", F.col("htgs") - F.col("htgc"))
        .withColumn("atgd", F.col("atgs") - F.col("atgc"))
        .withColumn("diffpts", F.col("htp") - F.col("atp"))
        .withColumn("diffformpts", F.col("htformpts") - F.col("atformpts"))
    )


SCALED = ("htgd", "atgd", "diffpts", "diffformpts", "htp", "atp")


def scale_by_round(df: DataFrame, columns=SCALED, round_col: str = "mw") -> DataFrame:
    """PRJ10: divide columns by the round number as doubles (round >= 1)."""
    out = df
    for c in columns:
        out = out.withColumn(c, F.col(c) / F.col(round_col).cast("double"))
    return out
