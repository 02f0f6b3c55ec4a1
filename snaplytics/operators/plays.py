"""Play-level filters, flags and the play-charting join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplytics.functions.columns import cols_between, require
from snaplytics.schemas import CHARTING_KEY, PLAY_KEY

# Fixed values.
EXPLOSIVE_PASS_YARDS = 20
EXPLOSIVE_RUN_YARDS = 10


def join_charting(plays: DataFrame, charting: DataFrame, first_flag: str = "is_no_huddle") -> DataFrame:
    """Plays with their charting columns (``first_flag`` to the last); plays without charting drop out.

    The one join of two large tables. Its key is unique per play, so it spreads evenly
    by itself; tables stored with ``write_bucketed`` join without a shuffle. The play comes first
    in the key: plays of a week begin alike in their game, which makes sorting by game slow.
    """
    flags = cols_between(charting, first_flag)
    clash = sorted(set(flags) & set(plays.columns))
    if clash:
        raise ValueError(f"columns in both plays and charting: {', '.join(clash)}")
    right = charting.select(*CHARTING_KEY, *flags)
    on = [plays[p] == right[c] for p, c in reversed([*zip(PLAY_KEY, CHARTING_KEY)])]
    return plays.join(right, on, "inner").drop(*CHARTING_KEY)


def is_play() -> Column:
    return F.col("epa").isNotNull() & ((F.col("pass") == 1) | (F.col("rush") == 1))


def valid_plays(plays: DataFrame, team: str = "posteam") -> DataFrame:
    """Passes and runs with a value and a team; ``team`` names the team column."""
    require(plays, [team])
    return plays.filter(is_play() & F.col(team).isNotNull())


def valid_targets(plays: DataFrame) -> DataFrame:
    """Passes thrown at a known receiver, without two-point attempts and nullified plays."""
    return plays.filter(
        F.col("epa").isNotNull()
        & F.col("posteam").isNotNull()
        & (F.col("pass") == 1)
        & (F.col("two_point_attempt") != 1)
        & (F.col("play_type") != "no_play")
        & F.col("receiver_player_id").isNotNull()
    )


def _flag(condition: Column) -> Column:
    return F.when(condition, 1).when(~condition, 0)  # unknown stays NULL


def flag_explosive(
    plays: DataFrame, pass_yards: int = EXPLOSIVE_PASS_YARDS, run_yards: int = EXPLOSIVE_RUN_YARDS
) -> DataFrame:
    return plays.withColumns(
        {
            "explosive_pass": _flag((F.col("pass") == 1) & (F.col("yards_gained") >= pass_yards)),
            "explosive_run": _flag((F.col("rush") == 1) & (F.col("yards_gained") >= run_yards)),
        }
    )


def in_weeks(df: DataFrame, weeks: tuple[int, int] | None) -> DataFrame:
    """Rows from the first to the last of two weeks; all rows for None."""
    return df if weeks is None else df.filter(F.col("week").between(min(weeks), max(weeks)))


def week_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("week").alias("first_week"), F.max("week").alias("last_week"))


def distinct_weeks(df: DataFrame) -> DataFrame:
    return df.select("week").distinct()
