"""Receiver tables: charting counts per game, reconciled with the official statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.functions.columns import cols_between
from snaplytics.functions.nulls import ratio, strict_sum
from snaplytics.operators.plays import in_weeks, valid_targets

# Fixed values.
RECEIVER_POSITIONS = ("WR", "TE", "RB")

# Official columns inside the receiving run that the report leaves out.
LEFT_OUT = {
    "receiving_fumbles",
    "receiving_fumbles_lost",
    "receiving_first_downs",
    "receiving_2pt_conversions",
    "racr",
    "receiving_air_yards",
}


def charting_counts(charted: DataFrame) -> DataFrame:
    """Targets per season, team, week and receiver by how they were charted.

    Unknown flags make a count unknown, also when multiplied by a known "no".
    """
    catchable = F.col("is_catchable_ball").cast("int")
    contested = F.col("is_contested_ball").cast("int")
    return (
        valid_targets(charted)
        .groupBy("season", "posteam", "week", "receiver_player_id", "receiver_player_name")
        .agg(
            F.count(F.lit(1)).alias("targets_pbp"),
            strict_sum("complete_pass").alias("receptions_pbp"),
            strict_sum(catchable * contested).alias("catchable_contested"),
            strict_sum(catchable * (1 - contested)).alias("catchable_not_contested"),
            strict_sum(1 - catchable).alias("not_catchable"),
            strict_sum(F.col("is_created_reception").cast("int")).alias("created_receptions"),
            strict_sum(F.col("is_drop").cast("int")).alias("drops"),
            strict_sum("epa").alias("total_epa"),
        )
    )


def receiving_columns(player_stats: DataFrame) -> list[str]:
    """The official receiving run: ``receptions`` to ``air_yards_share``, or to the end without the latter."""
    last = "air_yards_share" if "air_yards_share" in player_stats.columns else None
    run = cols_between(player_stats, "receptions", last)
    return [c for c in dict.fromkeys(["targets", *run]) if c not in LEFT_OUT]


def receiver_qc(charted: DataFrame, player_stats: DataFrame) -> DataFrame:
    """Play-derived against official targets, receptions and value, per receiver and week.

    Receivers without official statistics stay, with unknown differences.
    """
    receiving = receiving_columns(player_stats)
    official = player_stats.select(
        "season",
        "week",
        F.col("player_id").alias("receiver_player_id"),
        "player_display_name",
        "position",
        "headshot_url",
        *receiving,
    )
    counts = charting_counts(charted)
    joined = counts.join(official, ["season", "week", "receiver_player_id"], "left")
    return joined.select(
        *counts.columns,
        *[c for c in official.columns if c not in ("season", "week", "receiver_player_id")],
        ratio(F.col("receiving_epa"), F.col("targets_pbp")).alias("epa_per_target"),
        (F.col("targets_pbp") - F.col("targets")).alias("targets_diff"),
        (F.col("receptions_pbp") - F.col("receptions")).alias("receptions_diff"),
        (F.col("total_epa") - F.col("receiving_epa")).alias("epa_diff"),
    )


# Leading columns of the receiver table.
FIRST = (
    "receiver_player_id", "player_display_name", "position", "headshot_url", "season", "posteam", "week",
    "targets_pbp", "targets", "targets_diff", "receptions_pbp", "receptions", "receptions_diff", "drops",
)


def receiver_game(charted: DataFrame, player_stats: DataFrame, positions=RECEIVER_POSITIONS) -> DataFrame:
    """The reconciled table of receivers at the given positions, leading columns first."""
    rows = receiver_qc(charted, player_stats).drop("receiver_player_name").filter(F.col("position").isin(*positions))
    return rows.select(*FIRST, *[c for c in rows.columns if c not in FIRST])


def receiver_breakdown(games: DataFrame, weeks: tuple[int, int] | None = None) -> DataFrame:
    """Receivers of every team over a range of weeks.

    Targets, receptions and value are the official ones, the charted counts come from plays.
    """
    keys = ["season", "posteam", "headshot_url", "player_display_name", "position"]
    counts = "targets receptions catchable_contested catchable_not_contested not_catchable created_receptions drops"
    totals = [strict_sum(c).alias(c) for c in counts.split()]
    summed = in_weeks(games, weeks).groupBy(*keys).agg(*totals, strict_sum("receiving_epa").alias("total_epa"))
    return summed.select(
        *keys,
        *("targets", "receptions", "catchable_contested", "catchable_not_contested", "not_catchable"),
        ratio(F.col("not_catchable"), F.col("targets")).alias("not_catchable_rate"),
        *("created_receptions", "drops", "total_epa"),
        ratio(F.col("total_epa"), F.col("targets")).alias("epa_per_target"),
    )


def receiver_table(games: DataFrame, team: str, weeks: tuple[int, int] | None = None, season: int | None = None) -> DataFrame:
    """One team's breakdown, most targets first."""
    rows = games.filter(F.col("posteam") == team)
    if season is not None:
        rows = rows.filter(F.col("season") == season)
    table = receiver_breakdown(rows, weeks).orderBy(
        F.col("targets").desc_nulls_last(), "player_display_name", "headshot_url", "season"
    )
    return table.drop("posteam") if season is None else table.drop("posteam", "season")
