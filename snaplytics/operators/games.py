"""Schedules, results, points and standings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplytics.functions.columns import require
from snaplytics.functions.nulls import strict_sum, text_or_na

# Team codes left out of the team list, and codes of moved franchises.
RETIRED_TEAMS = ("LAR", "OAK", "STL", "SD")
FRANCHISE_MOVES = {"OAK": "LV", "SD": "LAC", "STL": "LA"}


def current_teams(teams: DataFrame, retired: Iterable[str] = RETIRED_TEAMS) -> DataFrame:
    """Teams whose code is not in ``retired``; a missing code stays."""
    code = F.col("team_abbr")
    return teams.filter(~code.isin(*retired) | code.isNull())


def team_rows(schedules: DataFrame, invert: Iterable[str] = ()) -> DataFrame:
    """Each game as two rows, one per team, in one pass over the games.

    ``home_*`` and ``away_*`` become ``team*`` and ``opponent*`` as seen by each team;
    columns in ``invert`` change sign on the away team's row.
    """
    invert = set(require(schedules, invert))
    home = [c for c in schedules.columns if c.startswith("home_")]
    away = [c for c in schedules.columns if c.startswith("away_")]
    rest = [c for c in schedules.columns if c not in {*home, *away}]

    def renamed(column: str, own: str) -> str:
        side, name = column.split("_", 1)
        prefix = "team" if side == own else "opponent"
        return prefix if name == "team" else f"{prefix}_{name}"

    names = [renamed(c, "home") for c in [*home, *away]]

    def seen_by(own: str) -> Column:
        by_name = {renamed(c, own): F.col(c) for c in [*home, *away]}
        shared = [(-F.col(c) if own == "away" and c in invert else F.col(c)).alias(c) for c in rest]
        return F.struct(*shared, *[by_name[n].alias(n) for n in names])

    return schedules.select(F.inline(F.array(seen_by("home"), seen_by("away"))))


def with_result(games: DataFrame) -> DataFrame:
    """W, L or T for the team; NULL before the game is played."""
    own, other = F.col("team_score"), F.col("opponent_score")
    return games.withColumn("result", F.when(own < other, "L").when(own > other, "W").when(own == other, "T"))


def score_text() -> Column:
    return F.concat(text_or_na(F.col("team_score")), F.lit("-"), text_or_na(F.col("opponent_score")))


def team_week_points(games: DataFrame, points: str) -> DataFrame:
    """``points`` (the team's or the opponent's score) per team and week."""
    require(games, [points])
    return games.groupBy("season", "team", "week").agg(strict_sum(points).alias("pts"))


def relabel_franchises(standings: DataFrame, moves: Mapping[str, str] = FRANCHISE_MOVES) -> DataFrame:
    return standings.replace(dict(moves), subset=["team"])
