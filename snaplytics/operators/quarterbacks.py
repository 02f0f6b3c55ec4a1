"""The quarterback season table behind the award model."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.functions.columns import cols_between
from snaplytics.functions.nulls import lenient_sum
from snaplytics.functions.ranks import RankSpec, average_rank, ordinal_ranks
from snaplytics.operators.games import FRANCHISE_MOVES


@dataclass(frozen=True)
class AwardRules:
    """What enters the model. The defaults are the published choice of seasons and cut-off."""

    first_season: int = 2003
    left_out_seasons: tuple[int, ...] = (2000, 2005, 2006, 2012)
    min_attempts: int = 150
    position: str = "QB"
    season_type: str = "REG"
    franchise_moves: dict[str, str] = field(default_factory=lambda: dict(FRANCHISE_MOVES))
    train_last_season: int = 2019
    train_left_out: tuple[int, ...] = (2005, 2006, 2012)
    test_first_season: int = 2020


SEASON_RANKS = (
    RankSpec("cmp_rank", "total_cmp"),
    RankSpec("att_rank", "total_attempts"),
    RankSpec("yds_rank", "total_yards"),
    RankSpec("tds_rank", "total_tds"),
    RankSpec("int_rank", "total_interceptions", descending=False),
    RankSpec("epa_rank", "mean_epa"),
)
KEY = ("team", "player_display_name", "player_id")


def _not_in(column: str, values: Iterable):
    values = list(values)
    return ~F.col(column).isin(*values) if values else F.lit(True)


def qb_season(player_stats: DataFrame, rules: AwardRules = AwardRules()) -> DataFrame:
    """Season totals per quarterback and team, for those with enough attempts."""
    return (
        player_stats.filter((F.col("season_type") == rules.season_type) & (F.col("position") == rules.position))
        .filter((F.col("season") >= rules.first_season) & _not_in("season", rules.left_out_seasons))
        .groupBy("season", F.col("recent_team").alias("team"), "player_display_name", "player_id")
        .agg(
            lenient_sum("completions").alias("total_cmp"),
            lenient_sum("attempts").alias("total_attempts"),
            # A week with either part missing counts for neither.
            lenient_sum(F.col("passing_yards") + F.col("rushing_yards")).alias("total_yards"),
            lenient_sum(F.col("passing_tds") + F.col("rushing_tds")).alias("total_tds"),
            lenient_sum("interceptions").alias("total_interceptions"),
            F.avg("passing_epa").alias("mean_epa"),
        )
        .filter(F.col("total_attempts") >= rules.min_attempts)
    )


def qb_ranks(season_rows: DataFrame) -> DataFrame:
    """Six ranks within the season, ties in order of team, name and id."""
    ranked = ordinal_ranks(season_rows, SEASON_RANKS, ["season"], KEY)
    return ranked.select(
        *("season", "player_display_name", "player_id"),
        *[s.name for s in SEASON_RANKS],
        *("team", "total_interceptions"),
    )


def with_win_rank(ranks: DataFrame, standings: DataFrame) -> DataFrame:
    """Adds the team's wins and their rank among the season's quarterbacks, ties averaged."""
    joined = ranks.join(standings.select("season", "team", "wins"), ["season", "team"], "left")
    return average_rank(joined.select(*ranks.columns, "wins"), "wins", ["season"], "win_rank")


def winners(award: DataFrame, first_season: int) -> DataFrame:
    return award.filter(F.col("Year") >= first_season).select(
        F.col("Player").alias("player_display_name"),
        F.col("Pos").alias("position"),
        F.lit(1.0).alias("mvp"),
        F.col("Year").alias("season"),
    )


def with_award(ranked: DataFrame, won: DataFrame) -> DataFrame:
    """Adds ``mvp`` (1 or 0), matched by season and name.

    A winner who played for two teams gets two positive rows, as names are all there is.
    """
    joined = ranked.join(won.drop("position"), ["season", "player_display_name"], "left").fillna({"mvp": 0})
    first = ["season", "player_display_name", "player_id", "team"]
    return joined.select(*first, *[c for c in joined.columns if c not in first])


def by_season_and_name(labelled: DataFrame) -> DataFrame:
    order = ["season", "player_display_name", "team", "player_id"]
    return labelled.orderBy(*[F.col(c).asc_nulls_last() for c in order])


def missing_cells(labelled: DataFrame) -> DataFrame:
    """Number of missing model cells times number of rows: 0 exactly when complete."""
    cells = sum((F.col(c).isNull().cast("int") for c in cols_between(labelled, "cmp_rank")), F.lit(0))
    total = labelled.agg(F.sum(cells).alias("n"), F.count(F.lit(1)).alias("rows"))
    return total.select((F.coalesce(F.col("n"), F.lit(0)) * F.col("rows")).alias("num_missing"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing values not counted."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def training_rows(labelled: DataFrame, rules: AwardRules = AwardRules()) -> DataFrame:
    season = F.col("season")
    inside = season.between(rules.first_season, rules.train_last_season)
    return labelled.filter(inside & _not_in("season", rules.train_left_out))


def testing_rows(labelled: DataFrame, rules: AwardRules = AwardRules()) -> DataFrame:
    return labelled.filter(F.col("season") >= rules.test_first_season)
