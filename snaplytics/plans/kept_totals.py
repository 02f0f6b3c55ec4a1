"""Weekly totals kept as files: refreshed season by season, and ranged reports served from them.

The reports over any range of weeks need only sums per team and week, which are few. Plays are
read when a season's feeds change, and only that season's; a report reads the kept totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from snaplytics.operators.games import relabel_franchises, team_rows
from snaplytics.operators.plays import join_charting
from snaplytics.operators.team_week import EFF_TOTALS, SIDES, eff_summary, eff_totals, pair_totals
from snaplytics.session import cut_lineage
from snaplytics.sources.feeds import FeedFolder
from snaplytics.sources.readers import season_filter
from snaplytics.sources.sinks import replace_seasons


@dataclass(frozen=True)
class KeptTotals:
    spark: SparkSession
    path: str

    def where(self, side: str) -> str:
        return f"{self.path.rstrip('/')}/{side}_eff_totals"

    def refresh(self, feeds: FeedFolder, seasons: Sequence[int]) -> None:
        """Build the totals of ``seasons`` anew from the feeds; other seasons stay as they are.

        A season whose plays are gone loses its totals. Plays are read and joined once for both sides.
        """
        seasons = sorted(set(seasons))
        plays = feeds.read("plays", seasons, valid_only=True)
        pairs = cut_lineage(pair_totals(join_charting(plays, feeds.read("charting", seasons))))
        games, logos = team_rows(feeds.read("schedules", seasons)), feeds.read("team_logos")
        for side in SIDES:
            replace_seasons(cut_lineage(eff_totals(pairs, games, logos, side)), self.where(side), seasons)

    def totals(self, side: str, seasons: int | Sequence[int] | None = None) -> DataFrame:
        kept = self.spark.read.parquet(self.where(side))
        kept = kept if seasons is None else kept.filter(season_filter(seasons))
        return kept.select("season", "week", "season_type", "team", "type", *EFF_TOTALS, "pts", "team_logo")

    def summary(
        self,
        side: str,
        standings: DataFrame,
        weeks: tuple[int, int] | None = None,
        team: str | None = None,
        seasons: int | Sequence[int] | None = None,
        franchise_moves: dict[str, str] | None = None,
    ) -> DataFrame:
        """Rates, ranks and records as ``eff_summary`` gives them, without reading a play."""
        if franchise_moves is not None:
            standings = relabel_franchises(standings, franchise_moves)
        return eff_summary(self.totals(side, seasons), standings, weeks, team)
