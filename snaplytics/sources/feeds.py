"""The feeds kept as files in one folder: large ones by season and week, dimensions whole, lists as text.

``write`` replaces the folders (season, or season and week) it has rows for and leaves the others; ``read`` goes through the
readers, so that a range of seasons or weeks is a choice of folders and other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from snaplytics.sources import readers
from snaplytics.sources.sinks import write_results, write_text


@dataclass(frozen=True)
class Feed:
    read: Callable[..., DataFrame]
    folders: tuple[str, ...] = ()  # columns whose values name the folders, season first
    text: bool = False
    deal: bool = True  # by folder before writing; not where rows come from an aggregation

    @property
    def by_season(self) -> bool:
        return bool(self.folders)


FEEDS = {
    "plays": Feed(readers.read_plays, ("season", "week")),
    "charting": Feed(readers.read_charting, ("ftn_season",)),
    "player_stats": Feed(readers.read_player_stats, ("season",), deal=False),
    "schedules": Feed(readers.read_schedules, ("season",)),
    "teams": Feed(readers.read_teams),
    "team_logos": Feed(readers.read_team_logos),
    "standings": Feed(readers.read_standings, text=True),
    "award_winners": Feed(readers.read_award_winners, text=True),
}


def _feed(name: str) -> Feed:
    if name not in FEEDS:
        raise ValueError(f"feed {name!r}: one of {', '.join(FEEDS)} is wanted")
    return FEEDS[name]


@dataclass(frozen=True)
class FeedFolder:
    spark: SparkSession
    path: str

    def where(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}"

    def write(self, name: str, df: DataFrame) -> None:
        """Replace the folders that ``df`` has rows for, or the whole table for feeds without seasons."""
        feed = _feed(name)
        if feed.by_season:
            write_results(df, self.where(name), feed.folders, deal=feed.deal)
        elif feed.text:
            write_text(df, self.where(name))
        else:
            df.write.mode("overwrite").parquet(self.where(name))

    def read(self, name: str, seasons: int | Iterable[int] | None = None, **options) -> DataFrame:
        """The feed with checked columns and known types; ``options`` are those of its reader (``weeks``, ``valid_only``)."""
        feed = _feed(name)
        if feed.by_season:
            options["seasons"] = seasons
            if feed.folders[0] != "season":
                options["season_column"] = feed.folders[0]
        elif seasons is not None:
            raise ValueError(f"feed {name!r} is not kept by season")
        return feed.read(self.spark, self.where(name), **options)
