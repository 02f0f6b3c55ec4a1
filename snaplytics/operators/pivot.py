"""Team summaries by dimensions the user names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.functions.columns import dimension_list
from snaplytics.functions.nulls import ratio0
from snaplytics.operators.plays import flag_explosive, in_weeks, valid_plays
from snaplytics.operators.team_week import play_totals

# Measures in display order.
MEASURES = (
    "tot_plays", "tot_yds", "epa_per_play", "sr", "passes", "passing_yds", "dropback_epa", "dropback_sr",
    "dropback_explosive", "rushes", "rushing_yds", "rush_epa", "rush_sr", "rush_explosive",
)


def pivot_summary(plays: DataFrame, dims: str | Iterable[str], weeks: tuple[int, int] | None = None) -> DataFrame:
    """Measures per team and ``dims`` (a list, or text like ``"offense_personnel, week"``).

    Plays without a formation are left out; a rate over no plays is 0.
    """
    dims = dimension_list(plays, dims)
    keys = list(dict.fromkeys(["posteam", *dims]))
    rows = in_weeks(flag_explosive(valid_plays(plays)).dropna(subset=["offense_formation"]), weeks)
    used = {n: t for n, t in play_totals().items() if n not in ("interceptions", "lost_fumbles")}
    clash = sorted({*used, *MEASURES} & set(keys))
    if clash:
        raise ValueError(f"dimension(s) named like a measure: {', '.join(clash)}")
    c = F.col
    measures = {
        "tot_plays": c("total_passes") + c("total_rushes"),
        "tot_yds": c("passing_yds") + c("rushing_yds"),
        "epa_per_play": ratio0(c("total_epa"), c("total_plays")),
        "sr": ratio0(c("total_success"), c("total_plays")),
        "passes": c("total_passes"),
        "passing_yds": c("passing_yds"),
        "dropback_epa": ratio0(c("total_pass_epa"), c("total_passes")),
        "dropback_sr": ratio0(c("total_pass_success"), c("total_passes")),
        "dropback_explosive": ratio0(c("total_pass_explosive"), c("total_passes")),
        "rushes": c("total_rushes"),
        "rushing_yds": c("rushing_yds"),
        "rush_epa": ratio0(c("total_rush_epa"), c("total_rushes")),
        "rush_sr": ratio0(c("total_rush_success"), c("total_rushes")),
        "rush_explosive": ratio0(c("total_rush_explosive"), c("total_rushes")),
    }
    return (
        rows.groupBy(*keys)
        .agg(*[t.alias(n) for n, t in used.items()])
        .select(*keys, *[measures[m].alias(m) for m in MEASURES])
    )


def in_season(plays: DataFrame, season: int | None) -> DataFrame:
    return plays if season is None else plays.filter(F.col("season") == season)


def pivot_table(
    plays: DataFrame,
    team: str,
    dims: str | Iterable[str],
    weeks: tuple[int, int] | None = None,
    season: int | None = None,
) -> DataFrame:
    """One team's pivot, most plays first; over all seasons that are loaded unless one is named."""
    dims = dimension_list(plays, dims)
    rows = pivot_summary(in_season(plays, season), dims, weeks).filter(F.col("posteam") == team)
    order = [F.col("tot_plays").desc_nulls_last(), *[F.col(d).asc_nulls_last() for d in dims]]
    return rows.select(*dims, *MEASURES).orderBy(*order)


def personnel_table(plays: DataFrame, team: str, week: int, season: int | None = None) -> DataFrame:
    """One team's week by personnel group; that week of all seasons that are loaded unless one is named."""
    rows = pivot_summary(in_season(plays, season), ["week", "offense_personnel"], (week, week)).filter(F.col("posteam") == team)
    return rows.select("offense_personnel", *MEASURES)
