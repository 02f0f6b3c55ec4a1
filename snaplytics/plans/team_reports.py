"""Team and receiver result tables of some seasons.

The plays are read and joined twice in all: once for the four team tables together, once
(passes only) for the receivers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from snaplytics.operators.games import team_rows
from snaplytics.operators.plays import join_charting
from snaplytics.operators.receivers import receiver_game
from snaplytics.operators.team_week import SIDES, eff_totals, pair_totals, week_report
from snaplytics.session import cut_lineage
from snaplytics.sources.sinks import write_results


@dataclass(frozen=True)
class TeamSources:
    plays: DataFrame
    charting: DataFrame
    schedules: DataFrame
    logos: DataFrame
    player_stats: DataFrame


def team_result_tables(src: TeamSources) -> dict[str, DataFrame]:
    """The tables behind the team pages: weekly reports, effectiveness totals, receiver games."""
    charted = join_charting(src.plays, src.charting)
    pairs = cut_lineage(pair_totals(charted))
    games = team_rows(src.schedules)
    tables = {"receiver_game": receiver_game(charted, src.player_stats)}
    for side in SIDES:
        tables[f"{side}_week_report"] = week_report(pairs, games, src.logos, side)
        tables[f"{side}_eff_totals"] = eff_totals(pairs, games, src.logos, side)
    return tables


def write_team_results(src: TeamSources, folder: str) -> list[str]:
    """Writes every team result table as parquet by season; returns the table names."""
    tables = team_result_tables(src)
    for name, table in tables.items():
        write_results(table, f"{folder}/{name}")
    return list(tables)
