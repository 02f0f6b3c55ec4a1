"""Columns each source must have, with the types the jobs work on.

A source may carry any further column; plays in particular keep them all, since any
of them can be asked for as a pivot dimension.
"""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)


def _struct(**kinds: str) -> StructType:
    types = {"int": IntegerType(), "double": DoubleType(), "string": StringType(), "bool": BooleanType()}
    return StructType(
        [StructField(name, types[kind], True) for kind, names in kinds.items() for name in names.split()]
    )


# Column names of the public play-by-play feeds.
PLAYS = _struct(
    string="game_id season_type posteam defteam play_type receiver_player_id receiver_player_name "
    "offense_formation offense_personnel",
    int="season week pass rush success interception fumble_lost complete_pass two_point_attempt",
    double="epa yards_gained passing_yards rushing_yards",
)
CHARTING = _struct(
    string="nflverse_game_id",
    bool="is_no_huddle is_catchable_ball is_contested_ball is_created_reception is_drop",
)
PLAYER_STATS = _struct(
    string="player_id player_name player_display_name position headshot_url recent_team season_type",
    int="season week completions attempts passing_yards rushing_yards passing_tds rushing_tds "
    "interceptions targets receptions",
    double="passing_epa receiving_epa",
)
SCHEDULES = _struct(
    string="home_team away_team",
    int="season week home_score away_score home_rest away_rest",
    double="spread_line",
)
TEAMS = _struct(string="team_abbr")
TEAM_LOGOS = _struct(string="team_abbr team_logo_espn team_wordmark")
STANDINGS = _struct(int="season wins losses ties", string="team")
AWARD_WINNERS = _struct(int="Year", string="Player Pos")

PLAY_KEY = ("game_id", "play_id")
CHARTING_KEY = ("nflverse_game_id", "nflverse_play_id")
# The play number is text in some feeds and a number (even a double) in others.
LOOSE_KEYS = {"play_id", "nflverse_play_id"}
