"""Weekly team statistics, effectiveness totals and the reports on them.

Every measure is a sum over plays or a ratio of two such sums. ``pair_totals`` adds the
plays up once, per game and pair of teams; offense and defense, weekly and ranged tables
all come from those few rows: the play table is scanned and joined once for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snaplytics.functions.columns import cols_between
from snaplytics.functions.nulls import lenient_sum, ratio, strict_sum
from snaplytics.functions.ranks import min_rank
from snaplytics.operators.games import score_text, team_week_points, with_result
from snaplytics.operators.plays import flag_explosive, in_weeks, is_play

# The ranked rates, and the totals behind them.
WEEK_RATES = (
    "epa_per_play",
    "sr",
    "dropback_epa",
    "dropback_sr",
    "dropback_explosive",
    "rush_epa",
    "rush_sr",
    "rush_explosive",
)
# side -> (team column, opponent column, a high rate is good, score column)
SIDES = {
    "offense": ("posteam", "defteam", True, "team_score"),
    "defense": ("defteam", "posteam", False, "opponent_score"),
}
STRICT_TOTALS = (
    "total_epa",
    "total_success",
    "total_pass_epa",
    "total_passes",
    "total_pass_success",
    "total_rush_epa",
    "total_rushes",
    "total_rush_success",
)
LENIENT_TOTALS = (
    "total_plays",
    "total_pass_explosive",
    "total_rush_explosive",
    "interceptions",
    "lost_fumbles",
    "passing_yds",
    "rushing_yds",
)
EFF_TOTALS = (
    "total_epa",
    "total_plays",
    "total_success",
    "total_pass_epa",
    "total_passes",
    "total_pass_success",
    "total_pass_explosive",
    "total_rush_epa",
    "total_rushes",
    "total_rush_success",
    "total_rush_explosive",
)


def _side(side: str) -> tuple[str, str, bool, str]:
    if side not in SIDES:
        raise ValueError(f"side must be one of {', '.join(SIDES)}")
    return SIDES[side]


def play_totals() -> dict:
    """The additive measures of a group of plays, by name."""
    epa, success, passes, rushes = (F.col(c) for c in ("epa", "success", "pass", "rush"))
    return {
        "total_plays": F.count(F.lit(1)),
        "total_epa": strict_sum(epa),
        "total_success": strict_sum(success),
        "total_passes": strict_sum(passes),
        "total_pass_epa": strict_sum(epa * passes),
        "total_pass_success": strict_sum(success * passes),
        "total_pass_explosive": lenient_sum("explosive_pass"),
        "total_rushes": strict_sum(rushes),
        "total_rush_epa": strict_sum(epa * rushes),
        "total_rush_success": strict_sum(success * rushes),
        "total_rush_explosive": lenient_sum("explosive_run"),
        "interceptions": lenient_sum("interception"),
        "lost_fumbles": lenient_sum("fumble_lost"),
        "passing_yds": lenient_sum("passing_yards"),
        "rushing_yds": lenient_sum("rushing_yards"),
    }


def pair_totals(plays: DataFrame) -> DataFrame:
    """Totals per season, week and (posteam, defteam)."""
    return (
        flag_explosive(plays.filter(is_play()))
        .groupBy("season", "week", "season_type", "posteam", "defteam")
        .agg(*[c.alias(n) for n, c in play_totals().items()])
    )


def side_totals(pairs: DataFrame, side: str) -> DataFrame:
    """Pair totals as seen by one side: ``team``, ``opponent`` and ``type`` columns."""
    team, opponent, _, _ = _side(side)
    totals = [c for c in pairs.columns if c not in ("season", "week", "season_type", "posteam", "defteam")]
    return pairs.filter(F.col(team).isNotNull()).select(
        "season",
        "week",
        "season_type",
        F.col(team).alias("team"),
        F.col(opponent).alias("opponent"),
        F.lit(side).alias("type"),
        *totals,
    )


def week_stats(pairs: DataFrame, side: str) -> DataFrame:
    """Counts and rates per team, week and opponent."""
    c = F.col
    return side_totals(pairs, side).select(
        *("season", "week", "season_type", "team", "opponent", "type"),
        ratio(c("total_epa"), c("total_plays")).alias("epa_per_play"),
        c("total_passes").alias("passes"),
        "interceptions",
        "passing_yds",
        ratio(c("total_pass_epa"), c("total_passes")).alias("dropback_epa"),
        ratio(c("total_pass_success"), c("total_passes")).alias("dropback_sr"),
        ratio(c("total_pass_explosive"), c("total_passes")).alias("dropback_explosive"),
        c("total_rushes").alias("rushes"),
        "lost_fumbles",
        "rushing_yds",
        ratio(c("total_rush_epa"), c("total_rushes")).alias("rush_epa"),
        ratio(c("total_rush_success"), c("total_rushes")).alias("rush_sr"),
        ratio(c("total_rush_explosive"), c("total_rushes")).alias("rush_explosive"),
        ratio(c("total_success"), c("total_plays")).alias("sr"),
        (c("total_passes") + c("total_rushes")).alias("tot_plays"),
        (c("passing_yds") + c("rushing_yds")).alias("tot_yds"),
        (c("interceptions") + c("lost_fumbles")).alias("tot_tos"),
    )


def week_ranks(stats: DataFrame, side: str) -> DataFrame:
    """Adds the league rank of each rate within the week: high is 1 on offense, low on defense."""
    descending = _side(side)[2]
    return stats.withColumns({f"{r}_rank": min_rank(r, ["season", "week"], descending) for r in WEEK_RATES})


def with_games(stats: DataFrame, games: DataFrame, logos: DataFrame) -> DataFrame:
    """Adds score, result, rest and spread of the week's game, and both teams' logos."""
    game_columns = ["team_score", "opponent_score", "team_rest", "opponent_rest", "spread_line", "result"]
    games = with_result(games).select("season", "team", "week", *game_columns)
    opponent = logos.select(F.col("team_abbr").alias("opponent"), F.col("team_logo_espn").alias("opp_logo"))
    team = logos.select(F.col("team_abbr").alias("team"), F.col("team_wordmark").alias("team_logo"))
    joined = (
        stats.join(games, ["season", "team", "week"], "left").join(opponent, ["opponent"], "left").join(team, ["team"], "left")
    )
    return joined.select(*stats.columns, *game_columns, "opp_logo", "team_logo", score_text().alias("final_score"))


def week_report(pairs: DataFrame, games: DataFrame, logos: DataFrame, side: str) -> DataFrame:
    """The weekly table of all teams: statistics, game, logos and ranks."""
    stats = with_games(week_stats(pairs, side), games, logos)
    return week_ranks(stats, side)


# Columns of one team's weekly table, in display order.
WEEK_TABLE = (
    "week", "opp_logo", "result", "final_score", "spread_line", "team_rest", "opponent_rest", "passes",
    "passing_yds", "interceptions", "dropback_epa", "dropback_epa_rank", "dropback_sr", "dropback_sr_rank",
    "dropback_explosive", "dropback_explosive_rank", "rushes", "rushing_yds", "lost_fumbles", "rush_epa",
    "rush_epa_rank", "rush_sr", "rush_explosive", "rush_explosive_rank", "rush_sr_rank", "tot_plays", "tot_yds",
    "tot_tos", "epa_per_play", "epa_per_play_rank", "sr", "sr_rank",
)


def week_table(report: DataFrame, team: str, weeks: tuple[int, int] | None = None, season: int | None = None) -> DataFrame:
    """One team's weeks out of a weekly report, ranks still against the whole league."""
    rows = in_weeks(report, weeks).filter(F.col("team") == team)
    if season is not None:
        rows = rows.filter(F.col("season") == season)
    return rows.select(*WEEK_TABLE)


def eff_totals(pairs: DataFrame, games: DataFrame, logos: DataFrame, side: str) -> DataFrame:
    """Weekly additive totals per team with points (scored, or allowed on defense) and logo."""
    keys = ["season", "week", "season_type", "team", "type"]
    sums = [(strict_sum if t in STRICT_TOTALS else lenient_sum)(t).alias(t) for t in EFF_TOTALS]
    points = team_week_points(games, _side(side)[3])
    logo = logos.select(F.col("team_abbr").alias("team"), F.col("team_logo_espn").alias("team_logo"))
    return (
        side_totals(pairs, side)
        .groupBy(*keys)
        .agg(*sums)
        .join(points, ["season", "team", "week"], "left")
        .join(logo, ["team"], "left")
        .select(*keys, *EFF_TOTALS, "pts", "team_logo")
    )


def eff_rates(totals: DataFrame, weeks: tuple[int, int] | None = None) -> DataFrame:
    """Rates over a range of weeks as ratios of summed totals, with points."""

    def rate(numerator: str, denominator: str):
        return ratio(strict_sum(numerator), strict_sum(denominator))

    return (
        in_weeks(totals, weeks)
        .groupBy("season", "team", "type", "team_logo")
        .agg(
            rate("total_epa", "total_plays").alias("epa_per_play"),
            rate("total_success", "total_plays").alias("sr"),
            rate("total_pass_epa", "total_passes").alias("dropback_epa"),
            rate("total_pass_success", "total_passes").alias("dropback_sr"),
            rate("total_pass_explosive", "total_passes").alias("dropback_exp"),
            rate("total_rush_epa", "total_rushes").alias("rush_epa"),
            rate("total_rush_success", "total_rushes").alias("rush_sr"),
            rate("total_rush_explosive", "total_rushes").alias("rush_exp"),
            strict_sum("pts").alias("pts"),
        )
    )


def eff_ranks(rates: DataFrame) -> DataFrame:
    """Adds league ranks over the range of weeks; the direction follows ``type``."""
    ranked = {}
    for name in cols_between(rates, "epa_per_play", "pts"):
        signed = F.when(F.col("type") == "offense", -F.col(name)).otherwise(F.col(name))
        ranked[f"{name}_rank"] = min_rank(signed, ["season", "type"], descending=False)
    return rates.withColumns(ranked)


def eff_summary(
    totals: DataFrame, standings: DataFrame, weeks: tuple[int, int] | None = None, team: str | None = None
) -> DataFrame:
    """Rates, ranks and the season's record; for one team, its row after ranking all teams."""
    ranked = eff_ranks(eff_rates(totals, weeks))
    if team is not None:
        ranked = ranked.filter(F.col("team") == team)
    record = standings.select("season", "team", "wins", "losses", "ties")
    measures = cols_between(ranked, "epa_per_play")
    joined = ranked.join(record, ["season", "team"], "left")
    shown = ["season", "team_logo"] if team is not None else ["season", "team", "type", "team_logo"]
    return joined.select(*shown, *measures, "wins", "losses", "ties")
