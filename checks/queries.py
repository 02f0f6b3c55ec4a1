"""The registered queries: every operator over the tables derived from the given ones."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from checks.views import Derived
from snaplytics import schemas
from snaplytics.operators import award_model as am
from snaplytics.operators import games, pivot, plays, quarterbacks as qb, receivers, team_week as tw
from snaplytics.plans.award import labelled_quarterbacks, run_award_model
from snaplytics.plans.kept_totals import KeptTotals
from snaplytics.session import checkpoint_folder, cut_lineage
from snaplytics.sources import FEEDS, FeedFolder, bucket_count, conform, season_standings, write_bucketed, write_results

DIGITS = 6
LIMIT_DIGITS = 3
TEAM = "T03"
WEEKS = (5, 40)
SEASON = 1998
FILE_SEASONS = range(1996, 1999)  # the seasons that are read back from files
ALL_SEASONS = range(1990, 2010)
LATE_WEEK = 20  # what comes after it arrives late in the season that is built twice
BUCKETS = 8  # at least
ROWS_PER_BUCKET = 1_200_000
RULES = qb.AwardRules(
    first_season=1995,
    left_out_seasons=(1996,),
    min_attempts=80,
    franchise_moves={"OAK": "T03"},
    train_last_season=1999,
    train_left_out=(1998,),
    test_first_season=2000,
)
# A given model, so that everything after the fit can be checked in SQL.
COEFFICIENTS = {
    am.INTERCEPT: 3.0,
    "tds_rank": -2.0,
    "yds_rank": -0.05,
    "win_rank": -0.2,
    "epa_rank": -0.1,
    "total_interceptions": -0.02,
}


SOURCES = {
    "plays": (schemas.PLAYS, schemas.PLAY_KEY),
    "charting": (schemas.CHARTING, schemas.CHARTING_KEY),
    "schedules": (schemas.SCHEDULES,),
    "player_stats": (schemas.PLAYER_STATS,),
    "teams": (schemas.TEAM_LOGOS,),
    "standings": (schemas.STANDINGS,),
    "mvps": (schemas.AWARD_WINNERS,),
}


class Tables:
    """The derived tables of one folder and the intermediate tables of the jobs, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._derived = Derived(spark, folder)
        self._stored: dict[str, str] = {}

    def replace(self, name: str, path: str) -> None:
        """From now on read the derived table ``name`` from a stored copy."""
        self._stored[name] = path

    def fresh(self) -> Tables:
        """The same sources, and nothing built from them yet."""
        again = Tables(self.spark, self.folder)
        again._stored = dict(self._stored)
        return again

    def view(self, name: str) -> DataFrame:
        """A derived table with the checks and conversions that reading it from files would bring."""
        if name in self._stored:
            return self.spark.read.parquet(self._stored[name])
        return conform(self._derived.table(f"fx_{name}"), *SOURCES[name])

    @cached_property
    def plays(self) -> DataFrame:
        return self.view("plays")

    @cached_property
    def logos(self) -> DataFrame:
        return self.view("teams")

    @cached_property
    def player_stats(self) -> DataFrame:
        return self.view("player_stats")

    @cached_property
    def standings(self) -> DataFrame:
        return games.relabel_franchises(self.view("standings"), RULES.franchise_moves)

    @cached_property
    def charted(self) -> DataFrame:
        return plays.join_charting(self.plays, self.view("charting"))

    @cached_property
    def games(self) -> DataFrame:
        return games.team_rows(self.view("schedules"))

    @cached_property
    def pairs(self) -> DataFrame:
        return tw.pair_totals(self.charted)

    def week_report(self, side: str) -> DataFrame:
        return tw.week_report(self.pairs, self.games, self.logos, side)

    def eff_totals(self, side: str) -> DataFrame:
        return tw.eff_totals(self.pairs, self.games, self.logos, side)

    def eff_summary(self, side: str, weeks=None, team=None) -> DataFrame:
        return tw.eff_summary(self.eff_totals(side), self.standings, weeks, team)

    @cached_property
    def receiver_game(self) -> DataFrame:
        return receivers.receiver_game(self.charted, self.player_stats)

    @cached_property
    def qb_season(self) -> DataFrame:
        return qb.qb_season(self.player_stats, RULES)

    @cached_property
    def qb_ranks(self) -> DataFrame:
        return qb.qb_ranks(self.qb_season)

    @cached_property
    def labelled(self) -> DataFrame:
        return labelled_quarterbacks(self.player_stats, self.view("standings"), self.view("mvps"), RULES)

    @cached_property
    def scored(self) -> DataFrame:
        return am.score(cut_lineage(self.labelled), COEFFICIENTS)


class FileTables(Tables):
    """The same jobs over files: a derived table is written as a feed when first asked for, and read back by its reader.

    Large feeds are read for some seasons only. Lists go through text, with other columns before and behind.
    """

    FEED = {"teams": "team_logos", "mvps": "award_winners"}

    def __init__(self, spark: SparkSession, folder: str, seasons=FILE_SEASONS):
        super().__init__(spark, folder)
        self.seasons = seasons
        self.feeds = FeedFolder(spark, f"{checkpoint_folder(spark)}/feeds-{uuid.uuid4().hex}")
        self._written: set[str] = set()

    def write(self, feed: str, name: str) -> None:
        if feed not in self._written:
            df = self._derived.table(f"fx_{name}")
            if FEEDS[feed].text:
                df = df.select(F.lit("x").alias("first"), *reversed(df.columns), F.lit(None).cast("string").alias("last"))
            self.feeds.write(feed, df)
            self._written.add(feed)

    def view(self, name: str) -> DataFrame:
        feed = self.FEED.get(name, name)
        self.write(feed, name)
        return self.feeds.read(feed, self.seasons if FEEDS[feed].by_season else None)

    def valid_plays(self, weeks: tuple[int, int]) -> DataFrame:
        self.write("plays", "plays")
        return plays.valid_plays(self.feeds.read("plays", self.seasons, valid_only=True, weeks=weeks))

    def team_list(self) -> DataFrame:
        self.write("teams", "teams")
        return self.feeds.read("teams")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to a fixed number of digits, for comparing results across engines."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType)]
    scale = 10.0**digits
    return df.withColumns({c: F.floor(F.col(f"`{c}`") * scale + 0.5) / scale for c in doubles}) if doubles else df


def _both_sides(t: Tables, make: Callable[[str], DataFrame]) -> DataFrame:
    return make("offense").unionByName(make("defense"))


def _all_week_stats(t: Tables) -> DataFrame:
    """Offense and defense from one stored pass over the plays."""
    pairs = cut_lineage(t.pairs)
    return _both_sides(t, lambda side: tw.week_ranks(tw.week_stats(pairs, side), side))


BUILDERS: dict[str, Callable[[Tables], DataFrame]] = {
    # plays
    "plays_charted": lambda t: t.charted,
    "valid_plays": lambda t: plays.valid_plays(t.charted),
    "valid_defense_plays": lambda t: plays.valid_plays(t.charted, "defteam"),
    "valid_targets": lambda t: plays.valid_targets(t.charted),
    "explosive_plays": lambda t: plays.flag_explosive(plays.valid_plays(t.charted)).select(
        "game_id", "play_id", "explosive_pass", "explosive_run"
    ),
    # games and teams
    "schedule_team_rows": lambda t: t.games,
    "schedule_team_rows_inverted": lambda t: games.team_rows(t.view("schedules"), invert=["spread_line"]),
    "game_results": lambda t: games.with_result(t.games).withColumn("final_score", games.score_text()),
    "standings_relabelled": lambda t: _files(t).standings,
    "season_results": lambda t: _written(t.games),
    "season_standing": lambda t: season_standings(t.standings, SEASON),
    "team_week_points": lambda t: games.team_week_points(t.games, "team_score"),
    "team_week_points_allowed": lambda t: games.team_week_points(t.games, "opponent_score"),
    "team_choices": lambda t: games.current_teams(t.logos, ["T05", "T17"]).select("team_abbr"),
    # weekly statistics
    "off_week_stats": lambda t: tw.week_stats(t.pairs, "offense"),
    "def_week_stats": lambda t: tw.week_stats(t.pairs, "defense"),
    "off_week_ranks": lambda t: tw.week_ranks(tw.week_stats(t.pairs, "offense"), "offense"),
    "def_week_ranks": lambda t: tw.week_ranks(tw.week_stats(t.pairs, "defense"), "defense"),
    "all_week_ranks": _all_week_stats,
    "off_week_report": lambda t: t.week_report("offense"),
    "def_week_report": lambda t: t.week_report("defense"),
    "off_week_table": lambda t: tw.week_table(t.week_report("offense"), TEAM, WEEKS, SEASON),
    "def_week_table": lambda t: tw.week_table(t.week_report("defense"), TEAM, WEEKS, SEASON),
    "week_bounds": lambda t: plays.week_bounds(tw.week_stats(t.pairs, "offense")),
    "week_choices": lambda t: plays.distinct_weeks(tw.week_stats(t.pairs, "offense")),
    # effectiveness
    "off_eff_totals": lambda t: t.eff_totals("offense"),
    "def_eff_totals": lambda t: t.eff_totals("defense"),
    "off_eff_summary": lambda t: t.eff_summary("offense"),
    "def_eff_summary": lambda t: t.eff_summary("defense"),
    "off_eff_summary_weeks": lambda t: t.eff_summary("offense", WEEKS),
    "def_eff_summary_weeks": lambda t: t.eff_summary("defense", WEEKS),
    "off_eff_team": lambda t: t.eff_summary("offense", WEEKS, TEAM),
    "def_eff_team": lambda t: t.eff_summary("defense", WEEKS, TEAM),
    # receivers
    "receiver_qc": lambda t: receivers.receiver_qc(t.charted, t.player_stats),
    "receiver_game": lambda t: t.receiver_game,
    "receiver_breakdown": lambda t: receivers.receiver_breakdown(t.receiver_game),
    "receiver_table": lambda t: receivers.receiver_table(t.receiver_game, TEAM, WEEKS, SEASON),
    # pivots
    "pivot_personnel": lambda t: pivot.pivot_summary(t.charted, "offense_personnel"),
    "pivot_two_dims": lambda t: pivot.pivot_summary(t.charted, "offense_formation, offense_personnel", WEEKS),
    "pivot_charting_dim": lambda t: pivot.pivot_summary(t.charted, "season, is_no_huddle"),
    "pivot_team": lambda t: pivot.pivot_table(t.charted, TEAM, "offense_personnel", WEEKS, SEASON),
    "pivot_team_week": lambda t: pivot.personnel_table(t.charted, TEAM, 4, SEASON),
    # quarterbacks
    "qb_season": lambda t: t.qb_season,
    "qb_ranks": lambda t: t.qb_ranks,
    "qb_win_rank": lambda t: qb.with_win_rank(t.qb_ranks, t.standings),
    "award_winners": lambda t: qb.winners(_files(t).view("mvps"), RULES.first_season),
    "qb_labelled": lambda t: qb.by_season_and_name(t.labelled),
    "missing_cells": lambda t: qb.missing_cells(t.labelled),
    "class_counts": lambda t: qb.frequencies(t.labelled, "mvp"),
    "train_seasons": lambda t: qb.frequencies(qb.training_rows(t.labelled, RULES), "season"),
    "test_seasons": lambda t: qb.frequencies(qb.testing_rows(t.labelled, RULES), "season"),
    # files by season and week
    "file_valid_plays": lambda t: _files(t).valid_plays(WEEKS),
    "file_charting": lambda t: _files(t).view("charting"),
    "file_schedule_team_rows": lambda t: _files(t).games,
    "file_player_stats": lambda t: _files(t).player_stats,
    "file_team_choices": lambda t: games.current_teams(_files(t).team_list(), ["T05", "T17"]).select("team_abbr"),
    "file_off_week_report": lambda t: _files(t).week_report("offense"),
    "file_receiver_breakdown": lambda t: receivers.receiver_breakdown(_files(t).receiver_game),
    "file_qb_season": lambda t: _files(t).qb_season,
    "kept_off_eff_summary": lambda t: _kept(t, "offense"),
    "kept_def_eff_summary": lambda t: _kept(t, "defense"),
    "plays_charted_bucketed": lambda t: _bucketed(t),
    # award, with a given model
    "season_prob": lambda t: t.scored.select(
        "season", "team", "player_display_name", "player_id", "mvp", "pred", "pred_mvp", "mvp_prob"
    ),
    "confusion": lambda t: am.confusion(t.scored),
    "binary_metrics": lambda t: am.binary_metrics(am.confusion(t.scored)),
    "misses": lambda t: am.misses(t.scored),
    "missed_seasons": lambda t: am.missed_seasons(t.scored),
    "mvp_race": lambda t: am.mvp_race(t.scored, SEASON),
    "mvp_races": lambda t: am.mvp_races(t.scored),
    # award, fitted
    "mvp_model_scored": lambda t: _fitted(t, lambda run: run.train.unionByName(run.test)),
    "mvp_coefficients": lambda t: _fitted(t, lambda run: am.coefficient_table(t.spark, run.model, _limits(run))),
    "mvp_score_equations": lambda t: _fitted(t, lambda run: am.score_equations(run.train, run.model)),
    "mvp_null_fit": lambda t: _fitted(t, lambda run: am.fit_table(t.spark, run.model)).select(*NULL_FIT),
    "mvp_season_shares": lambda t: _fitted(t, lambda run: _shares(run.train.unionByName(run.test))),
    "mvp_fit": lambda t: _fitted(t, lambda run: am.fit_table(t.spark, run.model).drop("iterations")),
    "mvp_test_metrics": lambda t: _fitted(t, lambda run: am.binary_metrics(am.confusion(run.test))),
}


NULL_FIT = ("rows", "null_df", "residual_df", "null_deviance")


def _limits(run) -> DataFrame:
    """Limits as searched for, to fewer digits: one of them lies on the edge between two sixth digits."""
    limits = am.profile_intervals(run.train, run.model, tolerance=1e-8)
    return rounded(limits, LIMIT_DIGITS)


def _shares(scored: DataFrame) -> DataFrame:
    """Per season the sum of the shares, and whether there is a favourite."""
    return scored.groupBy("season").agg(
        F.when(F.count("mvp_prob") == F.count(F.lit(1)), F.sum("mvp_prob")).alias("share"), (F.max("pred_mvp") == 1).alias("has_favourite")
    )


def _written(df: DataFrame) -> DataFrame:
    """Written by season in three goes, one season twice, and read back."""
    path = f"{checkpoint_folder(df.sparkSession)}/season_results-{uuid.uuid4().hex}"
    early = F.col("season") < SEASON
    for part in (df.filter(early), df.filter(F.col("season") == SEASON).limit(10), df.filter(~early)):
        write_results(part, path)
    return df.sparkSession.read.parquet(path)


def _files(t: Tables) -> FileTables:
    return FileTables(t.spark, t.folder)


def _kept(t: Tables, side: str) -> DataFrame:
    """Totals kept from feeds that lack the end of one season, refreshed for that season when it arrives, and served."""
    files = FileTables(t.spark, t.folder, ALL_SEASONS)
    for feed, name in (("charting", "charting"), ("schedules", "schedules"), ("team_logos", "teams")):
        files.write(feed, name)
    everything = t._derived.table("fx_plays")  # derived again for the late rows: far less than storing all rows
    late = (F.col("season") == SEASON) & (F.col("week") > LATE_WEEK)
    kept = KeptTotals(t.spark, f"{files.feeds.path}/kept")
    files.feeds.write("plays", everything.filter(~late))
    kept.refresh(files.feeds, ALL_SEASONS)
    files.feeds.write("plays", everything.filter(late))
    kept.refresh(files.feeds, [SEASON])
    return kept.summary(side, t.standings)


def _bucketed(t: Tables) -> DataFrame:
    """Both sides stored in buckets of the join key, as many as their rows call for, and joined from there."""
    names = {name: f"{name}_{uuid.uuid4().hex}" for name in ("plays", "charting")}
    buckets = bucket_count([t.view(name) for name in names], BUCKETS, ROWS_PER_BUCKET)
    for (name, stored), keys in zip(names.items(), (schemas.PLAY_KEY, schemas.CHARTING_KEY)):
        write_bucketed(t.view(name), stored, keys, buckets, path=f"{checkpoint_folder(t.spark)}/{stored}")
    return plays.join_charting(*[t.spark.table(stored) for stored in names.values()])


def _fitted(t: Tables, result: Callable) -> DataFrame:
    return result(run_award_model(t.labelled, RULES))


def _query(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: rounded(build(Tables(spark, folder)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(build) for name, build in BUILDERS.items()}
