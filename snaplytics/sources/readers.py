"""Reading the feeds: parquet (or CSV) files to tables of known types, NaN gone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StructType

from snaplytics import schemas
from snaplytics.functions.columns import require
from snaplytics.functions.nulls import nan_to_null

Seasons = int | Iterable[int] | None


def season_filter(seasons: Seasons, column: str = "season") -> Column:
    """A predicate on the season column that prunes partitions and row groups."""
    wanted = sorted({seasons} if isinstance(seasons, int) else set(seasons))
    if not wanted:
        raise ValueError("no season given")
    if wanted[-1] - wanted[0] + 1 == len(wanted):
        return F.col(column).between(wanted[0], wanted[-1])
    return F.col(column).isin(wanted)


def conform(df: DataFrame, schema: StructType, keys: Iterable[str] = ()) -> DataFrame:
    """Check that all columns of ``schema`` are there and give them their types.

    Whole numbers, flags and texts that already have the right type are left alone, so that
    filters on them still reach the files; those on doubles do not, as NaN becomes NULL (see ``valid_only`` of
    ``read_plays``). Further columns pass through.
    """
    require(df, [*schema.fieldNames(), *keys])
    have = {f.name: f.dataType for f in df.schema.fields}
    casts = {f.name: F.col(f.name).cast(f.dataType) for f in schema.fields if have[f.name] != f.dataType}
    for key in set(keys) & schemas.LOOSE_KEYS:
        if isinstance(have[key], NumericType):
            casts[key] = F.col(key).cast("bigint")
    return nan_to_null(df).withColumns(casts) if casts else nan_to_null(df)


def _parquet(spark: SparkSession, path: str, schema: StructType, *args, **named) -> DataFrame:
    return _conformed(spark.read.parquet(path), schema, *args, **named)


def _conformed(
    df: DataFrame,
    schema: StructType,
    seasons: Seasons = None,
    season_column: str = "season",
    keys: Iterable[str] = (),
) -> DataFrame:
    if seasons is not None:
        require(df, [season_column])
        df = df.filter(season_filter(seasons, season_column))
    return conform(df, schema, keys)


def _csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    # Named, not positional: the files carry more columns, in an order that may change.
    # A given schema would be laid over the columns by position, so read text and cast.
    blanks = {"ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}
    raw = spark.read.csv(path, header=True, nullValue="NA", emptyValue="", **blanks)
    require(raw, schema.fieldNames())
    numbers = [f.name for f in schema.fields if isinstance(f.dataType, NumericType)]
    # Whole numbers may be written as 12.0.
    known = nan_to_null(raw.withColumns({c: F.col(c).cast("double") for c in numbers}))
    return known.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_plays(
    spark: SparkSession, path: str, seasons: Seasons = None, valid_only: bool = False, weeks: tuple[int, int] | None = None
) -> DataFrame:
    """Plays as stored, or only those that can count in a report (see ``plays.is_play``).

    ``weeks`` are the first and last week wanted; stored in folders by week, others are not opened.
    ``valid_only`` filters the stored columns before they are converted, so that the files
    can skip rows by it, whatever numeric type they hold.
    """
    raw = spark.read.parquet(path)
    if weeks is not None:
        require(raw, ["week"])
        raw = raw.filter(F.col("week").between(min(weeks), max(weeks)))
    if valid_only:
        require(raw, ["epa", "pass", "rush"])
        raw = raw.filter(F.col("epa").isNotNull() & ((F.col("pass") == 1) | (F.col("rush") == 1)))
    return _conformed(raw, schemas.PLAYS, seasons, keys=schemas.PLAY_KEY)


def read_charting(
    spark: SparkSession, path: str, seasons: Seasons = None, season_column: str = "season"
) -> DataFrame:
    return _parquet(spark, path, schemas.CHARTING, seasons, season_column, keys=schemas.CHARTING_KEY)


def read_player_stats(spark: SparkSession, path: str, seasons: Seasons = None) -> DataFrame:
    return _parquet(spark, path, schemas.PLAYER_STATS, seasons)


def read_schedules(spark: SparkSession, path: str, seasons: Seasons = None) -> DataFrame:
    return _parquet(spark, path, schemas.SCHEDULES, seasons)


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    return _parquet(spark, path, schemas.TEAMS)


def read_team_logos(spark: SparkSession, path: str) -> DataFrame:
    return _parquet(spark, path, schemas.TEAM_LOGOS)


def read_standings(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, schemas.STANDINGS)


def read_award_winners(spark: SparkSession, path: str, file_format: str = "csv") -> DataFrame:
    """Winners as ``Year, Player, Pos`` from CSV or parquet."""
    readers = {"csv": _csv, "parquet": _parquet}
    if file_format not in readers:
        raise ValueError(f"format {file_format!r}: one of {', '.join(readers)} is wanted")
    return readers[file_format](spark, path, schemas.AWARD_WINNERS)


def season_standings(standings: DataFrame, season: int) -> DataFrame:
    return standings.filter(F.col("season") == season)
