import pytest
from pyspark.sql import functions as F

from snaplytics import sources
from tests.helpers import plan, rows, twelve_plays


@pytest.fixture(scope="module")
def play_files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plays") / "plays")
    seasons = [twelve_plays(spark).withColumn("season", F.lit(s)) for s in (2021, 2022, 2023)]
    sources.write_results(seasons[0].unionByName(seasons[1]).unionByName(seasons[2]), path)
    return path


def test_nan_is_null_after_reading_and_extra_columns_stay(spark, tmp_path):
    path = str(tmp_path / "plays")
    twelve_plays(spark).withColumn("wind", F.lit(3.5)).write.parquet(path)
    df = sources.read_plays(spark, path)
    assert df.filter("isnan(epa)").count() == 0 and df.filter("epa is null").count() == 2
    assert "wind" in df.columns and dict(df.dtypes)["play_id"] == "bigint"


def test_seasons_prune_partitions(spark, play_files):
    df = sources.read_plays(spark, play_files, seasons=[2021, 2022])
    assert rows(df.groupBy("season").count()) == [(2021, 12), (2022, 12)]
    text = plan(df)
    assert "PartitionFilters" in text and "season" in text.split("PartitionFilters")[1].split("\n")[0]
    assert sources.read_plays(spark, play_files, seasons=2023).count() == 12
    assert rows(sources.read_plays(spark, play_files, seasons=[2021, 2023]).select("season").distinct()) == [(2021,), (2023,)]
    assert sources.read_plays(spark, play_files, seasons=range(2021, 2024)).count() == 36
    with pytest.raises(ValueError):
        sources.read_plays(spark, play_files, seasons=[])


def test_play_numbers_of_any_numeric_type_meet(spark, tmp_path):
    plays = str(tmp_path / "plays")
    twelve_plays(spark).withColumn("play_id", F.col("play_id").cast("double")).write.parquet(plays)
    charting = str(tmp_path / "charting")
    spark.createDataFrame(
        [("g1", 4, 2023, True, True, False, False, False)],
        "nflverse_game_id string, nflverse_play_id int, season int, is_no_huddle boolean, is_catchable_ball boolean, "
        "is_contested_ball boolean, is_created_reception boolean, is_drop boolean",
    ).write.parquet(charting)
    from snaplytics.operators.plays import join_charting

    joined = join_charting(sources.read_plays(spark, plays), sources.read_charting(spark, charting, seasons=2023))
    assert rows(joined, "play_id", "is_no_huddle") == [(4, True)]


def test_missing_column_is_an_error(spark, tmp_path):
    path = str(tmp_path / "plays")
    twelve_plays(spark).drop("epa").write.parquet(path)
    with pytest.raises(ValueError, match="epa"):
        sources.read_plays(spark, path)


def test_standings_are_read_by_name(spark, tmp_path):
    path = tmp_path / "standings.csv"
    path.write_text("team,conf,season,losses,wins,ties,pct\nSF,NFC,2003,9,7,0,0.4375\nOAK,AFC,2003,12,4,NA,0.25\n")
    df = sources.read_standings(spark, str(path))
    assert df.dtypes == [("season", "int"), ("wins", "int"), ("losses", "int"), ("ties", "int"), ("team", "string")]
    assert rows(df, "team", "season", "wins", "losses", "ties") == [("OAK", 2003, 4, 12, None), ("SF", 2003, 7, 9, 0)]
    assert rows(sources.season_standings(df, 2004)) == []
    bad = tmp_path / "bad.csv"
    bad.write_text("team,season\nSF,2003\n")
    with pytest.raises(ValueError, match="wins"):
        sources.read_standings(spark, str(bad))


def test_award_winners_from_text_and_parquet(spark, tmp_path):
    path = tmp_path / "mvp.csv"
    path.write_text("Year,Lg,Player,Pos\n2003,NFL,Ann,QB\n")
    df = sources.read_award_winners(spark, str(path))
    assert rows(df, "Year", "Player", "Pos") == [(2003, "Ann", "QB")]
    df.write.parquet(str(tmp_path / "mvp.parquet"))
    assert rows(sources.read_award_winners(spark, str(tmp_path / "mvp.parquet"), "parquet"), "Player") == [("Ann",)]


def test_small_dimensions_and_schedules(spark, tmp_path):
    logos = str(tmp_path / "logos")
    spark.createDataFrame([("A", "e", "w")], "team_abbr string, team_logo_espn string, team_wordmark string").write.parquet(logos)
    assert sources.read_teams(spark, logos).count() == sources.read_team_logos(spark, logos).count() == 1
    games = str(tmp_path / "games")
    spark.createDataFrame(
        [(2022, 1, "A", "B", 1.0, 2.0, 7, 7, 3.0), (2023, 1, "A", "B", float("nan"), None, 7, 7, 3.0)],
        "season int, week int, home_team string, away_team string, home_score double, away_score double, home_rest int, away_rest int, spread_line double",
    ).write.parquet(games)
    df = sources.read_schedules(spark, games, seasons=2023)
    assert rows(df, "season", "home_score", "away_score") == [(2023, None, None)]
    assert dict(df.dtypes)["home_score"] == "int"


def test_results_are_written_by_season(spark, play_files):
    assert rows(spark.read.parquet(play_files).groupBy("season").count()) == [(2021, 12), (2022, 12), (2023, 12)]


def test_writing_a_season_again_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "results")
    for season, teams in ((2022, 2), (2023, 3), (2022, 1)):
        sources.write_results(spark.range(teams).withColumn("season", F.lit(season)), path)
    assert rows(spark.read.parquet(path).groupBy("season").count()) == [(2022, 1), (2023, 3)]


@pytest.mark.parametrize("flag", ["int", "double"])
def test_validity_reaches_the_files_whatever_type_the_flags_have(spark, tmp_path, flag):
    from snaplytics.operators.plays import valid_plays

    path = str(tmp_path / "plays")
    raw = twelve_plays(spark)
    raw.withColumns({c: F.col(c).cast(flag) for c in ("pass", "rush")}).write.parquet(path)
    read = sources.read_plays(spark, path, valid_only=True)
    pushed = plan(read).split("PushedFilters: ")[1].split("\n")[0]
    assert "IsNotNull(epa)" in pushed and "EqualTo(pass,1" in pushed and "EqualTo(rush,1" in pushed
    everything = valid_plays(sources.read_plays(spark, path))
    assert rows(valid_plays(read)) == rows(everything) and read.filter("isnan(epa)").count() == 0
