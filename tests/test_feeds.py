"""Feeds kept as files: what is read of them, text lists, kept totals and their refresh."""

import re

import pytest
from pyspark.sql import functions as F

from checks.queries import FILE_SEASONS, KeptTotals, queries
from snaplytics import sources
from snaplytics.operators import games, plays, team_week as tw
from tests.helpers import final_plan, plan, rows, settings, twelve_plays

FOLDER = "/root/testdata/sf0.001"
CHARTING = (
    "nflverse_game_id string, nflverse_play_id long, ftn_season int, is_no_huddle boolean, is_catchable_ball boolean, "
    "is_contested_ball boolean, is_created_reception boolean, is_drop boolean"
)
GAMES = (
    "season int, week int, home_team string, away_team string, home_score int, away_score int, home_rest int, away_rest int, "
    "spread_line double"
)


@pytest.fixture()
def feeds(spark, tmp_path):
    """Three seasons of the twelve plays, one game a season, three teams."""
    folder = sources.FeedFolder(spark, str(tmp_path / "feeds"))
    for season in (2021, 2022, 2023):
        folder.write("plays", season_plays(spark, season))
        folder.write("charting", spark.createDataFrame([(f"g{season}", i, season, True, True, False, False, False) for i in range(1, 13)], CHARTING))
        folder.write("schedules", spark.createDataFrame([(season, 1, "A", "B", 20, 10, 7, 7, 3.0)], GAMES))
    logos = spark.createDataFrame([(t, f"e{t}", f"w{t}") for t in "AB"], "team_abbr string, team_logo_espn string, team_wordmark string")
    folder.write("team_logos", logos)
    folder.write("teams", logos.select("team_abbr"))
    return folder


def opened(df):
    return {r[0] for r in df.select(F.input_file_name()).distinct().collect()}


def season_plays(spark, season):
    return twelve_plays(spark).withColumns({"season": F.lit(season), "game_id": F.lit(f"g{season}")})


def scans(df):
    return re.findall(r"\(\d+\) Scan parquet.*?(?=\n\n)", plan(df), re.S)


def test_seasons_and_weeks_choose_folders(feeds):
    df = feeds.read("plays", range(2021, 2023), weeks=(1, 1))
    (scan,) = scans(df)
    chosen = re.search(r"PartitionFilters: (.*)", scan)[1]
    assert all(part in chosen for part in ("season", ">= 2021", "<= 2022", "week", "<= 1"))
    assert rows(df.groupBy("season", "week").count()) == [(2021, 1, 11), (2022, 1, 11)]
    assert all(re.search(r"season=202[12]/week=1/", f) for f in opened(df))


def test_only_needed_columns_and_rows_are_read(feeds):
    totals = tw.week_stats(tw.pair_totals(feeds.read("plays", 2022, valid_only=True)), "offense")
    (scan,) = scans(totals)
    assert "IsNotNull(epa)" in scan and "EqualTo(pass,1" in scan
    schema = re.search(r"ReadSchema: (.*)", scan)[1]
    assert "epa" in schema and not any(c in schema for c in ("play_id", "offense_personnel", "receiver_player_id", "play_type"))


def test_charting_is_kept_under_its_own_season_column(feeds):
    df = feeds.read("charting", [2021, 2023])
    assert re.search(r"PartitionFilters: .*ftn_season#\d+ IN \(2021,2023\)", scans(df)[0])
    assert rows(df.groupBy("ftn_season").count()) == [(2021, 12), (2023, 12)]
    joined = plays.join_charting(feeds.read("plays", 2023), feeds.read("charting", 2023))
    assert joined.count() == 12


def test_the_other_feeds(feeds):
    assert rows(feeds.read("teams"), "team_abbr") == [("A",), ("B",)]
    assert rows(feeds.read("team_logos"), "team_wordmark") == [("wA",), ("wB",)]
    assert rows(games.team_rows(feeds.read("schedules", 2022)), "team", "team_score") == [("A", 20), ("B", 10)]
    with pytest.raises(ValueError, match="not kept by season"):
        feeds.read("teams", 2022)
    with pytest.raises(ValueError, match="wanted"):
        feeds.read("snap_counts")


def test_writing_a_week_again_leaves_the_rest(spark, feeds):
    again = season_plays(spark, 2022).filter("week = 2").withColumn("epa", F.lit(9.0))
    feeds.write("plays", again)
    df = feeds.read("plays")
    assert rows(df.groupBy("season").count()) == [(2021, 12), (2022, 12), (2023, 12)]
    assert rows(df.filter("epa = 9"), "season", "week") == [(2022, 2)]


def test_lists_go_through_text(spark, tmp_path):
    folder = sources.FeedFolder(spark, str(tmp_path))
    table = spark.createDataFrame(
        [("x", 1, "A B", 2003, 9, None), ("y", None, "C, \"D\"", 2004, None, 7), (None, 0, None, 2004, 1, 1)],
        "conf string, ties int, team string, season int, wins int, losses int",
    )
    folder.write("standings", table)
    df = folder.read("standings")
    assert df.columns == ["season", "wins", "losses", "ties", "team"]
    assert rows(df) == rows(table.select(*df.columns))
    winners = spark.createDataFrame([("QB", "Émile O'N", 2003), ("WR", "", 2004), (None, None, None)], "Pos string, Player string, Year int")
    folder.write("award_winners", winners)
    assert rows(folder.read("award_winners")) == rows(winners.select("Year", "Player", "Pos"))


def test_text_numbers_may_be_padded_or_decimal(spark, tmp_path):
    path = tmp_path / "standings.csv"
    path.write_text("team , season,wins,losses,ties\nSF, 2003 ,9.0,NA,NaN\n")
    df = sources.read_standings(spark, str(path))
    assert rows(df, "team", "season", "wins", "losses", "ties") == [("SF", 2003, 9, None, None)]
    bad = tmp_path / "bad.csv"
    bad.write_text("team,season,wins,losses,ties\nSF,2003,nine,1,0\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        sources.read_standings(spark, str(bad)).collect()


STANDINGS = "season int, team string, wins int, losses int, ties int"


def summary(spark, feeds, kept, weeks=None):
    standings = spark.createDataFrame([(s, t, 1, 2, 0) for s in (2021, 2022, 2023) for t in "AB"], STANDINGS)
    pairs = tw.pair_totals(plays.join_charting(feeds.read("plays"), feeds.read("charting")))
    for side in ("offense", "defense"):
        full = tw.eff_summary(tw.eff_totals(pairs, games.team_rows(feeds.read("schedules")), feeds.read("team_logos"), side), standings, weeks)
        served = kept.summary(side, standings, weeks)
        assert served.columns == full.columns and rows(served) == rows(full)
    return served


def test_kept_totals_after_a_late_change(spark, feeds, tmp_path):
    kept = KeptTotals(spark, str(tmp_path / "kept"))
    kept.refresh(feeds, range(2021, 2024))
    summary(spark, feeds, kept)
    summary(spark, feeds, kept, (1, 1))
    before = opened(kept.totals("offense", [2021, 2023]))
    feeds.write("plays", season_plays(spark, 2022).withColumn("epa", F.col("epa") + 1))
    kept.refresh(feeds, [2022])
    summary(spark, feeds, kept)
    # Files of other seasons are the same ones, and no play is read to serve a report.
    assert len(before) >= 2 and opened(kept.totals("offense", [2021, 2023])) == before
    served = kept.summary("offense", spark.createDataFrame([], STANDINGS), seasons=2022)
    (scan,) = [s for s in scans(served) if "eff_totals" in s]
    assert not any("/plays" in s for s in scans(served)) and "= 2022" in re.search(r"PartitionFilters: (.*)", scan)[1]
    assert rows(served.select("season").distinct()) == [(2022,)]


def test_a_season_without_plays_loses_its_totals(spark, feeds, tmp_path):
    kept = KeptTotals(spark, str(tmp_path / "kept"))
    kept.refresh(feeds, [2021, 2022])
    feeds.write("plays", season_plays(spark, 2022).withColumns({"pass": F.lit(0), "rush": F.lit(0)}))
    kept.refresh(feeds, [2022, 2022])
    assert rows(kept.totals("defense").select("season").distinct()) == [(2021,)]


def test_no_season_is_replaced_unasked(spark, tmp_path):
    df = spark.createDataFrame([(1, 2021), (2, 2022)], "x int, season int")
    with pytest.raises(ValueError, match="2022"):
        sources.replace_seasons(df, str(tmp_path / "t"), [2021])
    sources.replace_seasons(df, str(tmp_path / "t"), [2021, 2022, 2023])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_file_queries_read_chosen_seasons_only(spark):
    df = queries()["file_off_week_report"](spark, FOLDER)
    facts = [s for s in scans(df) if "/plays" in s or "/charting" in s or "/schedules" in s]
    assert len(facts) >= 3
    for scan in facts:
        chosen = re.search(r"PartitionFilters: (.*)", scan)[1]
        assert f">= {FILE_SEASONS[0]}" in chosen and f"<= {FILE_SEASONS[-1]}" in chosen


def test_bucketed_query_joins_without_a_shuffle(spark):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):  # the tables are too large for it elsewhere
        text = final_plan(queries()["plays_charted_bucketed"](spark, FOLDER))
    assert "SortMergeJoin" in text or "ShuffledHashJoin" in text
    assert "Exchange" not in text


def test_buckets_grow_with_the_rows(spark, monkeypatch):
    few = rows(queries()["plays_charted_bucketed"](spark, FOLDER))
    monkeypatch.setattr("checks.queries.ROWS_PER_BUCKET", 500)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = queries()["plays_charted_bucketed"](spark, FOLDER)
        assert "Exchange" not in final_plan(df)
        assert {int(n) for n in re.findall(r"Bucketed: true.*?SelectedBucketsCount: \d+ out of (\d+)", plan(df), re.S)} == {12}
    assert rows(df) == few


def test_bucket_count_follows_the_largest_table(spark):
    assert sources.bucket_count([spark.range(2), spark.range(10)], 2, 3) == 4
    assert sources.bucket_count([spark.range(0), spark.range(6)], 2, 3) == 2


@pytest.mark.parametrize("side", ["off", "def"])
def test_kept_query_stores_no_plays_but_the_feed(spark, monkeypatch, side):
    stored = []
    monkeypatch.setattr("checks.queries.cut_lineage", lambda df: stored.append(df.columns) or df)
    assert queries()[f"kept_{side}_eff_summary"](spark, FOLDER).count() > 0
    assert stored == []


def test_charting_join_sorts_by_play_first(spark, feeds):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        text = plan(plays.join_charting(feeds.read("plays"), feeds.read("charting")))
    assert re.search(r"Left keys \[2\]: \[play_id#\d+L?, game_id#\d+\]", text)


STATS = "player_id string, season int, week int"


def test_player_stats_are_written_without_a_shuffle(spark, tmp_path):
    folder = sources.FeedFolder(spark, str(tmp_path))
    first = spark.createDataFrame([(f"p{i}", 2021 + i % 2, i) for i in range(30)], STATS).repartition(3).cache()
    folder.write("player_stats", first)
    files = {s: [f.name for f in (tmp_path / f"player_stats/season={s}").glob("*.parquet")] for s in (2021, 2022)}
    # Every task wrote its own rows, a file per season it had.
    had = rows(first.select("season", F.spark_partition_id().alias("task")).distinct().groupBy("season").count())
    assert [(s, len(names)) for s, names in files.items()] == had and all(n > 1 for _, n in had)
    assert all(".zstd." in name for names in files.values() for name in names)
    folder.write("player_stats", first.filter("season = 2022").withColumn("week", F.col("week") + 100))
    again = spark.read.parquet(folder.where("player_stats")).select("player_id", "season", "week")
    assert rows(again) == rows(first.withColumn("week", F.expr("week + if(season = 2022, 100, 0)")))
    first.unpersist()
