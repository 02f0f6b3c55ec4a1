"""What the plans must look like at any size."""

import pytest

from checks.queries import RULES, Tables
from snaplytics import sources
from snaplytics.operators import plays, team_week as tw
from snaplytics.plans.award import labelled_quarterbacks, run_award_model
from snaplytics.plans.team_reports import TeamSources, team_result_tables, write_team_results
from tests.helpers import final_plan, plan, rows

FOLDER = "/root/testdata/sf0.001"


def test_play_columns_and_filters_reach_the_files(spark, tmp_path):
    Tables(spark, FOLDER).plays.write.partitionBy("season").parquet(str(tmp_path / "p"))
    df = tw.pair_totals(spark.read.parquet(str(tmp_path / "p")).filter("season = 1998"))
    text = plan(df)
    assert "IsNotNull(epa)" in text and "Or(EqualTo(pass,1),EqualTo(rush,1))" in text and "PartitionFilters" in text
    scanned = text.split("ReadSchema:")[1].split("\n")[0]
    assert "offense_personnel" not in scanned and "receiver_player_id" not in scanned and "game_id" not in scanned


def test_ranks_share_one_shuffle(spark):
    t = Tables(spark, FOLDER)
    without = plan(tw.week_stats(t.pairs, "offense")).count("hashpartitioning")
    ranked = plan(tw.week_ranks(tw.week_stats(t.pairs, "offense"), "offense"))
    assert ranked.count("hashpartitioning") == without + 1


def test_totals_are_combined_before_the_shuffle(spark):
    text = plan(Tables(spark, FOLDER).pairs)
    assert "partial_sum" in text and "partial_count" in text


def test_dimension_joins_turn_into_broadcasts(spark):
    executed = final_plan(Tables(spark, FOLDER).week_report("offense"))
    final = executed.split("== Initial Plan ==")[0]
    # games and the two logo joins after the totals; nothing small is sort-merged
    after_totals = final.split("HashAggregate")[0]
    assert after_totals.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in after_totals


def test_bucketed_tables_join_without_a_shuffle(spark):
    t = Tables(spark, FOLDER)
    sources.write_bucketed(t.plays, "bucketed_plays", ["game_id", "play_id"], 4)
    sources.write_bucketed(t.view("charting"), "bucketed_charting", ["nflverse_game_id", "nflverse_play_id"], 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = plays.join_charting(spark.table("bucketed_plays"), spark.table("bucketed_charting"))
        text = plan(joined)
        assert "SortMergeJoin" in text and "Exchange" not in text
        totals = plan(tw.pair_totals(joined))
        assert totals.count("hashpartitioning") == 1
        assert rows(joined, "play_id") == rows(t.charted, "play_id")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table bucketed_plays")
        spark.sql("drop table bucketed_charting")


@pytest.fixture(scope="module")
def team_sources(spark):
    t = Tables(spark, FOLDER)
    return TeamSources(t.plays, t.view("charting"), t.view("schedules"), t.logos, t.player_stats)


def test_team_results_are_written_and_equal_the_queries(spark, team_sources, tmp_path):
    folder = str(tmp_path / "results")
    names = write_team_results(team_sources, folder)
    assert set(names) == set(team_result_tables(team_sources))
    t = Tables(spark, FOLDER)
    for name, df in {
        "offense_week_report": t.week_report("offense"),
        "defense_eff_totals": t.eff_totals("defense"),
        "receiver_game": t.receiver_game,
    }.items():
        stored = spark.read.parquet(f"{folder}/{name}").select(*df.columns)
        assert stored.exceptAll(df).count() == 0 and df.exceptAll(stored).count() == 0


def test_award_job(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    run = run_award_model(labelled_quarterbacks(t.player_stats, t.view("standings"), t.view("mvps"), RULES), RULES)
    # 1996 is left out of the table and 1998 of the training seasons.
    assert run.model.rows == run.train.count() > 40 and run.model.converged
    assert rows(run.train.select("season").distinct()) == [(1995,), (1997,), (1999,)]
    assert rows(run.train.agg({"season": "max"})) == [(1999,)] and rows(run.test.agg({"season": "min"})) == [(2000,)]
    # A win total is missing in 2001, which makes all shares of that season unknown.
    (_, total), unknown = rows(run.test.groupBy("season").agg({"mvp_prob": "sum"}))
    assert abs(total - 1) < 1e-9 and unknown == (2001, None)


def test_checkpoint_folder_of_the_session_is_used():
    from snaplytics import session

    used = []

    class Context:
        master = "spark://cluster"

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            used.append(path)

    class Conf(dict):
        pass

    class Session:
        sparkContext = Context()
        conf = Conf({"spark.checkpoint.dir": "/shared/cuts"})

    assert session.checkpoint_folder(Session) == "/shared/cuts" and used == ["/shared/cuts"]
    Session.conf = Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Session)
