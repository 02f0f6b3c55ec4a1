import pytest

from snaplytics.operators.plays import (
    distinct_weeks,
    flag_explosive,
    in_weeks,
    join_charting,
    valid_plays,
    valid_targets,
    week_bounds,
)
from snaplytics.functions.nulls import nan_to_null
from tests.helpers import play, plays_table, rows, run, twelve_plays

CHARTING = (
    "nflverse_game_id string, nflverse_play_id long, season_charted int, is_no_huddle boolean, "
    "is_catchable_ball boolean, is_drop boolean"
)


@pytest.fixture(scope="module")
def plays(spark):
    return nan_to_null(twelve_plays(spark))


def test_valid_plays_drop_missing_value_team_and_other_kinds(plays):
    assert rows(valid_plays(plays), "play_id") == [(i,) for i in (1, 2, 3, 4, 5, 9, 10)]
    assert rows(valid_plays(plays, "defteam"), "play_id") == [(i,) for i in (1, 2, 3, 4, 5, 8, 10)]
    with pytest.raises(ValueError, match="nobody"):
        valid_plays(plays, "nobody")


def test_unknown_pass_with_a_known_run_is_a_play(spark):
    df = plays_table(spark, [run(1, **{"pass": None}), play(2, rush=None), run(3, rush=None)])
    assert rows(valid_plays(df), "play_id") == [(1,), (2,)]


def test_valid_targets(spark):
    df = plays_table(
        spark,
        [
            play(1, receiver_player_id="r"),
            play(2, receiver_player_id="r", two_point_attempt=1),
            play(3, receiver_player_id="r", two_point_attempt=None),
            play(4, receiver_player_id="r", play_type="no_play"),
            play(5, receiver_player_id="r", play_type=None),
            play(6),
            run(7, receiver_player_id="r"),
            play(8, receiver_player_id="r", epa=None),
        ],
    )
    assert rows(valid_targets(df), "play_id") == [(1,)]


def test_explosive_flags_are_unknown_without_yards(plays):
    out = flag_explosive(plays).filter("play_id in (1, 2, 3, 4, 5, 10, 11)")
    assert rows(out, "play_id", "explosive_pass", "explosive_run") == [
        (1, 1, 0),
        (2, 0, 0),
        (3, None, 0),
        (4, 0, 1),
        (5, 0, 0),
        (10, 0, None),
        (11, 0, 0),
    ]


def test_explosive_thresholds_are_parameters(plays):
    out = flag_explosive(plays, pass_yards=26, run_yards=2).filter("play_id in (1, 5)")
    assert rows(out, "play_id", "explosive_pass", "explosive_run") == [(1, 0, 0), (5, 0, 1)]


def test_charting_join_is_inner_and_keeps_the_flags(spark, plays):
    charting = spark.createDataFrame(
        [("g1", 1, 2023, False, True, None), ("g1", 4, 2023, True, None, False), ("g2", 2, 2023, True, True, True)], CHARTING
    )
    out = join_charting(plays, charting)
    assert out.columns == [*plays.columns, "is_no_huddle", "is_catchable_ball", "is_drop"]
    assert rows(out, "play_id", "is_no_huddle", "is_catchable_ball", "is_drop") == [
        (1, False, True, None),
        (4, True, None, False),
    ]


def test_charting_join_repeats_a_play_charted_twice(spark, plays):
    charting = spark.createDataFrame([("g1", 1, 2023, False, True, None)] * 2, CHARTING)
    assert rows(join_charting(plays, charting), "play_id") == [(1,), (1,)]


def test_charting_join_refuses_shared_names(spark, plays):
    charting = spark.createDataFrame([("g1", 1, 2023, False, 3)], "nflverse_game_id string, nflverse_play_id long, x int, is_no_huddle boolean, week int")
    with pytest.raises(ValueError, match="week"):
        join_charting(plays, charting)


def test_weeks(plays):
    assert rows(week_bounds(plays)) == [(1, 2)]
    assert rows(distinct_weeks(plays)) == [(1,), (2,)]
    assert rows(in_weeks(plays, (2, 2)), "play_id") == [(9,)]
    assert in_weeks(plays, (2, 1)).count() == 12
    assert in_weeks(plays, None) is plays
