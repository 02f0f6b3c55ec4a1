import pytest

from snaplytics.operators.games import (
    current_teams,
    relabel_franchises,
    score_text,
    team_rows,
    team_week_points,
    with_result,
)
from tests.helpers import plan, rows

GAMES = (
    "season int, week int, home_team string, away_team string, home_score int, away_score int, "
    "home_rest int, away_rest int, spread_line double"
)


@pytest.fixture(scope="module")
def schedule(spark):
    return spark.createDataFrame(
        [
            (2023, 1, "A", "B", 24, 17, 7, 6, 3.5),
            (2023, 1, "C", "D", 10, 10, 7, 7, -1.0),
            (2023, 2, "A", "C", None, None, 7, 7, 0.0),
        ],
        GAMES,
    )


def test_each_game_is_seen_by_both_teams(schedule):
    out = team_rows(schedule)
    assert out.columns == [
        *("season", "week", "spread_line", "team", "team_score", "team_rest"),
        *("opponent", "opponent_score", "opponent_rest"),
    ]
    assert rows(out.filter("week = 1"), "team", "opponent", "team_score", "opponent_score", "team_rest", "spread_line") == [
        ("A", "B", 24, 17, 7, 3.5),
        ("B", "A", 17, 24, 6, 3.5),
        ("C", "D", 10, 10, 7, -1.0),
        ("D", "C", 10, 10, 7, -1.0),
    ]


def test_chosen_columns_change_sign_for_the_away_team(schedule):
    out = team_rows(schedule, invert=["spread_line"]).filter("week = 1")
    assert rows(out, "team", "spread_line") == [("A", 3.5), ("B", -3.5), ("C", -1.0), ("D", 1.0)]
    with pytest.raises(ValueError):
        team_rows(schedule, invert=["line"])


def test_games_are_read_once_for_both_teams(schedule, tmp_path, spark):
    schedule.write.parquet(str(tmp_path / "games"))
    text = plan(team_rows(spark.read.parquet(str(tmp_path / "games"))))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details


def test_results_and_score_text(schedule):
    out = with_result(team_rows(schedule)).withColumn("text", score_text())
    assert rows(out, "week", "team", "result", "text") == [
        (1, "A", "W", "24-17"),
        (1, "B", "L", "17-24"),
        (1, "C", "T", "10-10"),
        (1, "D", "T", "10-10"),
        (2, "A", None, "NA-NA"),
        (2, "C", None, "NA-NA"),
    ]


def test_points_per_team_and_week(schedule):
    games = team_rows(schedule)
    assert rows(team_week_points(games, "opponent_score"), "week", "team", "pts") == [
        (1, "A", 17),
        (1, "B", 24),
        (1, "C", 10),
        (1, "D", 10),
        (2, "A", None),
        (2, "C", None),
    ]


def test_teams_and_standings(spark):
    teams = spark.createDataFrame([("SF",), ("OAK",), (None,), ("LAR",)], "team_abbr string")
    assert rows(current_teams(teams)) == [("SF",), (None,)]
    standings = spark.createDataFrame([(2003, "OAK"), (2003, "SF"), (2003, None), (2010, "SD"), (2010, "STL")], "season int, team string")
    assert rows(relabel_franchises(standings)) == [(2003, "LV"), (2003, "SF"), (2003, None), (2010, "LA"), (2010, "LAC")]
