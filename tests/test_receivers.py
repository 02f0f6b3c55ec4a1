import pytest

from snaplytics.operators import receivers as rc
from tests.helpers import play, plays_table, rows

FLAGS = "is_no_huddle boolean, is_catchable_ball boolean, is_contested_ball boolean, is_created_reception boolean, is_drop boolean"
STATS = (
    "player_id string, player_name string, player_display_name string, position string, headshot_url string, season int, "
    "week int, targets int, receptions int, receiving_yards int, receiving_fumbles int, receiving_air_yards int, "
    "receiving_epa double, racr double, air_yards_share double, wopr double"
)


@pytest.fixture(scope="module")
def charted(spark):
    """Targets with charting flags: (receiver, week, catchable, contested, created, drop)."""
    spec = [
        ("r1", 1, True, True, False, False),
        ("r1", 1, True, False, True, False),
        ("r1", 1, False, True, False, False),
        ("r1", 2, None, False, False, True),
        ("r1", 2, True, False, False, True),
        ("r2", 1, False, False, False, False),
        ("r3", 1, True, False, False, False),
        ("qb", 1, True, False, False, False),
    ]
    plays = [
        play(i, week=s[1], receiver_player_id=s[0], receiver_player_name=s[0].upper(), complete_pass=i % 2, epa=i / 8)
        for i, s in enumerate(spec, 1)
    ]
    flags = spark.createDataFrame([(i, False, *s[2:]) for i, s in enumerate(spec, 1)], f"play_id long, {FLAGS}")
    return plays_table(spark, plays).join(flags, "play_id")


@pytest.fixture(scope="module")
def stats(spark):
    def row(player, position, week, targets, receptions, epa, season=2023):
        name = player.upper()
        return (player, name, f"{name} Full", position, f"img/{player}", season, week, targets, receptions, 10, 0, 5, epa, 1.0, 0.1, 0.2)

    return spark.createDataFrame(
        [
            row("r1", "WR", 1, 3, 2, 0.75),
            row("r1", "WR", 2, 3, 1, 1.0),
            row("r1", "WR", 1, 9, 9, 9.0, season=2022),
            row("r2", "TE", 1, 0, 0, 1.0),
            row("qb", "QB", 1, 1, 0, 0.5),
        ],
        STATS,
    )


def test_charting_counts(charted):
    out = rc.charting_counts(charted)
    assert rows(
        out, "receiver_player_id", "week", "targets_pbp", "catchable_contested", "catchable_not_contested", "not_catchable",
        "created_receptions", "drops",
    ) == [
        ("qb", 1, 1, 0, 1, 0, 0, 0),
        ("r1", 1, 3, 1, 1, 1, 1, 0),
        ("r1", 2, 2, None, None, None, 0, 2),
        ("r2", 1, 1, 0, 0, 1, 0, 0),
        ("r3", 1, 1, 0, 1, 0, 0, 0),
    ]


def test_official_columns_end_at_the_share_and_leave_some_out(stats):
    assert rc.receiving_columns(stats) == ["targets", "receptions", "receiving_yards", "receiving_epa", "air_yards_share"]
    assert rc.receiving_columns(stats.drop("air_yards_share", "wopr")) == ["targets", "receptions", "receiving_yards", "receiving_epa"]


def test_quality_check_keeps_unmatched_receivers_and_only_the_same_season(charted, stats):
    out = rc.receiver_qc(charted, stats)
    assert rows(out, "receiver_player_id", "week", "targets_diff", "receptions_diff", "epa_diff", "epa_per_target") == [
        ("qb", 1, 0, 0, 0.5, 0.5),
        ("r1", 1, 0, 0, 0.0, 0.25),
        ("r1", 2, -1, 0, 0.125, 0.5),
        ("r2", 1, 1, 0, -0.25, 1.0),
        ("r3", 1, None, None, None, None),
    ]


def test_receiver_game_keeps_receiving_positions(charted, stats):
    out = rc.receiver_game(charted, stats)
    assert out.columns[:14] == list(rc.FIRST)
    assert "receiver_player_name" not in out.columns and "player_name" not in out.columns
    assert rows(out, "receiver_player_id", "week") == [("r1", 1), ("r1", 2), ("r2", 1)]


def test_breakdown_takes_official_totals_and_charted_counts(charted, stats):
    games = rc.receiver_game(charted, stats)
    both = rc.receiver_breakdown(games)
    assert rows(both, "player_display_name", "targets", "receptions", "not_catchable", "drops", "total_epa", "epa_per_target") == [
        ("R1 Full", 6, 3, None, 2, 1.75, 1.75 / 6),
        ("R2 Full", 0, 0, 1, 0, 1.0, None),
    ]
    one = rc.receiver_breakdown(games, (1, 1)).filter("position = 'WR'").first()
    assert one["not_catchable_rate"] == 1 / 3


def test_team_table_is_sorted_by_targets(charted, stats):
    table = rc.receiver_table(rc.receiver_game(charted, stats), "A", (1, 2), 2023)
    assert table.columns[:4] == ["headshot_url", "player_display_name", "position", "targets"]
    assert [r["targets"] for r in table.collect()] == [6, 0]
    assert rc.receiver_table(rc.receiver_game(charted, stats), "B").collect() == []
