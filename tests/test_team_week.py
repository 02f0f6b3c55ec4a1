import pytest
from pyspark.sql import functions as F

from snaplytics.functions.nulls import nan_to_null
from snaplytics.operators import team_week as tw
from snaplytics.operators.games import team_rows
from tests.helpers import play, plays_table, rows, run, twelve_plays
from tests.test_games import GAMES


@pytest.fixture(scope="module")
def pairs(spark):
    return tw.pair_totals(nan_to_null(twelve_plays(spark)))


@pytest.fixture(scope="module")
def games(spark):
    return team_rows(
        spark.createDataFrame([(2023, 1, "A", "B", 24, 17, 7, 6, 3.5), (2023, 2, "A", "C", None, None, 7, 7, 0.0)], GAMES)
    )


@pytest.fixture(scope="module")
def logos(spark):
    return spark.createDataFrame([("A", "espn/A", "word/A"), ("B", "espn/B", "word/B")], "team_abbr string, team_logo_espn string, team_wordmark string")


def test_offense_week(pairs):
    week = tw.week_stats(pairs, "offense").filter("team = 'A' and week = 1").collect()
    assert len(week) == 1
    w = week[0].asDict()
    # plays 1 to 5: three passes (one with unknown success), two runs
    assert (w["opponent"], w["type"], w["passes"], w["rushes"], w["tot_plays"]) == ("B", "offense", 3, 2, 5)
    assert w["epa_per_play"] == (1.0 - 0.5 + 0.25 + 0.75 - 0.25) / 5
    assert w["dropback_epa"] == 0.75 / 3 and w["rush_epa"] == 0.25
    # one unknown success makes every success rate of the group unknown, also the runs'
    assert w["sr"] is None and w["dropback_sr"] is None and w["rush_sr"] is None
    assert w["dropback_explosive"] == 1 / 3 and w["rush_explosive"] == 0.5
    assert (w["interceptions"], w["lost_fumbles"], w["tot_tos"]) == (1, 1, 2)
    assert (w["passing_yds"], w["rushing_yds"], w["tot_yds"]) == (25.0, 14.0, 39.0)


def test_rates_over_no_plays_are_unknown_and_totals_zero(pairs):
    w = tw.week_stats(pairs, "offense").filter("team = 'B'").first()
    assert w["passes"] == 0 and w["dropback_epa"] is None and w["dropback_explosive"] is None
    assert w["rush_explosive"] == 0.0 and w["rushing_yds"] == 0.0


def test_missing_opponent_keeps_its_group(pairs):
    assert rows(tw.week_stats(pairs, "offense").filter("week = 2"), "team", "opponent", "epa_per_play") == [("A", None, 2.0)]


def test_defense_swaps_teams_and_needs_its_own(pairs):
    stats = tw.week_stats(pairs, "defense")
    assert rows(stats, "week", "team", "opponent", "passes", "rushes") == [
        (1, "A", "B", 0, 1),
        (1, "A", None, 1, 0),
        (1, "B", "A", 3, 2),
    ]
    with pytest.raises(ValueError):
        tw.week_stats(pairs, "both")


def test_ranks_run_high_on_offense_and_low_on_defense(spark):
    stats = spark.createDataFrame(
        [("A", 0.5), ("B", 0.5), ("C", 0.1), ("D", None)], "team string, x double"
    ).select(F.lit(2023).alias("season"), F.lit(1).alias("week"), "team", *[F.col("x").alias(r) for r in tw.WEEK_RATES])
    assert rows(tw.week_ranks(stats, "offense"), "team", "sr_rank") == [("A", 1), ("B", 1), ("C", 3), ("D", None)]
    assert rows(tw.week_ranks(stats, "defense"), "team", "sr_rank") == [("A", 2), ("B", 2), ("C", 1), ("D", None)]


def test_week_report_and_table(pairs, games, logos):
    report = tw.week_report(pairs, games, logos, "offense")
    assert rows(report, "week", "team", "result", "final_score", "opp_logo", "team_logo", "team_rest") == [
        (1, "A", "W", "24-17", "espn/B", "word/A", 7),
        (1, "B", "L", "17-24", "espn/A", "word/B", 6),
        (2, "A", None, "NA-NA", None, "word/A", 7),
    ]
    table = tw.week_table(report, "A", (1, 1), 2023)
    assert table.columns == list(tw.WEEK_TABLE)
    first = table.first()
    assert first["epa_per_play_rank"] == 1 and first["rush_epa_rank"] == 1 and first["dropback_epa_rank"] == 1


def test_effectiveness_totals_and_points(pairs, games, logos):
    totals = tw.eff_totals(pairs, games, logos, "defense")
    # the two games of A's defense in the week are one row; points are the opponent's
    assert rows(totals, "week", "team", "total_plays", "total_epa", "pts", "team_logo") == [
        (1, "A", 2, 0.625, 17, "espn/A"),
        (1, "B", 5, 1.25, 24, "espn/B"),
    ]


@pytest.fixture(scope="module")
def league(spark):
    plays, n = [], 0
    for week in (1, 2, 3):
        for i, (team, other) in enumerate([("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")]):
            for k in range(6):
                n += 1
                kind = play if (k + i + week) % 2 else run
                yards = float((k * 7 + i * 5 + week) % 31)
                plays.append(
                    kind(n, week=week, posteam=team, defteam=other, epa=((k * 3 + i * 5 + week) % 9 - 4) / 8, success=(k + i) % 2, yards_gained=yards)
                )
    pairs = tw.pair_totals(plays_table(spark, plays))
    return pairs.persist()


SHARED = {"epa_per_play": "epa_per_play", "sr": "sr", "dropback_epa": "dropback_epa", "dropback_sr": "dropback_sr",
          "dropback_exp": "dropback_explosive", "rush_epa": "rush_epa", "rush_sr": "rush_sr", "rush_exp": "rush_explosive"}


@pytest.mark.parametrize("side", ["offense", "defense"])
def test_summary_of_one_week_equals_the_weekly_rates(league, games, logos, side):
    totals = tw.eff_totals(league, games, logos, side)
    for week in (1, 2, 3):
        one = rows(tw.eff_rates(totals, (week, week)), "team", *SHARED)
        weekly = tw.week_stats(league, side).filter(F.col("week") == week)
        assert one == rows(weekly, "team", *SHARED.values())


def test_offense_and_defense_add_up_to_the_same(league):
    offense, defense = (
        rows(tw.side_totals(league, s).groupBy("week").agg(F.sum("total_epa"), F.sum("total_plays"))) for s in tw.SIDES
    )
    assert offense == defense


def test_ranks_are_against_the_whole_league_before_the_team_is_picked(spark, league, games, logos):
    standings = spark.createDataFrame([(2023, "A", 10, 6, 1)], "season int, team string, wins int, losses int, ties int")
    totals = tw.eff_totals(league, games, logos, "offense")
    everyone = tw.eff_summary(totals, standings)
    one = tw.eff_summary(totals, standings, team="A")
    assert one.columns[:3] == ["season", "team_logo", "epa_per_play"] and one.columns[-3:] == ["wins", "losses", "ties"]
    assert one.count() == 1
    expected = everyone.filter("team = 'A'").select(*one.columns).first()
    assert one.first() == expected and expected["wins"] == 10
    ranks = [r[0] for r in rows(everyone, "epa_per_play_rank")]
    assert ranks[0] == 1 and all(1 <= r <= 4 for r in ranks)


def test_unplayed_week_makes_points_unknown(league, games, logos):
    totals = tw.eff_totals(league, games, logos, "offense")
    assert rows(tw.eff_rates(totals, (1, 1)).filter("team = 'A'"), "pts") == [(24,)]
    assert rows(tw.eff_rates(totals, (1, 2)).filter("team = 'A'"), "pts") == [(None,)]
