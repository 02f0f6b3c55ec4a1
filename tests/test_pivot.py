import pytest

from snaplytics.functions.nulls import nan_to_null
from snaplytics.operators import pivot
from tests.helpers import plan, play, plays_table, rows, run, twelve_plays


@pytest.fixture(scope="module")
def plays(spark):
    return nan_to_null(twelve_plays(spark))


def test_rates_over_nothing_are_zero_but_unknown_totals_stay_unknown(plays):
    out = pivot.pivot_summary(plays, "week")
    assert rows(out, "posteam", "week", "passes", "dropback_epa", "rushes", "rush_epa", "sr", "rush_sr") == [
        ("A", 1, 3, 0.25, 2, 0.25, None, None),
        ("A", 2, 1, 2.0, 0, 0.0, 1.0, 0.0),
    ]


def test_plays_without_formation_are_left_out(plays):
    assert rows(pivot.pivot_summary(plays, "season"), "posteam") == [("A",)]


def test_dimensions_may_be_missing_and_must_be_known(spark, plays):
    df = plays_table(spark, [play(1, offense_personnel=None), run(2), run(3, offense_personnel="12")])
    assert rows(pivot.pivot_summary(df, ["offense_personnel", "offense_formation"]), "offense_personnel", "tot_plays") == [
        ("11", 1),
        ("12", 1),
        (None, 1),
    ]
    with pytest.raises(ValueError, match="nothing"):
        pivot.pivot_summary(plays, "week, nothing")
    assert pivot.pivot_summary(plays, "posteam").columns[:2] == ["posteam", "tot_plays"]


def test_a_dimension_may_not_hide_a_measure(plays):
    with pytest.raises(ValueError, match="sr"):
        pivot.pivot_summary(plays.withColumnRenamed("game_id", "sr"), "sr")


def test_team_table_is_sorted_by_plays(plays):
    table = pivot.pivot_table(plays, "A", "week", (1, 2))
    assert table.columns == ["week", *pivot.MEASURES]
    assert [(r["week"], r["tot_plays"]) for r in table.collect()] == [(1, 5), (2, 1)]


def test_team_week_by_personnel_equals_the_general_pivot(plays):
    week = pivot.personnel_table(plays, "A", 1)
    general = pivot.pivot_summary(plays, "offense_personnel", (1, 1)).filter("posteam = 'A'").drop("posteam")
    assert week.columns == ["offense_personnel", *pivot.MEASURES]
    assert rows(week) == rows(general)


def test_team_filter_moves_below_the_aggregate(spark, plays, tmp_path):
    plays.write.parquet(str(tmp_path / "plays"))
    text = plan(pivot.pivot_table(spark.read.parquet(str(tmp_path / "plays")), "A", "week", (1, 2)))
    assert "EqualTo(posteam,A)" in text and "LessThanOrEqual(week,2)" in text and "IsNotNull(epa)" in text


def test_a_season_is_kept_apart_from_the_others(spark):
    df = plays_table(spark, [play(1), play(2, season=2022, epa=4.0), run(3, season=2022)])
    assert rows(pivot.pivot_table(df, "A", "week", season=2022), "tot_plays") == [(2,)]
    assert rows(pivot.pivot_table(df, "A", "week"), "tot_plays") == [(3,)]
    assert rows(pivot.personnel_table(df, "A", 1, 2023), "offense_personnel", "tot_plays") == [("11", 1)]
    assert rows(pivot.personnel_table(df, "A", 1), "tot_plays") == [(3,)]
