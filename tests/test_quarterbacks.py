import pytest

from snaplytics.operators import quarterbacks as qb
from tests.helpers import rows

STATS = (
    "season int, recent_team string, player_display_name string, player_id string, season_type string, position string, "
    "completions int, attempts int, passing_yards int, rushing_yards int, passing_tds int, rushing_tds int, "
    "interceptions int, passing_epa double"
)
RULES = qb.AwardRules(min_attempts=10)


def week(season, team, name, **given):
    base = dict(season_type="REG", position="QB", completions=5, attempts=10, passing_yards=100, rushing_yards=10,
                passing_tds=1, rushing_tds=0, interceptions=0, passing_epa=2.0)
    base.update(given)
    return (season, team, name, f"id-{name}", *base.values())


@pytest.fixture(scope="module")
def season_rows(spark):
    data = [
        week(2010, "A", "Ann"),
        week(2010, "A", "Ann", rushing_yards=None, passing_epa=None),
        week(2010, "A", "Ann", season_type="POST"),
        week(2010, "B", "Bob", attempts=20, completions=None, passing_epa=None),
        week(2010, "B", "Cat", attempts=9),
        week(2010, "B", "Dan", position="WR"),
        week(2005, "B", "Bob"),
        week(2002, "B", "Bob"),
        week(2011, None, "Eve", interceptions=3),
        week(2011, "C", "Fay"),
    ]
    return qb.qb_season(spark.createDataFrame(data, STATS), RULES)


def test_season_totals(season_rows):
    assert rows(season_rows) == [
        (2010, "A", "Ann", "id-Ann", 10, 20, 110, 2, 0, 2.0),
        (2010, "B", "Bob", "id-Bob", 0, 20, 110, 1, 0, None),
        (2011, "C", "Fay", "id-Fay", 5, 10, 110, 1, 0, 2.0),
        (2011, None, "Eve", "id-Eve", 5, 10, 110, 1, 3, 2.0),
    ]


def test_ranks_break_ties_by_position_and_number_the_missing(season_rows):
    out = qb.qb_ranks(season_rows)
    assert out.columns == [
        *("season", "player_display_name", "player_id", "cmp_rank", "att_rank", "yds_rank", "tds_rank", "int_rank", "epa_rank"),
        *("team", "total_interceptions"),
    ]
    assert rows(out, "season", "player_display_name", "cmp_rank", "att_rank", "yds_rank", "tds_rank", "int_rank", "epa_rank") == [
        (2010, "Ann", 1, 1, 1, 1, 1, 1),
        (2010, "Bob", 2, 2, 2, 2, 2, 2),
        (2011, "Eve", 2, 2, 2, 2, 2, 2),
        (2011, "Fay", 1, 1, 1, 1, 1, 1),
    ]


def test_win_rank_and_award(spark, season_rows):
    standings = spark.createDataFrame([(2010, "A", 10), (2010, "B", 10), (2011, "C", 7)], "season int, team string, wins int")
    award = spark.createDataFrame([(2010, "Bob", "QB"), (1999, "Old", "QB"), (2011, "Rob", "RB")], "Year int, Player string, Pos string")
    ranked = qb.with_win_rank(qb.qb_ranks(season_rows), standings)
    labelled = qb.with_award(ranked, qb.winners(award, 2003))
    assert labelled.columns[:4] == ["season", "player_display_name", "player_id", "team"] and labelled.columns[-1] == "mvp"
    assert rows(labelled, "season", "player_display_name", "wins", "win_rank", "mvp") == [
        (2010, "Ann", 10, 1.5, 0.0),
        (2010, "Bob", 10, 1.5, 1.0),
        (2011, "Eve", None, None, 0.0),
        (2011, "Fay", 7, 1.0, 0.0),
    ]
    # two missing cells (wins and its rank) times four rows
    assert rows(qb.missing_cells(labelled)) == [(8,)]
    assert rows(qb.missing_cells(labelled.filter("season = 2010"))) == [(0,)]
    assert rows(qb.frequencies(labelled, "mvp")) == [(0.0, 3), (1.0, 1)]
    assert rows(qb.frequencies(labelled, "wins")) == [(7, 1), (10, 2)]
    assert [r["player_display_name"] for r in qb.by_season_and_name(labelled).collect()] == ["Ann", "Bob", "Eve", "Fay"]


def test_a_winner_with_two_teams_is_labelled_twice(spark):
    ranked = spark.createDataFrame(
        [(2010, "Bob", "1", 3, "A"), (2010, "Bob", "1", 4, "B")],
        "season int, player_display_name string, player_id string, cmp_rank int, team string",
    )
    award = spark.createDataFrame([(2010, "Bob", "QB")], "Year int, Player string, Pos string")
    assert rows(qb.with_award(ranked, qb.winners(award, 2003)), "team", "mvp") == [("A", 1.0), ("B", 1.0)]


def test_split_by_season(spark):
    df = spark.createDataFrame([(s,) for s in range(2002, 2024)], "season int")
    rules = qb.AwardRules()
    train = [r[0] for r in rows(qb.training_rows(df, rules))]
    assert train == [s for s in range(2003, 2020) if s not in (2005, 2006, 2012)]
    assert [r[0] for r in rows(qb.testing_rows(df, rules))] == [2020, 2021, 2022, 2023]
