"""Small hand-made tables and result access for the tests."""

from __future__ import annotations

import contextlib
import io


def rows(df, *columns):
    """Rows as tuples in a fixed order, missing values last."""
    picked = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(picked, key=lambda r: tuple((v is None, 0 if v is None else v) for v in r))


@contextlib.contextmanager
def settings(spark, values):
    """Session settings for a while."""
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def final_plan(df) -> str:
    """The plan after adaptive re-planning, from a run of the query."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


PLAY_COLUMNS = (
    "game_id string, play_id long, season int, week int, season_type string, posteam string, defteam string, "
    "pass int, rush int, epa double, success int, yards_gained double, passing_yards double, rushing_yards double, "
    "interception int, fumble_lost int, complete_pass int, two_point_attempt int, play_type string, "
    "receiver_player_id string, receiver_player_name string, offense_formation string, offense_personnel string"
)


def play(play_id, **given):
    base = dict(
        game_id="g1", play_id=play_id, season=2023, week=1, season_type="REG", posteam="A", defteam="B", rush=0,
        epa=0.5, success=1, yards_gained=5.0, passing_yards=None, rushing_yards=None, interception=0, fumble_lost=0,
        complete_pass=0, two_point_attempt=0, play_type="pass", receiver_player_id=None, receiver_player_name=None,
        offense_formation="SHOTGUN", offense_personnel="11",
    )
    base["pass"] = 1
    base.update(given)
    return base


def run(play_id, **given):
    return play(play_id, **{"pass": 0, "rush": 1, "play_type": "run", **given})


def plays_table(spark, plays):
    names = [part.split()[0] for part in PLAY_COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(p[n] for n in names) for p in plays], PLAY_COLUMNS)


def twelve_plays(spark):
    """Twelve plays with every kind of missing value the reports meet."""
    nan = float("nan")
    plays = [
        play(1, epa=1.0, yards_gained=25.0, passing_yards=25.0, complete_pass=1, receiver_player_id="r1"),
        play(2, epa=-0.5, success=0, yards_gained=0.0, receiver_player_id="r1"),
        play(3, epa=0.25, success=None, yards_gained=None, interception=1, passing_yards=None),
        run(4, epa=0.75, yards_gained=12.0, rushing_yards=12.0),
        run(5, epa=-0.25, success=0, yards_gained=2.0, rushing_yards=2.0, fumble_lost=1),
        play(6, epa=None),
        play(7, epa=nan),
        play(8, posteam=None, defteam="A"),
        play(9, defteam=None, week=2, epa=2.0),
        run(10, posteam="B", defteam="A", epa=0.125, yards_gained=None, offense_formation=None),
        play(11, **{"pass": None, "rush": None}),
        play(12, play_type="punt", **{"pass": 0, "rush": 0}),
    ]
    return plays_table(spark, plays)
