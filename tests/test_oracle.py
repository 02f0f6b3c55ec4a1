"""Every registered query with SQL: its result against the second engine, and its plan."""

import re

import pytest

from checks.compare import connect, difference
from checks.oracle import oracle_sql
from checks.queries import queries
from tests.helpers import plan

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    return connect(FOLDER)


def test_constants_restated_in_the_sql_are_those_of_the_jobs():
    from checks import oracle
    from snaplytics.operators import award_model, pivot, team_week

    assert (oracle.EPSILON, oracle.LOGIT_LIMIT, oracle.INTERCEPT) == (award_model.EPSILON, award_model.LOGIT_LIMIT, award_model.INTERCEPT)
    assert list(oracle.WEEK_TABLE) == list(team_week.WEEK_TABLE) and list(oracle.RACE_COLUMNS) == list(award_model.RACE_COLUMNS)
    assert list(oracle.MEASURES) == list(pivot.MEASURES) and list(oracle.WEEK_RATES) == list(team_week.WEEK_RATES)


def test_every_sql_text_belongs_to_a_query():
    assert set(oracle_sql()) <= set(queries())


NOT_WANTED = ("PythonUDF", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin")


# In the smallest tables the classes separate: there is no largest likelihood whose equations could hold.
NO_FIT = {"mvp_score_equations", "mvp_coefficients", "mvp_fit", "mvp_model_scored", "mvp_test_metrics"}


@pytest.mark.parametrize("name", sorted(set(oracle_sql()) - NO_FIT))
def test_query_equals_sql(spark, engine, name):
    df = queries()[name](spark, FOLDER)
    assert difference(df, engine, oracle_sql()[name]) is None
    text = plan(df)
    # No Python per row, no product of tables, no window over everything.
    assert [operator for operator in NOT_WANTED if operator in text] == []
    assert not re.search(r"windowspecdefinition\([^,()]+ (ASC|DESC)", text)


@pytest.mark.parametrize("name", sorted(NO_FIT))
def test_fitted_model_equals_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    assert difference(queries()[name](spark, folder), connect(folder), oracle_sql()[name]) is None
