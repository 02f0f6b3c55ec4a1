import math
import warnings
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from snaplytics.operators import award_model as am
from tests.helpers import rows


def irls(x, y, offset=None, tol=1e-12):
    """Logistic regression by Newton steps: estimates, standard errors and deviance."""
    offset = np.zeros(len(y)) if offset is None else offset
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        mu = 1 / (1 + np.exp(-(x @ beta + offset)))
        info = x.T @ (x * (mu * (1 - mu))[:, None])
        step = np.linalg.solve(info, x.T @ (y - mu))
        beta = beta + step
        if np.abs(step).max() < tol:
            break
    mu = 1 / (1 + np.exp(-(x @ beta + offset)))
    deviance = -2 * np.sum(y * np.log(mu) + (1 - y) * np.log(1 - mu))
    return beta, np.sqrt(np.diag(np.linalg.inv(info))), deviance


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.integers(1, 33, 400), rng.integers(1, 33, 400), rng.integers(1, 33, 400), rng.integers(1, 33, 400), rng.integers(0, 20, 400)]).astype(float)
    eta = 1.5 - 0.15 * x[:, 0] - 0.05 * x[:, 1] - 0.08 * x[:, 2] + 0.01 * x[:, 3] - 0.04 * x[:, 4]
    y = (rng.random(400) < 1 / (1 + np.exp(-eta))).astype(float)
    return x, y


@pytest.fixture(scope="module")
def training(spark, data):
    x, y = data
    table = [(2000 + i % 10, f"p{i:03d}", f"T{i % 7}", f"id{i}", *map(float, row), float(label)) for i, (row, label) in enumerate(zip(x, y))]
    columns = "season int, player_display_name string, team string, player_id string, " + ", ".join(f"{c} double" for c in [*am.FEATURES, "mvp"])
    return spark.createDataFrame(table, columns)


@pytest.fixture(scope="module")
def model(training):
    return am.fit(training)


def test_fit_agrees_with_newton_steps(model, data):
    x, y = data
    beta, errors, deviance = irls(np.column_stack([np.ones(len(y)), x]), y)
    assert model.terms == (am.INTERCEPT, *am.FEATURES)
    np.testing.assert_allclose(model.estimates, beta, rtol=1e-6)
    np.testing.assert_allclose(model.errors, errors, rtol=1e-6)
    assert math.isclose(model.deviance, deviance, rel_tol=1e-9)
    assert math.isclose(model.aic, deviance + 2 * 6, rel_tol=1e-9)
    assert model.rows == 400 and not model.separated


def test_rows_with_missing_features_do_not_change_the_fit(spark, training, model):
    hole = training.limit(5).withColumn("win_rank", F.lit(None).cast("double"))
    again = am.fit(training.unionByName(hole))
    np.testing.assert_allclose(again.estimates, model.estimates, rtol=1e-7)
    assert again.rows == model.rows


def test_coefficient_and_fit_tables(spark, model):
    table = {r["term"]: r for r in am.coefficient_table(spark, model).collect()}
    r = table["tds_rank"]
    assert math.isclose(r["z"], r["estimate"] / r["std_error"])
    assert math.isclose(r["p_value"], math.erfc(abs(r["z"]) / math.sqrt(2)), rel_tol=1e-12)
    assert math.isclose(r["wald_high"] - r["wald_low"], 2 * 1.959963984540054 * r["std_error"])
    fitted = am.fit_table(spark, model).first()
    assert fitted["residual_df"] == 394 and fitted["null_df"] == 399 and fitted["converged"]


def test_p_of_a_far_out_z_keeps_its_digits(spark, model):
    far = replace(model, estimates=tuple(12.0 * e for e in model.errors))
    for r in am.coefficient_table(spark, far).collect():
        assert math.isclose(r["z"], 12.0) and math.isclose(r["p_value"], 3.552964224155e-33, rel_tol=1e-9)


def test_a_fit_that_is_stopped_says_so(training):
    assert not am.fit(training, max_iter=2).converged


def test_score_equations_hold(training, model):
    out = {r["term"]: r["score"] for r in am.score_equations(training, model).collect()}
    assert list(out) == list(model.terms) and max(map(abs, out.values())) < 1e-5


def test_profile_intervals_agree_with_refits(training, data):
    x, y = np.column_stack([np.ones(400), data[0][:, 0]]), data[1]
    model = am.fit(training, ["tds_rank"])
    limits = am.profile_intervals(training.coalesce(1), model)
    out = {r["term"]: r for r in am.coefficient_table(training.sparkSession, model, limits).collect()}
    for j, term in enumerate(model.terms):
        assert out[term]["low_converged"] and out[term]["high_converged"]
        for bound in (out[term]["conf_low"], out[term]["conf_high"]):
            gained = irls(np.delete(x, j, axis=1), y, offset=bound * x[:, j])[2] - model.deviance
            assert math.isclose(math.sqrt(gained), 1.959963984540054, abs_tol=2e-3)
        assert out[term]["conf_low"] < out[term]["estimate"] < out[term]["conf_high"]


def test_column_expression_scores_as_the_fitted_model(training, model):
    assembled = VectorAssembler(inputCols=list(am.FEATURES), outputCol="features").transform(training)
    glm = GeneralizedLinearRegression(family="binomial", link="logit", labelCol="mvp", tol=1e-8)
    theirs = {r["player_id"]: r["prediction"] for r in glm.fit(assembled).transform(assembled).collect()}
    ours = {r["player_id"]: r["pred"] for r in am.score(training, model.coefficients).collect()}
    assert ours.keys() == theirs.keys()
    assert max(abs(ours[k] - theirs[k]) for k in ours) < 1e-9


def test_probabilities_add_up_per_season(training, model):
    scored = am.score(training, model.coefficients)
    sums = rows(scored.groupBy("season").agg(F.sum("mvp_prob"), F.sum("pred_mvp")))
    assert len(sums) == 10 and all(abs(s - 1) < 1e-12 and f >= 1 for _, s, f in sums)


ONE = {am.INTERCEPT: 0.0, "x": 1.0}


def test_unknown_feature_and_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0), (2, "c", None), (2, "d", 1.0), (3, "e", None)], "season int, k string, x double")
    out = rows(am.score(df, ONE), "season", "k", "pred", "pred_mvp", "mvp_prob")
    p = 1 / (1 + math.exp(-1))
    assert out[:2] == [(1, "a", 0.5, 1.0, 0.5), (1, "b", 0.5, 1.0, 0.5)]
    assert out[2] == (2, "c", None, None, None) and out[4] == (3, "e", None, None, None)
    assert out[3][:2] == (2, "d") and math.isclose(out[3][2], p) and out[3][3] == 1.0 and out[3][4] is None


def test_probability_is_flat_far_out(spark):
    df = spark.createDataFrame([(-900.0,), (-31.0,), (31.0,), (900.0,)], "x double")
    low, low2, high, high2 = (r[0] for r in df.select(am.probability(ONE)).collect())
    assert 0 < low == low2 < 1e-15 and low2 < 1 - high < 1e-15 and high == high2 < 1


def test_separated_classes_warn(spark):
    df = spark.createDataFrame([(float(i), 0.0 if i < 10 else 1.0) for i in range(20)], "x double, mvp double")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        model = am.fit(df, features=["x"])
    assert model.separated and any("separated" in str(w.message) for w in caught)
    assert [tuple(r)[1:] for r in am.profile_intervals(df, model).collect()] == [(None, None, False, False)] * 2


def limit(deviance, *args):
    values = am._limit(*args)
    value = next(values)
    while True:
        try:
            value = values.send(deviance(value))
        except StopIteration as end:
            return end.value


def test_limit_behind_a_flat_stretch():
    flat = lambda b: 1.0 + max(0.0, b - 1000.0) ** 2
    assert limit(flat, 1.0, 0.0, 1.0, 1e-4, 12) is None
    assert limit(flat, 1.0, 0.0, 1.0, 1e-4, 60) == pytest.approx(1001.959964, abs=1e-3)


def test_limit_that_is_never_reached_is_unknown():
    assert limit(lambda b: 1.0 + min(abs(b), 1.0), 1.0, 0.0, 1.0, 1e-4, 12) is None
    assert limit(lambda b: 1.0 + b * b, 1.0, 0.0, -1.0, 1e-4, 12) == pytest.approx(-1.959964, abs=1e-4)
    assert limit(lambda b: 1.0 + abs(b) ** 3, 1.0, 0.0, 1.0, 1e-4, 12) == pytest.approx(3.841459 ** (1 / 3), abs=1e-3)


def test_searches_that_end_early_leave_the_others_alone(training, model, monkeypatch):
    """A search whose refit does not settle is unknown; the passes go on for the rest."""
    true_refit = am._refit
    monkeypatch.setattr(am, "_refit", lambda beta, place: true_refit(beta, place) if place != 1 else _stopped(beta))
    out = {r["term"]: r for r in am.profile_intervals(training, model, tolerance=0.05).collect()}
    assert not out["tds_rank"]["low_converged"] and out["tds_rank"]["conf_high"] is None
    assert all(r["low_converged"] and r["high_converged"] for t, r in out.items() if t != "tds_rank")


def _stopped(beta):
    yield beta
    return None


def test_all_limits_share_passes(training, model, monkeypatch):
    passes, sums = [], am._sums
    monkeypatch.setattr(am, "_sums", lambda rows, asked, terms: passes.append(len(asked)) or sums(rows, asked, terms))
    am.profile_intervals(training, model, tolerance=0.01).collect()
    assert passes[0] == 2 * len(model.terms) and len(passes) < 60


def test_confusion_and_metrics(spark):
    pairs = [(1.0, 1.0)] * 5 + [(1.0, 0.0)] * 3 + [(0.0, 1.0)] * 2 + [(0.0, 0.0)] * 90 + [(None, 1.0), (1.0, None)]
    scored = spark.createDataFrame(pairs, "pred_mvp double, mvp double")
    counts = am.confusion(scored)
    assert rows(counts) == [(0.0, 0.0, 90), (0.0, 1.0, 2), (1.0, 0.0, 3), (1.0, 1.0, 5)]
    out = am.binary_metrics(counts)
    got = {r["metric"]: r["estimate"] for r in out.collect()}
    assert tuple(got) == am.METRICS
    chance = (8 * 7 + 92 * 93) / 100**2
    expected = {
        "accuracy": 0.95, "kap": (0.95 - chance) / (1 - chance), "sens": 5 / 7, "spec": 90 / 93, "ppv": 5 / 8, "npv": 90 / 92,
        "mcc": (5 * 90 - 3 * 2) / math.sqrt(8 * 7 * 93 * 92), "j_index": 5 / 7 + 90 / 93 - 1, "bal_accuracy": (5 / 7 + 90 / 93) / 2,
        "detection_prevalence": 0.08, "precision": 5 / 8, "recall": 5 / 7, "f_meas": 2 * (5 / 8) * (5 / 7) / (5 / 8 + 5 / 7),
    }
    assert got == pytest.approx(expected)


def test_metrics_without_events_are_unknown(spark):
    counts = spark.createDataFrame([(0.0, 0.0, 4)], "pred_mvp double, mvp double, n long")
    got = {r["metric"]: r["estimate"] for r in am.binary_metrics(counts).collect()}
    assert got["accuracy"] == 1.0 and got["spec"] == 1.0 and got["sens"] is None and got["precision"] is None and got["mcc"] is None


@pytest.fixture(scope="module")
def scored(spark):
    columns = "season int, player_display_name string, team string, player_id string, mvp double, pred_mvp double, mvp_prob double, " + ", ".join(f"{c} int" for c in am.RACE_COLUMNS[3:])
    ranks = (1, 1, 1, 1, 0)
    return spark.createDataFrame(
        [
            (2020, "Ann", "A", "1", 1.0, 1.0, 0.9, *ranks),
            (2021, "Ann", "A", "1", 1.0, 0.0, 0.2, *ranks),
            (2021, "Eve", "B", "2", 0.0, 1.0, 0.4, *ranks),
            (2021, "Bob", "C", "3", 0.0, 1.0, 0.4, *ranks),
            (2022, "Bob", "C", "3", 1.0, 0.0, None, *ranks),
            (2022, "Cat", "A", "4", 0.0, None, None, *ranks),
        ],
        columns,
    )


def test_missed_seasons_name_all_tied_favourites(scored):
    out = am.missed_seasons(scored)
    assert out.columns == ["season", "Actual MVP", "Predicted MVP"]
    assert rows(out) == [(2021, "Ann", "Bob"), (2021, None, "Eve"), (2022, "Bob", None)]


def test_misses(scored):
    assert rows(am.misses(scored)) == [
        (2021, "Ann", "Actual MVP"),
        (2021, "Bob", "Predicted MVP"),
        (2021, "Eve", "Predicted MVP"),
        (2022, "Bob", "Actual MVP"),
    ]


def test_race_order_and_length(scored):
    race = am.mvp_race(scored, 2021, rows=2)
    assert race.columns == list(am.RACE_COLUMNS)
    assert [r["player_display_name"] for r in race.collect()] == ["Bob", "Eve"]
    everyone = am.mvp_races(scored, rows=2)
    assert rows(everyone, "season", "place", "player_display_name") == [
        (2020, 1, "Ann"),
        (2021, 1, "Bob"),
        (2021, 2, "Eve"),
        (2022, 1, "Bob"),
        (2022, 2, "Cat"),
    ]
