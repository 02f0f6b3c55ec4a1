"""The award model: fit, coefficients, season probabilities and how well they predict."""

from __future__ import annotations

import warnings
from collections.abc import Generator, Mapping, Sequence
from dataclasses import dataclass
from math import erfc, inf, sqrt

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.storagelevel import StorageLevel

from snaplytics.functions.columns import require
from snaplytics.functions.nulls import ratio, strict_sum
from snaplytics.functions.ranks import RankSpec, ordinal_ranks, with_group_totals

# The model's terms.
FEATURES = ("tds_rank", "yds_rank", "win_rank", "epa_rank", "total_interceptions")
INTERCEPT = "(Intercept)"
# The inverse logit is flat beyond 30 and stays a machine epsilon off 0 and 1.
LOGIT_LIMIT = 30.0
EPSILON = 2.220446049250313e-16
WALD_95 = 1.959963984540054
ACTUAL, PREDICTED = "Actual MVP", "Predicted MVP"
TIE_KEY = ("player_display_name", "team", "player_id")
DIFFUSE_ERROR = 100.0  # a standard error this large on rank features means separated classes


@dataclass(frozen=True)
class AwardModel:
    """A fitted logistic model: terms in order, intercept first."""

    terms: tuple[str, ...]
    estimates: tuple[float, ...]
    errors: tuple[float, ...]
    deviance: float
    null_deviance: float
    aic: float
    rows: int
    iterations: int
    converged: bool

    @property
    def coefficients(self) -> dict[str, float]:
        return dict(zip(self.terms, self.estimates))

    @property
    def separated(self) -> bool:
        return max(self.errors) > DIFFUSE_ERROR


def fit(training: DataFrame, features: Sequence[str] = FEATURES, label: str = "mvp", max_iter: int = 25) -> AwardModel:
    """Logistic regression by iterated least squares; rows with a missing value are left out.

    Every iteration is one distributed pass that adds up a small matrix per partition. A fit that
    ``max_iter`` stops is returned with ``converged`` false.
    The rows are kept in executor memory (or disk) for these passes and released after.
    """
    features = require(training, features)
    require(training, [label])
    complete = training.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]).dropna()
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(complete)
    rows = rows.select("features", label).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        glm = GeneralizedLinearRegression(
            family="binomial", link="logit", labelCol=label, featuresCol="features", regParam=0.0, tol=1e-8, maxIter=max_iter
        )
        model = glm.fit(rows)
        summary = model.summary
        errors = list(summary.coefficientStandardErrors)  # intercept comes last
        fitted = AwardModel(
            terms=(INTERCEPT, *features),
            estimates=(float(model.intercept), *map(float, model.coefficients)),
            errors=(errors[-1], *errors[:-1]),
            deviance=summary.deviance,
            null_deviance=summary.nullDeviance,
            aic=summary.aic,
            rows=summary.numInstances,
            iterations=summary.numIterations,
            converged=summary.numIterations < max_iter,
        )
    finally:
        rows.unpersist()
    if fitted.separated:
        warnings.warn("the classes are (nearly) separated: estimates and errors are not finite in the limit", stacklevel=2)
    return fitted


COEFFICIENT_TABLE = (
    "term string, estimate double, std_error double, z double, p_value double, wald_low double, wald_high double"
)
LIMIT_TABLE = "term string, conf_low double, conf_high double, low_converged boolean, high_converged boolean"


def coefficient_table(spark, model: AwardModel, limits: DataFrame | None = None) -> DataFrame:
    """One row per term: log-odds estimate, error, z, p and the 95 % Wald interval.

    With ``limits`` (see ``profile_intervals``) also the profile-likelihood interval.
    """
    rows = []
    for term, estimate, error in zip(model.terms, model.estimates, model.errors):
        z = estimate / error
        p = erfc(abs(z) / sqrt(2.0))
        rows.append((term, estimate, error, z, p, estimate - WALD_95 * error, estimate + WALD_95 * error))
    table = spark.createDataFrame(rows, COEFFICIENT_TABLE)
    return table if limits is None else table.join(limits, "term", "left")


def profile_intervals(
    training: DataFrame, model: AwardModel, label: str = "mvp", tolerance: float = 1e-3, max_refits: int = 30
) -> DataFrame:
    """95 % profile-likelihood interval of each term, and whether each limit was found.

    A limit is the value at which the deviance, with the term held there and all others
    fitted anew, has grown by the 95 % chi-square point. All limits are searched for at once: each search
    asks for the sums of its next step, and one pass over the stored rows adds up those of all
    searches that still go on, so a table takes as many passes as its longest search. Where the tries run
    out, a refit does not settle, or the classes are separated, the limit is NULL and its flag false.
    """
    spark = training.sparkSession
    if model.separated:
        return spark.createDataFrame([(t, None, None, False, False) for t in model.terms], LIMIT_TABLE)
    features = require(training, [t for t in model.terms if t != INTERCEPT])
    columns = [F.lit(1.0).alias("x0"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features, 1)]]
    rows = training.select(*columns, F.col(label).cast("double").alias("y")).dropna().persist(StorageLevel.MEMORY_AND_DISK)
    try:
        searches = [_search(model, place, side, tolerance, max_refits) for place in range(len(model.terms)) for side in (-1.0, 1.0)]
        found = _in_shared_passes(rows, searches, len(model.terms))
    finally:
        rows.unpersist()
    limits = [(t, found[2 * i], found[2 * i + 1]) for i, t in enumerate(model.terms)]
    return spark.createDataFrame([(t, low, high, low is not None, high is not None) for t, low, high in limits], LIMIT_TABLE)


REFIT_STEPS = 50
SETTLED = 1e-12  # a Newton step that would change the deviance by less


@dataclass(frozen=True)
class Sums:
    """Of all rows at given estimates: deviance, gradient of the log likelihood, information matrix."""

    deviance: float
    gradient: np.ndarray
    information: np.ndarray


Search = Generator[np.ndarray, Sums, float | None]


def _in_shared_passes(rows: DataFrame, searches: Sequence[Search], terms: int) -> list[float | None]:
    """Run the searches side by side: every pass answers what each of them has asked for."""
    found: list[float | None] = [None] * len(searches)
    asked: dict[int, np.ndarray] = {}

    def go_on(i: int, answer: Sums | None) -> None:
        try:
            asked[i] = searches[i].send(answer)
        except StopIteration as end:
            asked.pop(i, None)
            found[i] = end.value

    for i in range(len(searches)):
        go_on(i, None)
    while asked:
        for i, sums in _sums(rows, asked, terms).items():
            go_on(i, sums)
    return found


def _sums(rows: DataFrame, asked: Mapping[int, np.ndarray], terms: int) -> dict[int, Sums]:
    """One pass: each row once per search, added up before the shuffle to one row per search."""
    pairs = [(i, j) for i in range(terms) for j in range(i, terms)]
    sums = [f"sum(x{k} * (y - mu)) as g{k}" for k in range(terms)] + [f"sum(mu * (1 - mu) * x{i} * x{j}) as h{i}_{j}" for i, j in pairs]
    structs = (f"struct({i} as search, array({', '.join(f'{float(b)!r}D' for b in beta)}) as beta)" for i, beta in asked.items())
    totals = rows.sparkSession.sql(
        f"""select search, sum(2 * (log1p(exp(-abs(eta))) + greatest(eta, 0D) - y * eta)) as deviance, {", ".join(sums)}
        from (select *, 1 / (1 + exp(-eta)) as mu
              from (select *, {" + ".join(f"beta[{k}] * x{k}" for k in range(terms))} as eta
                    from (select *, inline(array({", ".join(structs)})) from {{rows}})))
        group by search""",
        rows=rows,
    )
    answers = {}
    for row in totals.collect():  # one row per search
        information = np.empty((terms, terms))
        for i, j in pairs:
            information[i, j] = information[j, i] = row[f"h{i}_{j}"]
        answers[row["search"]] = Sums(row["deviance"], np.array([row[f"g{k}"] for k in range(terms)]), information)
    return answers


def _search(model: AwardModel, place: int, side: float, tolerance: float, tries: int) -> Search:
    """One limit: the values to try come from ``_limit``, and each is refitted from where the last one ended."""
    beta, estimate = np.array(model.estimates), model.estimates[place]
    tangent = np.eye(len(beta))[place]
    values = _limit(model.deviance, estimate, side * model.errors[place], tolerance, tries)
    value = next(values)
    while True:
        settled = yield from _refit(beta + (value - beta[place]) * tangent, place)
        if settled is None:
            return None
        beta, sums = settled
        tangent = _tangent(sums.information, place)
        try:
            value = values.send(sums.deviance)
        except StopIteration as end:
            return end.value


def _limit(best: float, estimate: float, step: float, tolerance: float, tries: int) -> Generator[float, float, float | None]:
    """Where sqrt(deviance - best), about linear in the distance, meets the 95 % point.

    Asks for the deviance at a value and goes on from the answer. The distance doubles until the point is passed,
    then the secant narrows the bracket, or its middle where the secant has not halved it. Only a value
    that was tried is returned; None if none fits.
    """
    inside, outside = (0.0, 0.0), None  # (distance in steps, root of the deviance gained)
    distance, halved = WALD_95, True
    for _ in range(tries):
        deviance = yield estimate + distance * step
        gained = sqrt(max(deviance - best, 0.0))
        if abs(gained - WALD_95) < tolerance:
            return estimate + distance * step
        width = outside[0] - inside[0] if outside else inf
        if gained < WALD_95:
            inside = (distance, gained)
        else:
            outside = (distance, gained)
        if outside is None:
            distance *= 2.0
            continue
        (d0, g0), (d1, g1) = inside, outside
        halved = d1 - d0 <= width / 2
        distance = d0 + (d1 - d0) * (WALD_95 - g0) / (g1 - g0) if halved else (d0 + d1) / 2
    return None


def _tangent(information: np.ndarray, place: int) -> np.ndarray:
    """How all terms move with the held one, for the next refit to start near its end."""
    free = np.arange(len(information)) != place
    direction = np.ones(len(information))
    direction[free] = -np.linalg.solve(information[np.ix_(free, free)], information[free, place])
    return direction


def _refit(beta: np.ndarray, place: int) -> Generator[np.ndarray, Sums, tuple[np.ndarray, Sums] | None]:
    """Newton steps on all terms but the one in ``place``, halved where the deviance grows."""
    free = np.arange(len(beta)) != place
    before, last = beta, inf
    for _ in range(REFIT_STEPS):
        sums = yield beta
        if not sums.deviance <= last + SETTLED * max(1.0, abs(last)):
            beta = (beta + before) / 2
            continue
        try:
            move = np.linalg.solve(sums.information[np.ix_(free, free)], sums.gradient[free])
        except np.linalg.LinAlgError:
            return None
        if sums.gradient[free] @ move < SETTLED:
            return beta, sums
        before, last, beta = beta, sums.deviance, beta.copy()
        beta[free] += move
    return None


def fit_table(spark, model: AwardModel) -> DataFrame:
    """Deviances, AIC and counts of the fit."""
    free = model.rows - len(model.terms)
    row = (model.null_deviance, model.rows - 1, model.deviance, free, model.aic, model.rows, model.iterations, model.converged)
    schema = (
        "null_deviance double, null_df long, deviance double, residual_df long, aic double, rows long, iterations int, "
        "converged boolean"
    )
    return spark.createDataFrame([row], schema)


def probability(coefficients: Mapping[str, float]) -> Column:
    """The model as a column expression; a missing feature gives a missing probability."""
    eta = F.lit(float(coefficients[INTERCEPT]))
    for term, estimate in coefficients.items():
        if term != INTERCEPT:
            eta = eta + F.lit(float(estimate)) * F.col(term)
    odds = F.when(eta < -LOGIT_LIMIT, EPSILON).when(eta > LOGIT_LIMIT, 1.0 / EPSILON).otherwise(F.exp(eta))
    return odds / (1.0 + odds)


def score(rows: DataFrame, coefficients: Mapping[str, float]) -> DataFrame:
    """Adds ``pred``, the season's favourite(s) ``pred_mvp`` and the share ``mvp_prob`` of the season.

    One unknown probability makes all shares of its season unknown. ``rows`` is read twice,
    for the season totals and for the result: give it a stored table.
    """
    require(rows, [t for t in coefficients if t != INTERCEPT])
    scored = rows.withColumn("pred", probability(coefficients))
    scored = with_group_totals(scored, ["season"], _top=F.max("pred"), _sum=strict_sum("pred"))
    return scored.withColumns(
        {
            "pred_mvp": (F.col("pred") == F.col("_top")).cast("double"),
            "mvp_prob": ratio(F.col("pred"), F.col("_sum")),
        }
    ).drop("_top", "_sum")


def score_equations(training: DataFrame, model: AwardModel, label: str = "mvp") -> DataFrame:
    """Per term the sum of its values times the residuals of the complete rows: 0 where the likelihood is largest."""
    features = [t for t in model.terms if t != INTERCEPT]
    complete = training.select(*[F.col(c).cast("double").alias(c) for c in [*features, label]]).dropna()
    left = F.col(label) - probability(model.coefficients)
    sums = complete.agg(*[F.sum(left if t == INTERCEPT else F.col(t) * left).alias(t) for t in model.terms])
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").alias("score")) for t in model.terms])
    return sums.select(F.inline(pairs))


def confusion(scored: DataFrame) -> DataFrame:
    """Counts of predicted against actual, rows with either missing not counted."""
    return scored.dropna(subset=["pred_mvp", "mvp"]).groupBy("pred_mvp", "mvp").agg(F.count(F.lit(1)).alias("n"))


# Names of the measures.
METRICS = (
    "accuracy", "kap", "sens", "spec", "ppv", "npv", "mcc", "j_index", "bal_accuracy", "detection_prevalence", "precision",
    "recall", "f_meas",
)


def binary_metrics(counts: DataFrame) -> DataFrame:
    """Thirteen measures of a confusion table in long form; 1 is the event."""

    def cell(predicted: int, actual: int) -> Column:
        hit = (F.col("pred_mvp") == predicted) & (F.col("mvp") == actual)
        return F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).cast("double")

    cells = counts.agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), cell(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    agreed = ratio(tp + tn, n)
    by_chance = ratio((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    precision = ratio(tp, tp + fp)
    value = {
        "accuracy": agreed,
        "kap": ratio(agreed - by_chance, 1 - by_chance),
        "sens": sens,
        "spec": spec,
        "ppv": precision,
        "npv": ratio(tn, tn + fn),
        "mcc": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "j_index": sens + spec - 1,
        "bal_accuracy": (sens + spec) / 2,
        "detection_prevalence": ratio(tp + fp, n),
        "precision": precision,
        "recall": sens,
        "f_meas": ratio(2 * precision * sens, precision + sens),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), value[m].alias("estimate")) for m in METRICS])
    return cells.select(F.inline(rows))


def _missed(scored: DataFrame) -> DataFrame:
    lost = (F.col("mvp") == 1) & (F.col("pred_mvp") == 0)
    wrong = (F.col("mvp") == 0) & (F.col("pred_mvp") == 1)
    outcome = F.when(lost, ACTUAL).otherwise(PREDICTED)
    return scored.filter(lost | wrong).withColumn("outcome", outcome)


def misses(scored: DataFrame) -> DataFrame:
    """Rows predicted wrongly: winners not favoured, and favourites who did not win."""
    return _missed(scored).select("season", "player_display_name", "outcome")


def missed_seasons(scored: DataFrame) -> DataFrame:
    """Seasons with a miss: the actual beside the predicted winner.

    One row per season, unless several share the top probability (or the award): then the
    names of each side, in order, fill one row after the other. No cell holds a list, so
    a season in which very many tie stays spread over tasks.
    """
    sides = _missed(scored).select("season", "outcome", *TIE_KEY)
    numbered = ordinal_ranks(sides, [RankSpec("place", "season")], ["season", "outcome"], TIE_KEY)
    wide = numbered.groupBy("season", "place").pivot("outcome", [ACTUAL, PREDICTED]).agg(F.first("player_display_name"))
    return wide.drop("place")


# Columns of the race table, in display order.
RACE_COLUMNS = (
    "player_display_name", "mvp_prob", "pred_mvp", "tds_rank", "yds_rank", "win_rank", "epa_rank", "total_interceptions",
)


def _race_order() -> list[Column]:
    return [F.col("mvp_prob").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in TIE_KEY]]


def mvp_race(scored: DataFrame, season: int, rows: int = 10) -> DataFrame:
    """The season's leading candidates, most likely first."""
    require(scored, RACE_COLUMNS)
    return scored.filter(F.col("season") == season).orderBy(*_race_order()).limit(rows).select(*RACE_COLUMNS)


def mvp_races(scored: DataFrame, rows: int = 10) -> DataFrame:
    """The leading candidates of every season, with their place.

    Each task keeps its best ``rows`` per season before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("season").orderBy(*_race_order()))
    return scored.withColumn("place", place).filter(F.col("place") <= rows).select("season", "place", *RACE_COLUMNS)
