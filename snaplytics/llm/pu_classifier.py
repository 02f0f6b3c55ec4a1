"""Quality classifier by positive-unlabelled learning.

Trusted good documents and unlabelled web text are all it learns from: a model of the features
of a text is fitted by minimising the non-negative unbiased risk

    prior * E_good[loss(+)] + max(0, E_web[loss(-)] - prior * E_good[loss(-)])

with the logistic loss. The second term estimates the risk on bad documents, which nobody has
marked, as that on web text less the good share of it; where it would fall below zero, which
only overfitting does, the step goes up instead of down. Labels that call a document bad are never read.

The class prior comes from the same two kinds of documents. Above any score t web text holds at least
the good share of it, P_web(s > t) >= prior * P_good(s > t), with equality where no bad text scores; so
the prior is the least ratio of the two, at the t where its confidence bound is lowest. A
first model is fitted on one half of the training rows, and the shares are counted over all rows of the other half.

Features are shares of character classes, word shapes and repetition, computed once for every
whole text and stored. Their means and scales and the prior's counts cover all training rows. The steps
of the fit run on a bounded sample (see Fit), drawn by a hash of the row; scoring covers all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snaplytics.llm.common import stored, text_or_empty
from snaplytics.llm.quality_divergence import CLASS_OF, IS_SPACE, class_histogram, duplicate_lines, repeated_words

N_FEATURES = 24


@dataclass(frozen=True)
class Fit:
    """Bounds and settings of the fit.

    ``max_good``, ``max_web``: rows of the samples of good documents and of web text, which is what the driver holds.
    """

    max_good: int = 20_000
    max_web: int = 40_000
    epochs: int = 60
    batch: int = 2_048
    rate: float = 0.02
    decay: float = 1e-4
    seed: int = 7


def features(text: bytes) -> np.ndarray:
    """24 numbers that describe a text whatever its language; all zero for one without a word."""
    out = np.zeros(N_FEATURES, np.float32)
    words = text.split()
    if not words:
        return out
    data = np.frombuffer(text, np.uint8)
    space = IS_SPACE[data]
    inside = np.flatnonzero(~space)
    starts = inside[np.concatenate([[True], np.diff(inside) > 1])]
    ends = inside[np.concatenate([np.diff(inside) > 1, [True]])]
    classes = CLASS_OF[data]
    hist = class_histogram(data)
    out[:10] = hist / hist.sum()
    n = len(words)
    letters = (ends - starts + 1).astype(float)
    upper = np.add.reduceat((classes == 1).astype(np.int32), starts)
    lower = np.add.reduceat((classes == 0).astype(np.int32), starts)
    last = classes[ends]
    lines = text.count(b"\n") + 1
    out[10:] = (
        np.log1p(n),
        letters.mean(),
        letters.std(),
        len(set(words)) / n,
        (last == 7).mean(),
        (data[ends] == ord("!")).mean(),
        ((upper > 1) & (lower == 0)).mean(),
        ((starts == ends) & (last == 7)).mean(),
        duplicate_lines(text) / lines,
        repeated_words(words) / n,
        np.log1p(n / lines),
        (letters <= 3).mean(),
        (last == 5).mean(),
        (letters > 20).mean(),
    )
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([features(t) for t in batch.column(1).to_pylist()], np.float32).reshape(-1)
        lists = pa.ListArray.from_arrays(np.arange(0, len(rows) + 1, N_FEATURES, dtype=np.int32), pa.array(rows))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "x"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def inputs(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate([z, z * z - 1], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.inputs(x) @ self.weights + self.bias, -40, 40)))


def risk_step(a: np.ndarray, c: np.ndarray, w: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """Estimated risk on bad documents, and the direction to go against, of a batch of good rows and one of web rows.

    The direction is the gradient of the whole risk, or, where the estimate is negative, that of its opposite.
    """
    at_good, at_web = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40))), 1 / (1 + np.exp(-np.clip(c @ w, -40, 40)))
    # By the loss of calling a document good.
    bad = -np.log1p(-np.minimum(at_web, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(at_good, 1 - 1e-12)).mean()
    gradient = (c * at_web[:, None]).mean(axis=0) - prior * (a * at_good[:, None]).mean(axis=0)
    if bad < 0:
        return bad, -gradient
    return bad, gradient - prior * (a * (1 - at_good)[:, None]).mean(axis=0)


def fit(
    good: np.ndarray, web: np.ndarray, prior: float, settings: Fit = Fit(), scaling: tuple[np.ndarray, np.ndarray] | None = None
) -> Model:
    """Minimise the non-negative risk by Adam over random batches; the same result in every run.

    ``scaling`` holds means and deviations of the features, by default those of ``web``.
    """
    base = web if len(web) else np.zeros((1, N_FEATURES))
    mean, scale = scaling or (base.mean(axis=0), base.std(axis=0))
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), np.zeros(2 * N_FEATURES), 0.0, prior)
    if not len(good) or not len(web):
        return Model(model.mean, model.scale, model.weights, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), prior)
    p, u = model.inputs(good), model.inputs(web)
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    w = np.zeros(p.shape[1])
    random = np.random.default_rng(settings.seed)
    first, second, step = np.zeros_like(w), np.zeros_like(w), 0
    per_epoch = -(-len(u) // settings.batch)
    total = np.zeros_like(w)
    for epoch in range(settings.epochs):
        order_p, order_u = random.permutation(len(p)), random.permutation(len(u))
        for b in range(per_epoch):
            a = p[order_p[b * len(p) // per_epoch : max(b * len(p) // per_epoch + 1, (b + 1) * len(p) // per_epoch)]]
            c = u[order_u[b * settings.batch : (b + 1) * settings.batch]]
            gradient = risk_step(a, c, w, prior)[1] + settings.decay * w
            step += 1
            first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
            w = w - settings.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if epoch >= settings.epochs // 2:
            total += w
    w = total / (settings.epochs - settings.epochs // 2)
    return Model(model.mean, model.scale, w[:-1], float(w[-1]), prior)


def prior_of(good: np.ndarray, web: np.ndarray) -> float:
    """The class prior from counts of good documents and of web text by rising score."""
    n_good, n_web = good.sum(), web.sum()
    above_good, above_web = (np.cumsum(x[::-1]) / max(1, x.sum()) for x in (good, web))
    some = above_good > 0
    if not some.any() or not n_web:
        return 0.5
    above_good, above_web = above_good[some], above_web[some]
    # Confidence of nine tenths that both shares are as counted, up to this much.
    slack = sum(np.sqrt(np.log(4 / 0.1) / (2 * n)) for n in (n_good, n_web))
    best = np.argmin((above_web + 1.01 * slack) / above_good)
    return float(np.clip(above_web[best] / above_good[best], 0.01, 0.99))


def held_out(column: str = "doc_id") -> Column:
    """Whether labels of a row are kept from the fit; a row without id is."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(True))


def _sample(df: DataFrame, rows: int, seed: int) -> np.ndarray:
    """At most ``rows`` rows, drawn by a hash of the row; nearly as many where there are more."""
    count = df.count()
    share = 1.0 if count <= rows else max(0.0, rows - 4 * np.sqrt(rows)) / count  # hardly ever over the limit
    drawn = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))
    found = df.filter(drawn).select("row", "x").limit(rows).toPandas().sort_values("row")
    return np.array(found["x"].tolist(), float).reshape(-1, N_FEATURES)


def _scaling(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all rows, rounded, as sums in another order differ in the last places."""
    items = [F.get("x", i).cast("double") for i in range(N_FEATURES)]
    found = rows.agg(*(f(x) for f in (F.avg, F.stddev_pop) for x in items)).first()
    values = np.array([float(f"{v or 0:.9g}") for v in found])
    return values[:N_FEATURES], values[N_FEATURES:]


LEVELS = 1_601  # of scores: log-odds from -40 to 40 by twentieths


def _levels(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().astype(float).reshape(-1, N_FEATURES)
            odds = np.clip(model.inputs(x) @ model.weights + model.bias, -40, 40)
            levels = np.rint((odds + 40) * 20).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(levels)], ["good", "level"])

    return run


def estimate_prior(training: DataFrame, settings: Fit, scaling: tuple[np.ndarray, np.ndarray]) -> float:
    """The share of good documents in ``training`` (row, x, good), 0.5 where none is known as good."""
    half = F.pmod(F.xxhash64("row", F.lit(settings.seed + 2)), F.lit(2))
    parts = [training.filter(half == i) for i in (0, 1)]
    if any(part.filter("good").isEmpty() for part in parts):
        parts = [training, training]  # too few to part
    good = _sample(parts[0].filter("good"), settings.max_good, settings.seed + 3)
    if not len(good):
        return 0.5
    model = fit(good, _sample(parts[0], settings.max_web, settings.seed + 4), 0.5, settings, scaling)
    levels = parts[1].select("good", "x").mapInArrow(_levels(model), "good boolean, level int")
    counts = np.zeros((2, LEVELS))
    for r in levels.groupBy("level").agg(F.count(F.lit(1)), F.count_if("good")).collect():  # one row per level
        counts[:, r[0]] = r[2], r[1]
    return prior_of(*counts)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().astype(float).reshape(-1, N_FEATURES)
            scores = model.score(x)
            predicted = pa.array((scores >= 0.5).astype(np.int32))
            columns = [batch.column(0), batch.column(1), pa.array(scores), predicted]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame, settings: Fit = Fit()) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1, higher: better quality), predicted.

    A null text counts as empty; a null doc_id has no label and counts as held out. A document is
    trusted as good if any of its labels says so; null labels and labels other than 1 are not read. Repeated rows are
    scored each, an empty table gives no rows. Without any trusted good document every score is
    0.5. Further columns are ignored: only the text is an input.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))
    known = stored(texts.mapInArrow(_featured, "doc_id long, x array<float>"), "features").withColumn("held_out", held_out())
    trusted = labels.filter("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("good")).distinct()
    training = known.filter(~F.col("held_out")).withColumn("row", F.monotonically_increasing_id())
    training = training.join(trusted, "doc_id", "left").select("row", "x", F.coalesce("good", F.lit(False)).alias("good"))
    training = stored(training, "training")
    scaling = _scaling(training)
    prior = estimate_prior(training, settings, scaling)
    good = _sample(training.filter("good"), settings.max_good, settings.seed)
    web = _sample(training, settings.max_web, settings.seed + 1)
    model = fit(good, web, prior, settings, scaling)
    schema = "doc_id long, held_out boolean, score double, predicted int"
    return known.select("doc_id", "held_out", "x").mapInArrow(_scored(model), schema)
