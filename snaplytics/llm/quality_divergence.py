"""Quality rules by distribution divergence.

Each document is described by two histograms: its characters by class, and its words by
"one of the common words of the language, or another word". Both are compared with the same
histograms summed over all documents of the language, by Jensen-Shannon distance (square
root of the divergence in bits, 0 to 1). A document too far from its language is rejected.
A histogram of few characters or words is far from anything, so short documents are not
judged by it (minimum-length guards).

The references come from all documents: classes by one aggregation over per-task sums, the
common words by counting every word of every text. Both are a few hundred numbers per
language when they reach the driver. Words are never compared with another language's: where
a language has fewer than ``min_reference_words`` words in all, and where a document has no
language, they are not judged. The classes of such documents are judged against the nearest
reference, to which every language adds one, also a small one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.llm.common import SPACE_PATTERN, text_or_empty

CLASSES = ("lower", "upper", "digit", "blank", "line_break", "stop", "bracket", "symbol", "control", "other_letter")
SYMBOLS = b"#*$%&|<>"


def _class_table() -> np.ndarray:
    """Character class of each UTF-8 byte; continuation bytes belong to no class (10)."""
    of = np.full(256, 10, np.uint8)
    of[0:32] = of[127] = 8
    of[ord("a") : ord("z") + 1], of[ord("A") : ord("Z") + 1], of[ord("0") : ord("9") + 1] = 0, 1, 2
    of[ord(" ")] = of[ord("\t")] = 3
    of[ord("\n")] = of[ord("\r")] = 4
    of[33:48] = of[58:65] = of[91:97] = of[123:127] = 7
    of[list(b".,;:!?'-")] = 5
    of[list(b"()[]{}\"")] = 6
    of[0xC0:] = 9  # the first byte of every character beyond ASCII
    return of


CLASS_OF = _class_table()
IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
SHORT_WORDS = 100_000  # windows are tuples up to here, numbers beyond, to bound memory


def class_histogram(data: np.ndarray) -> np.ndarray:
    return np.bincount(CLASS_OF[data], minlength=11)[:10]


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that occur twice or more in the text."""
    if len(words) <= width:
        return 0
    if len(words) <= SHORT_WORDS:
        windows = list(zip(*(words[i:] for i in range(width))))
        distinct = set(windows)
        if len(distinct) == len(windows):
            return 0
        once: set = set()
        twice: set = set()
        for w in windows:
            (twice if w in once else once).add(w)
        start = np.fromiter((w in twice for w in windows), bool, len(windows))
    else:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        key = ids
        for i in range(1, width):  # exact: a pair of numbers is numbered anew at each step
            key = np.unique(key[:-1] * len(seen) + ids[i:], return_inverse=True)[1]
        start = np.bincount(key)[key] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + width, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms, 0 to 1; 0 if one of them is empty."""
    if p.sum() == 0 or q.sum() == 0:
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0.0).sum() + np.where(q > 0, q * np.log2(q / m), 0.0).sum()
    return float(np.sqrt(max(0.0, total / 2)))


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules.

    ``class_distance``/``word_distance``: the largest distance from the language that is kept.
    ``min_chars``/``min_words``: below, the histogram is not judged.
    ``common_words``: so many most frequent words make the word histogram.
    ``min_reference_words``: languages with fewer words in all have no reference for words.
    """

    class_distance: float = 0.19
    word_distance: float = 0.37
    min_chars: int = 150
    min_words: int = 45
    common_words: int = 50
    min_reference_words: int = 2_000


@dataclass(frozen=True)
class Reference:
    classes: np.ndarray
    words: dict[bytes, int]  # common word to its cell
    counts: np.ndarray  # cells of the common words, and a last one for all others; one zero if words are not judged


def _language_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            cells = np.append(class_histogram(np.frombuffer(text, np.uint8)), len(text.split()))
            sums[lang] = sums.get(lang, 0) + cells
    rows = [(lang, cell, int(n)) for lang, total in sums.items() for cell, n in enumerate(total)]
    columns = zip(*rows) if rows else ([], [], [])
    types = (pa.string(), pa.int32(), pa.int64())
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types)]
    yield pa.RecordBatch.from_arrays(arrays, ["lang", "cell", "n"])


def references(docs: DataFrame, limits: Limits = Limits()) -> dict[str, Reference]:
    """Class and common-word histograms of every language, over all documents."""
    texts = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = texts.select("lang", F.col("text").cast("binary")).mapInArrow(_language_sums, "lang string, cell int, n long")
    sums: dict[str, np.ndarray] = {}
    for row in summed.groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():  # languages x (classes + 1)
        sums.setdefault(row["lang"], np.zeros(len(CLASSES) + 1))[row["cell"]] = row["n"]
    words = texts.select("lang", F.explode(F.split("text", f"{SPACE_PATTERN}+")).alias("word")).filter("word <> ''")
    by_count = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    top = (
        words.groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("place", F.row_number().over(by_count))  # cut to the top of each task before the shuffle
        .filter(F.col("place") <= limits.common_words)
    )
    common: dict[str, list[tuple[int, str, int]]] = {}
    for row in top.collect():  # languages x common_words
        common.setdefault(row["lang"], []).append((row["place"], row["word"], row["n"]))
    found = {}
    for lang, total in sums.items():
        n_words = total[-1]
        counts, cells = np.zeros(1), {}
        if n_words >= limits.min_reference_words:
            rows = sorted(common.get(lang, []))
            counts = [n for _, _, n in rows]
            cells = {word.encode(): place - 1 for place, word, _ in rows}
            counts = np.array([*counts, n_words - sum(counts)], float)
        found[lang] = Reference(total[:-1], cells, counts)
    return found


def divergence(text: bytes, words: list[bytes], reference: Reference, limits: Limits) -> tuple[float, float]:
    """Distances of a text's classes and words from a reference; 0 below the minimum lengths or without a reference."""
    by_class = by_word = 0.0
    if len(text) >= limits.min_chars:
        classes = class_histogram(np.frombuffer(text, np.uint8))
        if classes.sum() >= limits.min_chars:
            by_class = js_distance(classes, reference.classes)
    if len(words) >= limits.min_words:
        counts = np.zeros(len(reference.counts))
        common = [reference.words[w] for w in words if w in reference.words]
        counts[:-1] = np.bincount(common, minlength=len(counts) - 1) if common else 0
        counts[-1] = len(words) - len(common)
        by_word = js_distance(counts, reference.counts)
    return by_class, by_word


def _verdict(found: dict[str, Reference], limits: Limits):
    """A function from text and language to the values of MEASURES."""

    def judge(text: bytes, lang: str | None) -> tuple:
        data = np.frombuffer(text, np.uint8)
        words = text.split()
        n_words = len(words)
        word_chars = int(((data & 0xC0) != 0x80).sum()) - int(IS_SPACE[data].sum())
        n_repeat = repeated_words(words)
        failed = n_words < 10 or 100 * n_repeat > 20 * n_words
        if lang in found and found[lang].words:
            by_class, by_word = divergence(text, words, found[lang], limits)
        else:
            by_class, by_word = min((divergence(text, [], r, limits)[0] for r in found.values()), default=0.0), 0.0
        kept = not failed and by_class <= limits.class_distance and by_word <= limits.word_distance
        return n_words, word_chars, int(IS_SYMBOL[data].sum()), duplicate_lines(text), n_repeat, failed, kept, by_class, by_word

    return judge


def _judged(judge):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
        for batch in batches:
            rows = [judge(t, lang) for t, lang in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", *MEASURES])

    return run


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance",
    "word_distance",
)


def judge_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row of ``docs``: its ``doc_id``, base measures, distances and ``kept``.

    A null text counts as empty and fails the base rules; with a null ``lang``, or one of few words,
    words are not judged, and classes against the nearest reference; a null ``doc_id`` stays null. Repeated rows are judged each.
    An empty table gives no rows. Columns other than doc_id, text and lang are ignored.
    """
    found = references(docs, limits)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text_or_empty().cast("binary").alias("text"))
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " \
        "base_failed boolean, kept boolean, class_distance double, word_distance double"  # fmt: skip
    return texts.mapInArrow(_judged(_verdict(found, limits)), schema)


def keep_documents(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged.

    The verdict is taken in the pass that passes the rows on, so no join on ``doc_id`` is
    needed and rows with equal or missing ids are judged by their own text.
    """
    judge = _verdict(references(docs, limits), limits)
    kept = F.pandas_udf(lambda text, lang: pd.Series([judge(t, x)[6] for t, x in zip(text, lang)]), "boolean")
    return docs.filter(kept(text_or_empty().cast("binary"), F.col("lang").cast("string")))
