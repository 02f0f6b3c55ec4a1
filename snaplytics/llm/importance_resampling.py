"""Importance resampling towards a target text, on hashed n-grams.

Features are all runs of one to three words, hashed by CRC-32 into a fixed number of buckets.
A bucket's gain is the scaled logarithm of how much likelier it is in the target than in the
corpus; a document's weight is the sum of the gains of its features. Adding Gumbel noise from a
hash of the id and taking the highest scores draws without replacement in proportion to the weights.

No feature becomes a Python object. Words of a block of texts lie one after the other with one
blank behind each, so a feature is a slice of the block. Slices of equal length are
gathered into a matrix of bytes, reduced to the distinct ones, and the CRCs of all of
them are carried on column by column; the buckets are scattered back to the features.

The corpus is read twice, once for the bucket totals and once for the weights, as the buckets of
all features would take more room than the texts. Totals are added up per task first: what reaches the driver is
one number per bucket. Ranks come from ranges of (score, id), each numbered by itself and
shifted by the rows of the ranges before, so no task sorts the whole corpus.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.llm.common import stored, text_or_empty

BUCKETS = 10_000
LONGEST_RUN = 3
MIN_WORDS = 20
DRAWN_PERCENT = 5
SEED = 42
BLOCK_BYTES = 2_000_000  # texts taken together; a longer one is a block of its own
WORDS_AT_ONCE = 300_000  # bounds the arrays per feature, whatever a block holds
LONG_FEATURE = 512  # from here on a feature is hashed by zlib, which gives the same number


def _word_bytes() -> np.ndarray:
    """What each byte counts as: 0 outside words, capital letters as small ones, other word bytes themselves."""
    table = np.zeros(256, np.uint8)
    for first, last in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
        table[first : last + 1] = np.arange(first, last + 1)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte, from the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


WORD_BYTES = _word_bytes()
CRC_TABLE = _crc_table()


def crc_of_rows(matrix: np.ndarray) -> np.ndarray:
    """CRC-32 of every row of a two-dimensional array of bytes, all rows at once, column by column."""
    crc = np.full(len(matrix), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(matrix.T):
        crc = CRC_TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc ^ np.uint32(0xFFFFFFFF)


def hashed_slices(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``flat``, hashed once per distinct content, one matrix per length."""
    crcs = np.empty(len(starts), np.uint32)
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for same in np.split(order, cuts) if len(order) else ():
        length = int(lengths[same[0]])
        if length >= LONG_FEATURE:
            crcs[same] = [zlib.crc32(flat[a : a + length]) for a in starts[same]]
            continue
        matrix = flat[starts[same][:, None] + np.arange(length)]
        rows = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(same), [None, pa.py_buffer(matrix)])
        coded = rows.dictionary_encode()
        distinct = np.frombuffer(coded.dictionary.buffers()[1], np.uint8, len(coded.dictionary) * length)
        crcs[same] = crc_of_rows(distinct.reshape(-1, length))[coded.indices.to_numpy()]
    return crcs


def feature_buckets(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of (text, bucket) for all features of some texts, with each text's number of words in front."""
    raw = WORD_BYTES[np.frombuffer(b"\0".join([*texts, b""]), np.uint8)]
    edges = np.diff((raw != 0).view(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # the last byte is no word byte
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    text_ends = np.cumsum(sizes + 1)
    last_word = np.searchsorted(starts, text_ends)  # of each text, exclusive
    yield np.diff(last_word, prepend=0), np.empty(0, np.int64), np.empty(0, np.int64)
    keep = raw != 0
    keep[ends] = True
    flat = raw[keep]
    flat[flat == 0] = 0x20
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1  # places of the words in flat
    of_text = np.repeat(np.arange(len(texts)), np.diff(last_word, prepend=0))
    for a in range(0, len(at), WORDS_AT_ONCE):
        words = np.arange(a, min(a + WORDS_AT_ONCE, len(at)))
        run_ends = words[:, None] + np.arange(LONGEST_RUN)
        whole = run_ends < last_word[of_text[words]][:, None]
        run_ends = run_ends[whole]
        first = np.repeat(words, whole.sum(axis=1))
        run_lengths = at[run_ends] + lengths[run_ends] - at[first]
        yield np.empty(0, np.int64), of_text[first], hashed_slices(flat, at[first], run_lengths).astype(np.int64) % BUCKETS


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """Runs of rows of bounded bytes: first row, last row (exclusive), texts."""
    texts = batch.column(column).cast(pa.binary())
    sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :])
    start = held = 0
    for i, size in enumerate(sizes):
        held += int(size)
        if held >= BLOCK_BYTES or i + 1 == len(sizes):
            yield start, i + 1, texts.slice(start, i + 1 - start).to_pylist()
            start, held = i + 1, 0


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, texts in _blocks(batch, 0):
            for _, _, buckets in feature_buckets(texts):
                counts += np.bincount(buckets, minlength=BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["bucket", "n"])


def bucket_totals(texts: DataFrame) -> np.ndarray:
    """Features per bucket over all rows of ``texts`` (one column, ``text``)."""
    parts = texts.mapInArrow(_totals, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(BUCKETS, np.int64)
    for row in parts.collect():  # at most one row per bucket
        totals[row["bucket"]] = row["n"]
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))), B the number of buckets."""
    s_all, t_all = int(corpus.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    ratios = ((t + 1) * s_all / ((s + 1) * t_all) for s, t in zip(corpus.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for a, b, texts in _blocks(batch, 1):
                for n_words, of_text, buckets in feature_buckets(texts):
                    if len(n_words):
                        words[a:b] = n_words
                    np.add.at(weights[a:b], of_text, gain[buckets])
                    features[a:b] += np.bincount(of_text, minlength=b - a)
            noise = batch.column(2).to_pylist()
            scores = [w - math.ceil(1000 * math.log(-math.log((h + 0.5) / 4294967296))) for w, h in zip(weights.tolist(), noise)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words), pa.array(features), pa.array(weights), pa.array(scores, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score"],
            )

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, and rank where it is drawn.

    ``percent`` of the rows with at least ``min_words`` words are drawn (rounded down), highest scores
    first, ties to the smaller doc_id; rows that tie in both are taken in any order. A null or
    empty text has no feature and weight 0. A null doc_id draws its noise as the text "null" and
    comes last among ties; repeated rows are rows of their own. An empty table gives no
    rows; with an empty target all gains come from the corpus alone. Further columns are ignored.
    """
    gain = gains(bucket_totals(docs.select(text_or_empty().alias("text"))), bucket_totals(target.select(text_or_empty().alias("text"))))
    doc_id = F.col("doc_id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"), 256)
    noise = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    texts = docs.select(doc_id.alias("doc_id"), text_or_empty().alias("text"), noise.alias("noise"))
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    scored = stored(texts.mapInArrow(_weighed(gain), schema), "scores", "none")
    drawn = scored.filter(F.col("n_words") >= min_words).count() * percent // 100
    # Rows that may be drawn come first. The row's number parts equal rows, so that no range is one key.
    eligible = scored.withColumn("out", (F.col("n_words") < min_words).cast("int")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("out"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = eligible.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id()})
    dealt = stored(dealt.drop("out", "row", "n_words"), "ranges", "none")
    first = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("part", F.coalesce(F.sum("n").over(first), F.lit(0)).alias("before"))
    number = F.col("place") - F.shiftleft(F.col("part").cast("long"), 33) + F.col("before") + 1
    rank = F.when(number <= drawn, number).alias("rank")
    return dealt.join(before, "part").select("doc_id", "n_features", "weight", "score", rank)
