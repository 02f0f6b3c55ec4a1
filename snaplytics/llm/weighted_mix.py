"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Sources get shares of all words by weight, none more than ``max_epochs`` times its size; what a
full source leaves goes to the others by weight. A source takes complete epochs first. The
words still missing are a weighted sample without replacement: a document's key is
-ln(u) / quality weight, with u drawn from a hash of its id; documents are taken in the order
of their keys until the prefix sum of their sizes reaches the budget. The document at the
boundary gives the words that are left.

No source is sorted in one task: rows are dealt by ranges of (source, key, id, size, row) and
stored with the number of their range, range sums are added up first, and the prefix sum runs inside
each range. The ranges are those of the shuffle, so their number grows with its partitions, and neither a source nor
an id that many rows share makes one larger than the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.llm.common import WORD_PATTERN, numbered, stored, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
ORDER = ("key", "doc_id", "size", "row")  # no two rows are equal in all of these
MARKUP = r"[#*$%&|<>]"


def uniform(seed: int) -> Column:
    """A number in (0, 1) from the md5 of the document's id: the same in every run and engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)


def sized(docs: DataFrame, row: Column | None = None, seed: int = 1) -> DataFrame:
    """Per row: its number, id, source, size in words, exponential key. Stored, as several jobs read it; holds no text.

    The quality weight is the share of a text's characters that are no markup symbols, plus 0.05, so that
    no document is out of reach.
    """
    text = text_or_empty()
    chars = F.greatest(F.length(text), F.lit(1))
    weight = 1.05 - F.regexp_count(text, F.lit(MARKUP)) / chars
    narrow = docs.select(
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"),
        (-F.log(uniform(seed)) / weight).alias("key"),
    )
    return stored(narrow, "sizes", "none")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: source, source_size, target. One row per source from here on.

    With the limit of a source per unit of weight in ascending order, sources are full as long
    as their limit per weight is below the share per weight that the rest would get.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighed = per_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place).cast("long"))
    by_limit = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full_before = F.coalesce(F.sum(F.col("source_size") * max_epochs).over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    total = F.sum("source_size").over(everything)
    limit = F.col("source_size") * max_epochs
    # In this order the first source that is not full ends the full ones; it sets the share per weight.
    asked = weighed.select("*", (total - full_before).alias("words_left"), weight_left.alias("weight_left"))
    asked = asked.withColumn("full", F.col("words_left") * F.col("weight") > limit * F.col("weight_left"))
    rest = F.when(~F.col("full"), F.struct("words_left", "weight_left"))
    first_open = F.first(rest, ignorenulls=True).over(by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    share = first_open["words_left"] * F.col("weight") / first_open["weight_left"]
    return asked.select("source", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(share).alias("target"))


def dealt(sizes: DataFrame) -> DataFrame:
    """``sizes`` with the number of the range of (source, key) that a row is in, ascending; stored, so that it stays the same."""
    return stored(sizes.repartitionByRange("source", *ORDER).withColumn("range", F.spark_partition_id()), "dealt", "none")


def taken(sizes: DataFrame, per_source: DataFrame) -> DataFrame:
    """``sizes`` with source_size, target and the words that the mix takes of each document."""
    ranged = dealt(sizes)
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    sums = sums.select("source", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("words_before"))
    s, t = sums.alias("s"), per_source.alias("t")
    known = s.join(t, F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("k_source"), F.col("s.range").alias("k_range"), "words_before", "source_size", "target"
    )
    inside = Window.partitionBy("source", "range").orderBy(*ORDER)
    placed = ranged.withColumn("own_before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    same = placed["source"].eqNullSafe(known["k_source"]) & (placed["range"] == known["k_range"])
    budget = F.floor(F.col("target"))
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size")
    left = rest - F.col("words_before") - F.col("own_before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long")
    joined = placed.join(known, same)
    return joined.select(
        "row", "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken")
    )


def mix(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (and ``row``).

    A null text has size 0; a null source is a source of its own, last in order; a null doc_id
    draws its key from the text "null". Rows with equal keys are ordered by id and size;
    among equal rows it does not matter which one gives the last words. An empty table gives
    no rows, and a table without words targets of 0. Further columns are ignored.
    """
    sizes = sized(docs, row)
    return taken(sizes, targets(sizes))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every row as often as the mix takes its text, all columns unchanged.

    Whole texts only: the document at a source's boundary is given once more if the mix takes
    at least half of it. Documents without a word are in no mix.
    """
    rows, name = numbered(docs)
    copies = F.round(F.col("taken") / F.col("size")).cast("int")
    chosen = mix(rows, F.col(name)).filter("size > 0").select(F.col("row").alias(name), copies.alias("n")).filter("n > 0")
    many = chosen.select(name, F.explode(F.sequence(F.lit(1), "n"))).select(name)
    return rows.join(many, name).select(*docs.columns)
