"""A corpus pipeline: quality rules, exact and near duplicates, mixing to weights, packing.

Each stage takes (spark, docs, folder) and returns a DataFrame; ``run`` writes it as parquet
and gives it to the next one. All but the last return the columns of ``documents``, further columns
of any name included. In every stage a null text counts as empty, rows are told apart by row and
not by doc_id, so null and repeated ids lose nothing, and an empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from snaplytics.llm.common import importable, remove_stored, stored, stored_so_far, table
from snaplytics.llm.exact_mph import drop_exact_duplicates
from snaplytics.llm.online_packing import pack
from snaplytics.llm.quality_divergence import keep_documents
from snaplytics.llm.simhash_variants import drop_near_duplicates
from snaplytics.llm.weighted_mix import mix_documents


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that pass the rules. Texts without ten words, null ones too, go; equal texts of a language fare alike. With a
    null lang, or a language of few words, words are not judged."""
    importable(spark)
    return keep_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of equal texts: the longest, then the smallest doc_id (null last), of repeated rows one. Null,
    empty and blank texts are equal."""
    importable(spark)
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each component of near copies: the smallest doc_id (null last), of repeated rows one. Texts
    without a word are copies of each other."""
    importable(spark)
    return drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every row as often as the mix takes it: never for one without a word. A null source is a source of its own, last in
    order; which of several equal rows stands at a source's boundary is not defined."""
    importable(spark)
    return mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all rows, repeated rows each with its own; a null or empty text is the end id alone."""
    importable(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing to target weights", mix_sources),
    ("packing", pack_sequences),
]

# Divergence from references, XXH64 fingerprints and byte-pair tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The packed pieces of ``documents``, stored; what the stages store on the way is removed."""
    docs = table(spark, folder, "documents")
    before = stored_so_far()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name.replace(" ", "_"))
        remove_stored(spark, but=[*before, stored_so_far()[-1]])
    return docs
