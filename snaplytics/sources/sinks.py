"""Writing result tables and join-ready fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_results(
    df: DataFrame, path: str, partition_by: Sequence[str] = ("season",), mode: str = "overwrite", deal: bool = True
) -> None:
    """Parquet by season. Overwriting replaces the seasons in ``df`` and leaves all others as they are.

    The rebalance hint gives even files and splits a large season. Without ``deal`` every task writes the rows it
    has, a file per season: no shuffle, for tables that an aggregation has just dealt out. Keys are texts of digits,
    which zstd makes half as large as the default does.
    """
    writer = (df.hint("rebalance", *partition_by) if deal else df).write.mode(mode).option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "zstd").partitionBy(*partition_by).parquet(path)


def replace_seasons(df: DataFrame, path: str, seasons: Sequence[int]) -> None:
    """Write ``df`` by season in place of ``seasons``; those of them without a row any more go, others stay.

    ``df`` is read twice, and must hold no other season.
    """
    held = {r["season"] for r in df.select("season").distinct().collect()}  # one row per season
    strange = held - set(seasons)
    if strange:
        raise ValueError(f"seasons not asked for: {sorted(strange, key=str)}")
    write_results(df, path)
    spark = df.sparkSession
    for season in sorted(set(seasons) - held):
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/season={season}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def write_text(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, missing values as NA; empty texts are quoted, so they stay texts."""
    df.write.mode(mode).csv(path, header=True, nullValue="NA", emptyValue='""')


def bucket_count(tables: Sequence[DataFrame], fewest: int, rows_per_bucket: int) -> int:
    """Buckets for tables that are to be joined: a task holds one bucket of each, so their number follows the largest table.

    Costs a count of every table.
    """
    rows = max(df.count() for df in tables)
    return max(fewest, -(-rows // rows_per_bucket))


def write_bucketed(
    df: DataFrame,
    table: str,
    keys: Sequence[str],
    buckets: int,
    mode: str = "overwrite",
    path: str | None = None,
) -> None:
    """A table bucketed on its join key: one shuffle here, none in the later play-charting joins.

    Tables join without a shuffle where they have equally many ``buckets`` (see ``bucket_count``).
    """
    writer = df.repartition(buckets, *keys).write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys)
    if path is not None:
        writer = writer.option("path", path)
    writer.format("parquet").saveAsTable(table)
