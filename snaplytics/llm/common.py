"""Helpers shared by the text operators."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snaplytics.session import checkpoint_folder, cut_lineage  # noqa: F401

# A word is a run of anything but ASCII white space. On UTF-8 bytes this is what ``bytes.split()`` gives.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
SPACE_PATTERN = r"[\x20\x09-\x0D]"


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies in the same place for them as for the
    driver; on a cluster it is installed or sent with --py-files as any package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    if root not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), root]))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder in ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_stored: list[str] = []


def stored(df: DataFrame, name: str, compression: str = "zstd", path: str | None = None) -> DataFrame:
    """``df`` written once as parquet in the shared folder and read again: cuts lineage like a
    checkpoint, but keeps the columns apart, so later jobs read only those they need.

    The files stay until ``remove_stored``, as results that are still to be computed read them.
    """
    path = path or shared_folder(df.sparkSession, name)
    _stored.append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for every row, stored so that it stays the same, and the new column's name."""
    name = free_name(docs, "_row")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def stored_so_far() -> list[str]:
    return list(_stored)


def remove_stored(spark: SparkSession, but: Iterable[str] = ()) -> None:
    """Delete what ``stored`` has written, except the paths ``but``; no result built on the rest may be read afterwards."""
    keep = set(but)
    for path in [p for p in _stored if p not in keep]:
        remove(spark, path)
        _stored.remove(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has made in the shared folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
