"""Sums and ratios with explicit missing-value rules.

Two kinds of sum occur side by side in the reports: a strict one, where a single
missing input makes the total unknown, and a lenient one, where missing inputs count
as nothing and an empty total is 0. Both are plain sum/count pairs, so Spark combines
them before the shuffle, and both give the same result when applied again to totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def strict_sum(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.when(F.count(value) == F.count(F.lit(1)), F.sum(value))


def lenient_sum(value: Column | str) -> Column:
    return F.coalesce(F.sum(value), F.lit(0))


def ratio(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``; NULL when the denominator is 0 or either is NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio0(numerator: Column, denominator: Column) -> Column:
    """As :func:`ratio`, but 0/0 is 0. A NULL numerator stays NULL."""
    return F.when((numerator == 0) & (denominator == 0), F.lit(0.0)).otherwise(ratio(numerator, denominator))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN and NULL both mean missing; keep only NULL beyond the sources."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double")) for c in floats}) if floats else df


def text_or_na(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NA"))
