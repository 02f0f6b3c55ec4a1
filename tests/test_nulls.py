import math

import pytest
from pyspark.sql import functions as F

from snaplytics.functions.columns import cols_between, dimension_list, require
from snaplytics.functions.nulls import lenient_sum, nan_to_null, ratio, ratio0, strict_sum, text_or_na
from tests.helpers import rows


@pytest.fixture(scope="module")
def grouped(spark):
    return spark.createDataFrame(
        [("a", 1, 2.0), ("a", 2, None), ("b", None, None), ("c", 3, 0.5)], "k string, i int, x double"
    )


def test_strict_sum_is_unknown_with_one_missing_input(grouped):
    out = rows(grouped.groupBy("k").agg(strict_sum("i").alias("i"), strict_sum("x").alias("x")))
    assert out == [("a", 3, None), ("b", None, None), ("c", 3, 0.5)]


def test_lenient_sum_of_nothing_is_zero(grouped):
    out = rows(grouped.groupBy("k").agg(lenient_sum("i").alias("i"), lenient_sum("x").alias("x")))
    assert out == [("a", 3, 2.0), ("b", 0, 0.0), ("c", 3, 0.5)]


def test_sum_of_a_sum_drops_the_whole_row(grouped):
    out = rows(grouped.groupBy("k").agg(lenient_sum(F.col("i") + F.col("x")).alias("s")))
    assert out == [("a", 3.0), ("b", 0.0), ("c", 3.5)]


def test_both_sums_give_the_same_when_applied_to_partial_sums(spark):
    df = spark.createDataFrame(
        [("a", 1, 1, None), ("a", 1, 2, 3), ("a", 2, 5, 7), ("b", 1, 4, 1), ("b", 2, 6, 2)], "k string, p int, i int, x int"
    )

    def sums(frame, *keys):
        return frame.groupBy(*keys).agg(
            strict_sum("i").alias("i"), strict_sum("x").alias("x"), lenient_sum("x").alias("lx")
        )

    partial = df.groupBy("k", "p").agg(strict_sum("i").alias("i"), strict_sum("x").alias("x"), lenient_sum("x").alias("lx"))
    again = partial.groupBy("k").agg(strict_sum("i").alias("i"), strict_sum("x").alias("x"), lenient_sum("lx").alias("lx"))
    assert rows(again) == rows(sums(df, "k")) == [("a", 8, None, 10), ("b", 10, 3, 3)]


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 2.0), (0.0, 0.0), (1.0, 0.0), (None, 0.0), (None, 2.0)], "n double, d double")
    out = df.select("n", "d", ratio(F.col("n"), F.col("d")).alias("r"), ratio0(F.col("n"), F.col("d")).alias("r0"))
    got = {(r.n, r.d): (r.r, r.r0) for r in out.collect()}
    assert got == {
        (1.0, 2.0): (0.5, 0.5),
        (0.0, 0.0): (None, 0.0),
        (1.0, 0.0): (None, None),
        (None, 0.0): (None, None),
        (None, 2.0): (None, None),
    }


def test_ratio_of_integers_is_not_an_integer(spark):
    df = spark.createDataFrame([(1, 3)], "n int, d long")
    assert math.isclose(df.select(ratio(F.col("n"), F.col("d"))).first()[0], 1 / 3)


def test_nan_becomes_null_and_other_columns_stay(spark):
    df = spark.createDataFrame([(float("nan"), 1, "x"), (2.5, None, None)], "a double, b int, c string")
    out = nan_to_null(df)
    assert out.dtypes == df.dtypes
    assert rows(out) == [(2.5, None, None), (None, 1, "x")]


def test_missing_text(spark):
    df = spark.createDataFrame([(24,), (None,)], "x int")
    assert rows(df.select(text_or_na(F.col("x")))) == [("24",), ("NA",)]


def test_column_ranges_and_lists(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert cols_between(df, "b", "d") == ["b", "c", "d"]
    assert cols_between(df, "c") == ["c", "d"]
    assert cols_between(df, "c", "a") == ["c", "b", "a"]
    assert dimension_list(df, " b, a ,b") == ["b", "a"]
    assert dimension_list(df, ["d"]) == ["d"]
    for wrong in ("b,,a", "", "b, z", []):
        with pytest.raises(ValueError):
            dimension_list(df, wrong)
    with pytest.raises(ValueError, match="z"):
        require(df, ["a", "z"])
