import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.functions.ranks import (
    RankSpec,
    average_rank,
    min_rank,
    ordinal_ranks,
    with_group_totals,
)
from tests.helpers import rows, settings


def test_min_rank_shares_the_lowest_and_skips_missing(spark):
    data = [("w", "a", 2.0), ("w", "b", 3.0), ("w", "c", 2.0), ("w", "d", None), ("w", "e", 1.0), ("v", "f", None)]
    df = spark.createDataFrame(data, "g string, k string, x double")
    out = df.select("k", min_rank("x", ["g"], True).alias("high"), min_rank("x", ["g"], False).alias("low"))
    assert rows(out) == [("a", 2, 2), ("b", 1, 4), ("c", 2, 2), ("d", None, None), ("e", 4, 1), ("f", None, None)]


def test_min_rank_ignores_noise_in_the_last_digits(spark):
    df = spark.createDataFrame([("a", 0.1 + 0.2), ("b", 0.3), ("c", 0.2)], "k string, x double")
    out = df.select("k", min_rank("x", [F.lit(1)], True).alias("r"))
    assert rows(out) == [("a", 1), ("b", 1), ("c", 3)]


def test_average_rank(spark):
    data = [(1, 12), (1, 12), (1, 14), (1, 10), (1, None), (2, None), (2, 9)]
    df = spark.createDataFrame(data, "season int, wins int")
    out = average_rank(df, "wins", ["season"], "r")
    assert rows(out) == [(1, 10, 4.0), (1, 12, 2.5), (1, 12, 2.5), (1, 14, 1.0), (1, None, None), (2, 9, 1.0), (2, None, None)]


SPECS = (RankSpec("up", "x", descending=False), RankSpec("down", "x"), RankSpec("other", "y"))


def _random_rows(n: int, seed: int):
    rng = random.Random(seed)
    # One season holds most rows, and one value is shared by a third of them.
    out = []
    for i in range(n):
        season = 1 if rng.random() < 0.8 else rng.randint(2, 4)
        x = None if rng.random() < 0.1 else 7.5 if rng.random() < 0.35 else round(rng.gauss(0, 5), 2)
        y = rng.randint(0, 3) if rng.random() < 0.9 else None
        team = None if rng.random() < 0.05 else f"T{rng.randint(0, 9)}"
        out.append((season, team, f"n{rng.randint(0, 50)}", f"id{i:05d}", x, y))
    return out


def _expected(data):
    frame = pd.DataFrame(data, columns=["season", "team", "name", "id", "x", "y"])
    result = {}
    for spec in SPECS:
        ordered = frame.assign(
            v=frame[spec.value].astype(float) * (-1 if spec.descending else 1),
            t=frame["team"].fillna("~"),
        ).sort_values(["season", "v", "t", "name", "id"], na_position="last")
        result[spec.name] = (ordered.groupby("season").cumcount() + 1).sort_index()
    return {i: tuple(int(result[s.name][k]) for s in SPECS) for k, i in enumerate(frame["id"])}


@pytest.mark.parametrize("parts", [1, 16])
def test_ordinal_ranks_agree_with_pandas(spark, parts):
    data = _random_rows(1500, seed=3)
    df = spark.createDataFrame(data, "season int, team string, name string, id string, x double, y int")
    with settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        out = ordinal_ranks(df, SPECS, ["season"], ["team", "name", "id"])
        assert out.columns == [*df.columns, "up", "down", "other"]
        got = {r["id"]: (r["up"], r["down"], r["other"]) for r in out.collect()}
    assert got == _expected(data)


def test_ordinal_ranks_equal_a_window_on_odd_values(spark):
    """Missing groups, NaN, whole numbers beyond double precision, and rows equal in every tie column."""
    nan, big = float("nan"), 2**53
    data = [(g, x, y, t) for g in (None, "a") for x, y, t in ((nan, big, "k"), (1.5, big + 1, "k"), (None, big + 2, "k"), (1.5, None, "k"), (1.5, None, "k"))]
    df = spark.createDataFrame(data, "g string, x double, y long, t string")
    specs = (RankSpec("rx", "x"), RankSpec("rx_up", "x", descending=False), RankSpec("ry", "y"), RankSpec("ry_up", "y", descending=False))
    plain = df
    for s in specs:
        order = F.col(s.value).desc_nulls_last() if s.descending else F.col(s.value).asc_nulls_last()
        plain = plain.withColumn(s.name, F.row_number().over(Window.partitionBy("g").orderBy(order, F.col("t").asc_nulls_last())))
    with settings(spark, {"spark.sql.shuffle.partitions": "9", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        out = ordinal_ranks(df, specs, ["g"], ["t"]).collect()
    # Equal rows share their numbers in any order, so each column is compared by itself.
    for s in specs:
        key = lambda r: str((r["g"], r["x"], r["y"], r[s.name]))  # noqa: B023, E731
        assert sorted(map(key, out)) == sorted(map(key, plain.collect()))


def _windows(df):
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    return [line for line in lines if "Window [" in line], [line for line in lines if "Exchange hash" in line]


def test_no_task_sorts_a_whole_season(spark):
    """Windows run over one row per range and group, or inside a range, and rows are not shuffled for them."""
    df = spark.createDataFrame(_random_rows(100, 5), "season int, team string, name string, id string, x double, y int")
    windows, _ = _windows(ordinal_ranks(df, SPECS, ["season"], ["team", "name", "id"]))
    assert len(windows) == 1 and "sum(_n" in windows[0] and "row_number" not in windows[0]
    windows, _ = _windows(average_rank(df, "x", ["season"], "r"))
    assert len(windows) == 2 and all("_part" in line for line in windows)


@pytest.mark.parametrize("parts", [1, 16])
def test_average_rank_of_many_values_equals_a_window(spark, parts):
    """A continuous value, one season with most rows, ties that a third of the rows share, missing values and groups."""
    data = [(None if i % 50 == 0 else s, x) for i, (s, _, _, _, x, _) in enumerate(_random_rows(3000, seed=8))]
    df = spark.createDataFrame(data, "season int, x double").withColumn("_part", F.lit("kept"))
    for descending in (True, False):
        order = F.col("x").desc_nulls_last() if descending else F.col("x").asc_nulls_last()
        tied = F.count(F.lit(1)).over(Window.partitionBy("season", "x"))
        plain = F.when(F.col("x").isNotNull(), F.rank().over(Window.partitionBy("season").orderBy(order)) + (tied - 1) / 2.0)
        with settings(spark, {"spark.sql.shuffle.partitions": str(parts), "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
            out = average_rank(df, "x", ["season"], "r", descending)
            assert out.columns == ["season", "x", "_part", "r"]
            assert sorted(map(str, out.collect())) == sorted(map(str, df.withColumn("r", plain).collect()))


def test_group_totals(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0), (2, 4.0)], "g int, x double")
    out = with_group_totals(df, ["g"], top=F.max("x"), n=F.count(F.lit(1)))
    assert rows(out) == [(1, 2.0, 3.0, 2), (1, 3.0, 3.0, 2), (2, 4.0, 4.0, 1)]


def test_empty_input(spark):
    df = spark.createDataFrame([], "season int, team string, name string, id string, x double, y int")
    assert ordinal_ranks(df, SPECS, ["season"], ["team", "name", "id"]).collect() == []
    assert np.array(average_rank(df, "y", ["season"], "r").collect()).size == 0
