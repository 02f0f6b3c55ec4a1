"""Rankings with missing values kept last.

``min_rank`` is for league tables: its groups hold one row per team. Player tables have
no such bound, so ``ordinal_ranks``, ``average_rank`` and the per-group totals
(``with_group_totals``) never need a whole group in one task: rows (or distinct values) are dealt by
ranges, and what a group has in earlier ranges is added.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snaplytics.session import cut_lineage

RANK_DIGITS = 9  # sums of doubles vary in the last bits with their order; ties must not


def _ordered(value: Column, descending: bool) -> Column:
    return value.desc_nulls_last() if descending else value.asc_nulls_last()


def min_rank(value: Column | str, partition: Sequence[str], descending: bool, digits: int = RANK_DIGITS) -> Column:
    """Rank where ties share the lowest number; a missing value has no rank.

    Missing values sort last, so they never move another row's rank, and every rank
    over the same ``partition`` shares one shuffle.
    """
    value = F.col(value) if isinstance(value, str) else value
    window = Window.partitionBy(*partition).orderBy(_ordered(F.round(value, digits), descending))
    return F.when(value.isNotNull(), F.rank().over(window))


def average_rank(df: DataFrame, value: str, group: Sequence[str], name: str, descending: bool = True) -> DataFrame:
    """Adds the rank where ties share their mean position; a missing value has no rank.

    Works on the distinct values of a group with their counts: rank = rows ahead + (rows tied + 1) / 2.
    They may be as many as the rows, so they are dealt by ranges of (group, value) and stored; the
    rows ahead are those of earlier values in the range and of the group's earlier ranges.
    Missing groups are groups of their own. ``df`` is read twice.
    """
    part, tied, ahead = (_free(df.columns, c) for c in ("_part", "_tied", "_ahead"))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias(tied))
    order = _ordered(F.col(value), descending)
    dealt = cut_lineage(counts.repartitionByRange(*group, order).withColumn(part, F.spark_partition_id()))
    inside = Window.partitionBy(part, *group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    shifts = _rows_in_earlier_ranges(dealt.groupBy(part, *group).agg(F.sum(tied).alias(tied)), part, group, tied, ahead)
    within = dealt.withColumn(name, F.coalesce(F.sum(tied).over(inside), F.lit(0)) + (F.col(tied) + 1) / 2.0)
    placed = within.alias("w").join(shifts.alias("s"), _same("w", "s", [part, *group]))
    ranks = placed.select(*[F.col(f"w.{c}") for c in [*group, value]], (F.col(f"w.{name}") + F.col(f"s.{ahead}")).alias(name))
    joined = df.alias("d").join(ranks.alias("r"), _same("d", "r", [*group, value]), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in df.columns], F.col(f"r.{name}"))


def _rows_in_earlier_ranges(sizes: DataFrame, part: str, group: Sequence[str], n: str, name: str) -> DataFrame:
    """Adds to one row per range and group how many rows the group has in earlier ranges."""
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn(name, F.coalesce(F.sum(n).over(earlier), F.lit(0)))


def _same(left: str, right: str, columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def with_group_totals(df: DataFrame, group: Sequence[str], **totals: Column) -> DataFrame:
    """Adds aggregates of each group to its rows, combined before any shuffle."""
    per_group = df.groupBy(*group).agg(*[c.alias(n) for n, c in totals.items()])
    return df.join(per_group, list(group), "left").select(*df.columns, *totals)


@dataclass(frozen=True)
class RankSpec:
    name: str
    value: str
    descending: bool = True


def ordinal_ranks(df: DataFrame, specs: Sequence[RankSpec], group: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """Adds 1, 2, 3, … per group for every spec; missing values last, ties by ``ties``.

    The numbers are those of a window over each group, at any size: missing groups are groups
    of their own, values keep their type, NaN counts as largest, and rows that agree in ``ties`` too are
    numbered one by one. No task sorts a whole group: all rows, once per spec, are dealt by ranges of
    (spec, group, value, ties), sorted there and stored with their place. A group's rows of a
    range lie together, so their number is the place less the group's first one there, and the rows of the
    group in earlier ranges are added. No row is shuffled again for a window.
    """
    kept = df.columns
    row, part, spec_no, place, n, shift = (_free(kept, name) for name in ("_row", "_part", "_spec", "_place", "_n", "_shift"))
    # Stored with its numbers, as ranks are joined back to rows by them.
    numbered = cut_lineage(df.withColumn(row, F.monotonically_increasing_id()))
    fields = lambda i: [
        F.lit(i).alias(spec_no),
        # A column for each spec's values, filled for that spec only, so that all keep their types.
        *[(F.col(s.value) if k == i else F.lit(None).cast(df.schema[s.value].dataType)).alias(f"{spec_no}{k}") for k, s in enumerate(specs)],
    ]
    each = F.array(*[F.struct(*fields(i)) for i in range(len(specs))])
    long = numbered.select(row, *group, *[F.col(t).alias(f"{row}{i}") for i, t in enumerate(ties)], F.inline(each))
    values = [_ordered(F.col(f"{spec_no}{k}"), s.descending) for k, s in enumerate(specs)]
    order = [*values, *[F.col(f"{row}{i}").asc_nulls_last() for i in range(len(ties))], F.col(row)]
    by = [spec_no, *group]
    dealt = long.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    dealt = cut_lineage(dealt.select(row, *by, F.spark_partition_id().alias(part), F.monotonically_increasing_id().alias(place)))
    sizes = dealt.groupBy(part, *by).agg(F.count(F.lit(1)).alias(n), F.min(place).alias(place))
    shifts = _rows_in_earlier_ranges(sizes, part, by, n, shift).withColumn(shift, F.col(shift) - F.col(place) + 1)
    placed = dealt.alias("w").join(shifts.alias("s"), _same("w", "s", [part, *by]))
    number = F.col(f"w.{place}") + F.col(f"s.{shift}")
    placed = placed.select(F.col(f"w.{row}").alias(row), F.col(f"w.{spec_no}").alias(spec_no), number.alias(place))
    wide = placed.groupBy(row).agg(*[F.max(F.when(F.col(spec_no) == i, F.col(place))).cast("int").alias(s.name) for i, s in enumerate(specs)])
    return numbered.join(wide, row).select(*kept, *[s.name for s in specs])


def _free(taken: Sequence[str], name: str) -> str:
    while any(c.lower().startswith(name) for c in taken):
        name += "_"
    return name
