"""Choosing columns by position, by list, or by user text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def cols_between(df: DataFrame, first: str, last: str | None = None) -> list[str]:
    """Names from ``first`` to ``last`` in table order, both included; to the end when ``last`` is None."""
    names = df.columns
    require(df, [first] if last is None else [first, last])
    start, stop = names.index(first), len(names) - 1 if last is None else names.index(last)
    return names[start : stop + 1] if start <= stop else names[stop : start + 1][::-1]


def require(df: DataFrame, names: Iterable[str]) -> list[str]:
    names = list(names)
    unknown = [n for n in names if n not in df.columns]
    if unknown:
        raise ValueError(f"unknown column(s): {', '.join(unknown)}")
    return names


def dimension_list(df: DataFrame, dims: str | Iterable[str]) -> list[str]:
    """``"a, b"`` or a list of names to a validated list without repeats."""
    parts = [p.strip() for p in dims.split(",")] if isinstance(dims, str) else list(dims)
    if not parts or "" in parts:
        raise ValueError("a dimension list needs at least one name and no empty entry")
    return list(dict.fromkeys(require(df, parts)))
