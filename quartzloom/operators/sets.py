"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union_all(*dfs: DataFrame) -> DataFrame:
    """By name; all have the same columns."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def union_mixed(*dfs: DataFrame) -> DataFrame:
    """By name; missing columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def distinct_values(column: str, *dfs: DataFrame) -> DataFrame:
    return union_all(*(d.select(column) for d in dfs)).distinct()


def missing_columns(df: DataFrame, required: list[str]) -> set[str]:
    return set(required) - set(df.columns)


def are_disjoint(a: DataFrame, b: DataFrame, key: str) -> bool:
    return a.select(key).intersect(b.select(key)).isEmpty()


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a without an equal row in b, repeated ones kept."""
    return a.join(b.distinct(), a.columns, "left_anti")
