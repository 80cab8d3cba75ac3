"""Bag and set operations by column name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def concat(*parts: DataFrame | None) -> DataFrame:
    """Bag union of the parts that there are."""
    return reduce(lambda a, b: a.unionByName(b), [p for p in parts if p is not None])


def union_distinct(*parts: DataFrame) -> DataFrame:
    return concat(*parts).distinct()


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.exceptAll(right.select(*left.columns))


def intersect_by_key(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_semi")
