"""Equi-joins.  Sides are never hinted: AQE broadcasts a side whose size it has measured and splits skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars as S


def join_map(left: DataFrame, right: DataFrame, on: list[str], **columns: Column) -> DataFrame:
    return left.join(right, on).select(*[c.alias(n) for n, c in columns.items()])


def join_where(left: DataFrame, right: DataFrame, on: list[str], residual: Column, **columns: Column) -> DataFrame:
    """Inner join whose matches also meet a residual condition."""
    return left.join(right, on).where(residual).select(*[c.alias(n) for n, c in columns.items()])


def semi_join(left: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return left.join(keys, on, "left_semi")


def anti_join(left: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return left.join(keys, on, "left_anti")


def outer_default(left: DataFrame, right: DataFrame, on: list[str], **defaults: Column) -> DataFrame:
    """Left outer join with defaults for the columns of rows without a match."""
    return left.join(right, on, "left").withColumns({n: F.coalesce(F.col(n), d) for n, d in defaults.items()})


def prefix_join(df: DataFrame, addr: str, ancestors: DataFrame, ancestor: str) -> DataFrame:
    """Each row with each of the ancestors that is a proper prefix of its address: an equi-join over exploded prefixes."""
    each = df.withColumn(ancestor, F.explode(S.strict_prefixes(F.col(addr))))
    return each.join(ancestors.select(ancestor).distinct(), [ancestor])
