"""Projections, filters and two-output maps.  All are lazy; two outputs are two plans over one input."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_rows(df: DataFrame, **columns: Column) -> DataFrame:
    """One row in, one row out; the named expressions are the output."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def map_in_place(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def map_timed(df: DataFrame, time: str, **columns: Column) -> DataFrame:
    """map_rows that keeps the logical time."""
    return df.select(time, *[c.alias(n) for n, c in columns.items()])


def filter_map(df: DataFrame, keep: Column, **columns: Column) -> DataFrame:
    return map_rows(df.where(keep), **columns)


def filter_map_timed(df: DataFrame, time: str, keep: Column, **columns: Column) -> DataFrame:
    """filter_map that keeps the logical time, which the condition and the expressions may use."""
    return map_timed(df.where(keep), time, **columns)


def flat_map(df: DataFrame, items: Column, name: str) -> DataFrame:
    """A row for each element of an array expression, after the input's columns."""
    return df.select("*", F.explode(items).alias(name))


def split(df: DataFrame, left: Mapping[str, Column], right: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    return map_rows(df, **left), map_rows(df, **right)


def filter_split(df: DataFrame, keep_left: Column, left: Mapping[str, Column], keep_right: Column, right: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    return filter_map(df, keep_left, **left), filter_map(df, keep_right, **right)


def flat_split(df: DataFrame, left: Column, right: Column, name: str) -> tuple[DataFrame, DataFrame]:
    return flat_map(df, left, name), flat_map(df, right, name)


def keys(df: DataFrame, *key: str) -> DataFrame:
    return df.select(*key)


def negate(df: DataFrame, weight: str = "diff") -> DataFrame:
    """The changelog with every weight's sign turned."""
    return df.withColumn(weight, -F.col(weight))


def inspect(df: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """A tap: metrics are reported under the name when an action runs, the rows pass unchanged."""
    return df.observe(name, *[m.alias(n) for n, m in (metrics or {"rows": F.count(F.lit(1))}).items()])


def delay(df: DataFrame, time: str, to: Column) -> DataFrame:
    """Rows re-timed to a later time; a time never moves back."""
    return df.withColumn(time, F.greatest(F.col(time), to))


def hold(df: DataFrame, time: str, to: Column, release: str = "release_ns") -> DataFrame:
    """Rows with the time at which they are due, which is never before their own; their own time stays."""
    return df.withColumn(release, F.greatest(F.col(time), to))


def due(held: DataFrame, frontier: Column, release: str = "release_ns") -> tuple[DataFrame, DataFrame]:
    """Held rows that a frontier lets go, as it has passed their release, and those that stay held."""
    passed = F.coalesce(F.col(release) < frontier, F.lit(False))
    return held.where(passed), held.where(~passed)
