"""Aggregates.  Several weights of one key are several expressions of one groupBy, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars as S


def summation(df: DataFrame, by: list[str], duration: str = "duration_ns") -> DataFrame:
    """max_ns, min_ns, total_ns, average_ns (whole, rounded down) and count per key."""
    d = F.col(duration)
    out = df.groupBy(*by).agg(F.max(d).alias("max_ns"), F.min(d).alias("min_ns"), F.sum(d).alias("total_ns"), F.count(d).alias("count"))
    return out.withColumn("average_ns", S.mean_ns(F.col("total_ns"), F.col("count"))).select(*by, "max_ns", "min_ns", "total_ns", "average_ns", "count")


def count_total(df: DataFrame, by: list[str], weight: Column | None = None, name: str = "count") -> DataFrame:
    return df.groupBy(*by).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias(name))


def across_workers(df: DataFrame, by: str = "operator") -> DataFrame:
    """Summations of workers into one per operator: extremes of extremes, means of totals and averages, sum of counts."""
    n = F.count(F.lit(1))
    return df.groupBy(by).agg(
        F.max("max_ns").alias("max_ns"), F.min("min_ns").alias("min_ns"), S.mean_ns(F.sum("total_ns"), n).alias("total_ns"),
        S.mean_ns(F.sum("average_ns"), n).alias("average_ns"), F.sum("count").alias("count"),
    )


def distinct(df: DataFrame, *columns: str) -> DataFrame:
    return (df.select(*columns) if columns else df).distinct()


def threshold(df: DataFrame, multiplicity: Column, name: str = "n") -> DataFrame:
    """Distinct rows with an expression over their number (column `rows`); rows where it is not above 0 go."""
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn(name, multiplicity).where(F.col(name) > 0).drop("rows")


def consolidate(changes: DataFrame, weight: str = "diff") -> DataFrame:
    """A changelog with one row per distinct record: weights summed, zero sums gone."""
    by = [c for c in changes.columns if c != weight]
    return changes.groupBy(*by).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0)


def snapshot(changes: DataFrame, weight: str = "diff") -> DataFrame:
    """The set of records that a changelog leaves present."""
    return consolidate(changes, weight).where(F.col(weight) > 0).drop(weight)


def compact(held: DataFrame, release: str = "release_ns", weight: str = "diff", dirty: Column | None = None) -> DataFrame:
    """Held changes with one row per release time and record, weights summed, zero sums gone; with `dirty`, a condition on
    the release time, only there."""
    by = [c for c in held.columns if c != weight]
    if dirty is None:
        return consolidate(held, weight)
    clean = held.where(F.coalesce(~dirty, F.lit(True)))
    return clean.unionByName(held.where(dirty).groupBy(*by).agg(F.sum(weight).alias(weight)).where(F.col(weight) != 0).select(*held.columns))


def reduce_collect(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """Distinct values of each key in ascending order."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias(name))


def sort_by(df: DataFrame, by: list[str], value: Column, name: str) -> DataFrame:
    """All values of each key in ascending order, repeats included."""
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias(name))


def hierarchical_reduce(df: DataFrame, by: list[str], aggregate: str, value: str, name: str, levels: tuple[int, ...] = (1 << 12, 1 << 6)) -> DataFrame:
    """An associative aggregate (sum, min or max) in levels of ever fewer buckets of the value's hash, then per key."""
    f = {"sum": F.sum, "min": F.min, "max": F.max}[aggregate]
    part = df.select(*by, F.xxhash64(value).alias("_bucket"), F.col(value).alias(name))
    for buckets in levels:
        part = part.groupBy(*by, F.pmod("_bucket", F.lit(buckets)).alias("_bucket")).agg(f(name).alias(name))
    return part.groupBy(*by).agg(f(name).alias(name))


def hierarchical_sort_by(df: DataFrame, by: list[str], value: Column, name: str, weight: Column | None = None, levels: tuple[int, ...] = (1 << 12, 1 << 6)) -> DataFrame:
    """All values of each key in ascending order, repeats included, by merging ever larger buckets of the values' hash: what
    is merged last are a few sorted lists of (value, times).  A weight is the times of a row, which may be negative; values
    whose times add up to none or less are gone, and keys without values too."""
    counted = df.select(*by, value.alias("_value"), (F.lit(1) if weight is None else weight).cast("bigint").alias("_times"))
    counted = counted.groupBy(*by, "_value").agg(F.sum("_times").alias("_times")).where("_times > 0")
    part = counted.select(*by, F.xxhash64("_value").alias("_bucket"), F.array(F.struct("_value", "_times")).alias(name))
    for buckets in levels:
        part = part.groupBy(*by, F.pmod("_bucket", F.lit(buckets)).alias("_bucket")).agg(F.array_sort(F.flatten(F.collect_list(name))).alias(name))
    whole = part.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list(name))).alias(name))
    return whole.withColumn(name, F.flatten(F.transform(name, lambda x: F.array_repeat(x["_value"], x["_times"].cast("int")))))


def optional_aggregate(df: DataFrame, by: list[str], keep: Column, aggregate: Column, name: str) -> DataFrame:
    """An aggregate over the rows to keep, null for keys that have none: keys never vanish."""
    kept = df.where(keep).groupBy(*by).agg(aggregate.alias(name))
    return df.select(*by).distinct().join(kept, by, "left")
