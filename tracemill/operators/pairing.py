"""Start/stop pairing in arrival order, as windows.

slot: one open start per key, a later start takes its place, any other row closes it.  stack: starts nest, a stop closes
the latest, a row that closes everything ends all that are open.  All windows of one call share the partitioning by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions import scalars as S


def slot(df: DataFrame, by: list[str], opens: Column, time: str = "time_ns", order: str = "seq") -> DataFrame:
    """(by, start_ns, duration_ns): every row that doesn't open, right behind one that does."""
    w = Window.partitionBy(*by).orderBy(order)
    paired = df.select(*by, F.col(time).alias("_t"), opens.alias("_open"), F.lag(time).over(w).alias("_start"), F.lag(opens).over(w).alias("_opened"))
    return paired.where(~F.col("_open") & F.col("_opened")).select(*by, F.col("_start").alias("start_ns"), S.saturating_sub(F.col("_t"), F.col("_start")).alias("duration_ns"))


def _stacked(df: DataFrame, by: list[str], time: str, order: str, action: str) -> DataFrame:
    """Starts with _stop, the row that stops each, and _end, the one that ends its epoch: their time and order, or null."""
    rows = df.select(*by, F.col(time).alias("_t"), F.col(order).alias("_o"), F.col(action).alias("_a"))
    by_key = Window.partitionBy(*by).orderBy("_o")
    ended = F.coalesce(F.sum(F.when(F.col("_a") == "end", 1).otherwise(0)).over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("_epoch", ended)
    within = Window.partitionBy(*by, "_epoch").orderBy("_o")
    running = within.rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("_a") == "start", 1).when(F.col("_a") == "stop", -1).otherwise(0)
    whole = Window.partitionBy(*by, "_epoch")
    rows = rows.withColumns({"_s": F.sum(step).over(running), "_end": F.max(F.when(F.col("_a") == "end", F.struct("_t", "_o"))).over(whole)})
    rows = rows.withColumn("_depth", F.col("_s") - F.least(F.lit(0), F.min("_s").over(running)))
    before = F.coalesce(F.lag("_depth").over(within), F.lit(0))
    rows = rows.withColumn("_level", F.when(F.col("_a") == "start", F.col("_depth")).when(F.col("_a") == "stop", before))
    rows = rows.where("_level > 0")  # neither ends nor stops without a start
    paired = Window.partitionBy(*by, "_epoch", "_level").orderBy("_o")
    rows = rows.withColumn("_stop", F.when(F.lead("_a").over(paired) == "stop", F.struct(F.lead("_t").over(paired).alias("_t"), F.lead("_o").over(paired).alias("_o"))))
    return rows.where(F.col("_a") == "start")

def stack(df: DataFrame, by: list[str], time: str = "time_ns", order: str = "seq", action: str = "action", place: str | None = None) -> DataFrame:
    """(by, start_ns, duration_ns) of rows whose action is start, stop or end (ends all), with `place` the order of the row
    that closes, if asked for.  Stops without an open start and starts that nothing closes give nothing."""
    rows = _stacked(df, by, time, order, action)
    closed = F.coalesce("_stop", "_end")
    found = rows.where(closed.isNotNull())
    return found.select(*by, F.col("_t").alias("start_ns"), S.saturating_sub(closed["_t"], F.col("_t")).alias("duration_ns"), *([closed["_o"].alias(place)] if place else []))


def unclosed(df: DataFrame, by: list[str], time: str = "time_ns", order: str = "seq", action: str = "action") -> DataFrame:
    """Starts that nothing closes, as rows of stack()'s input."""
    rows = _stacked(df, by, time, order, action).where("_stop is null and _end is null")
    return rows.select(*by, F.col("_o").alias(order), F.col("_t").alias(time), F.col("_a").alias(action))
