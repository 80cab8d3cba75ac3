"""Streaming queries over the projected events, drained into tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.sinks import drain
from tracemill.sources import projection as P
from tracemill.streaming import gate, stateful

Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{path}*")
    return P.event_columns(stream, P.supplier_count(spark, sf_dir))


def _paired(pair: stateful.Pairing, label: str, action: Column) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = events(spark, sf_dir).withColumn("action", action).where("action is not null").select("worker", "operator", "seq", "time_ns", "action")
        return stateful.paired(rows, pair, label)

    return run


def summation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch sizes per worker and operator, maintained in the state store."""
    size = F.floor(F.col("value") * 100).cast("bigint")
    rows = events(spark, sf_dir).where("event = 'purchase'")
    return drain(rows.groupBy("worker", "operator").agg(F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.sum(size).alias("total"), F.count(F.lit(1)).alias("count")), "complete", "summation")


def total_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(events(spark, sf_dir).groupBy("worker").agg(F.min("time_ns").alias("start_ns"), F.max("time_ns").alias("end_ns")), "complete", "runtime")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per worker and granule."""
    return drain(events(spark, sf_dir).groupBy("worker", S.granulate(F.col("time_ns")).alias("bucket_ns")).agg(F.count(F.lit(1)).alias("events")), "complete", "tumbling")


def sessions(spark: SparkSession, sf_dir: str, gap: str = "10 minutes") -> DataFrame:
    """Runs of a worker's events with no gap between them.  Every session is in the table, the last ones too: batches replace
    the table, and no row is dropped however late it comes."""
    found = events(spark, sf_dir).groupBy("worker", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return drain(found.select("worker", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events"), "complete", "sessions")


def late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per minute, those that come late too: their minute's count changes, and nothing is dropped."""
    found = events(spark, sf_dir).groupBy(F.window("ts", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return drain(found.select(F.col("w.start").alias("start"), "events"), "complete", "late")


def gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through the lateness gate: the same rows as without it, in whichever batch each goes out."""
    return gate.gated(events(spark, sf_dir).select("seq", "time_ns", "worker", "operator")).select("seq", "time_ns", "worker", "operator")


def activations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paired(stateful.slots, "activations", _scheduled())(spark, sf_dir)


def lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lives from a signup to the next error."""
    event = F.col("event")
    lives = _paired(stateful.slots, "lifespans", F.when(event == "signup", "start").when(event == "error", "end"))(spark, sf_dir)
    return lives.select("worker", "operator", F.col("start_ns").alias("birth_ns"), (F.col("start_ns") + F.col("duration_ns")).alias("death_ns"))


def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _paired(stateful.stacks, "timeline", _scheduled())(spark, sf_dir)
    return found.select("worker", F.lit("Activation").alias("kind"), F.col("operator").alias("ref_id"), "start_ns", "duration_ns", F.lit(1).cast("bigint").alias("collapsed_events"))


def _scheduled() -> Column:
    event = F.col("event")
    return F.when(event.isin("view", "signup"), "start").when(event == "click", "stop").when(event == "error", "end")


QUERIES: dict[str, Query] = {
    "stream_activations": activations,
    "stream_lifespans": lifespans,
    "stream_timeline": timeline,
    "stream_summation": summation,
    "stream_total_runtime": total_runtime,
    "stream_tumbling": tumbling,
    "stream_session": sessions,
    "stream_late": late,
    "stream_gated": gated,
}
