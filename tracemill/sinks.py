"""Sinks: tables, changelogs, JSON, recaptured logs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.operators import aggregates
from tracemill.operators.recursion import checkpoint_dir


def write_relations(relations: dict[str, DataFrame], path: str, consolidated: bool = True) -> None:
    """One Parquet table per result relation, as a set."""
    for name, df in relations.items():
        (df.distinct() if consolidated else df).write.mode("overwrite").parquet(f"{path}/{name}")


def extract(changes: DataFrame, weight: str = "diff") -> DataFrame:
    """What a changelog leaves: each record of positive weight once."""
    return aggregates.snapshot(changes, weight)


def dump_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def dump_text(df: DataFrame, path: str) -> None:
    """Every row as a line of text."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def save_log(log: DataFrame, path: str, kind: str) -> None:
    """Recapture a log as Parquet, a directory per worker."""
    log.withColumn("by_worker", F.col("worker")).write.mode("overwrite").partitionBy("by_worker").parquet(f"{path}/{kind}")


def drain(stream: DataFrame, mode: str = "append", label: str = "stream", files: str | None = None) -> DataFrame:
    """Run a stream over all that its source has now, and return the resulting table.

    append: rows go to a file sink with exactly-once commits.  complete: each batch replaces the table.
    """
    spark: SparkSession = stream.sparkSession
    base = files or f"{checkpoint_dir(spark)}/tracemill/{label}-{uuid.uuid4().hex}"
    writer = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
