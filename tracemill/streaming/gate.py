"""A lateness gate for streams: rows ahead of the frontier wait, and none is dropped.

Each micro-batch joins what is still held.  The frontier is the earliest time that rows held or new have; rows at most
`ahead` past it go out, in order of time, the others are held for a later batch.  When the source has no more, all that is
held goes out.  Held rows are a table in the shared folder, a version per batch, so a batch that is run again starts from the
same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from tracemill.operators.recursion import checkpoint_dir

#: Fixed value: how far a row may be ahead of the frontier, in nanoseconds.
AHEAD_NS = 5_000_000_000


def admit(waiting: DataFrame, time: str = "time_ns", ahead: int = AHEAD_NS) -> tuple[DataFrame, DataFrame]:
    """Rows that may go on and rows that are held, by the earliest time of all of them."""
    frontier = waiting.agg(F.min(time).alias("_frontier"))  # one row
    both = waiting.crossJoin(F.broadcast(frontier))
    near = F.col(time) <= F.col("_frontier") + F.lit(ahead)
    return both.where(near).drop("_frontier"), both.where(~near).drop("_frontier")


def gated(stream: DataFrame, time: str = "time_ns", ahead: int = AHEAD_NS, label: str = "gated") -> DataFrame:
    """The rows of a stream drained through the gate, with `batch`, the one in which each went out; those released at the end
    of the source have a batch of their own."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/tracemill/{label}-{uuid.uuid4().hex}"
    schema = stream.schema
    ran = [-1]

    def one(batch: DataFrame, number: int) -> None:
        held = spark.read.schema(schema).parquet(f"{base}/held-{number - 1}") if number else batch.limit(0)
        waiting = held.unionByName(batch)
        out, kept = admit(waiting, time, ahead)
        out.orderBy(time).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        kept.write.mode("overwrite").parquet(f"{base}/held-{number}")
        ran[0] = number

    query = stream.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    if ran[0] >= 0:
        spark.read.schema(schema).parquet(f"{base}/held-{ran[0]}").orderBy(time).write.mode("overwrite").parquet(f"{base}/out/batch={ran[0] + 1}")
        return spark.read.schema(schema.add("batch", IntegerType())).parquet(f"{base}/out")
    return spark.createDataFrame([], schema.add("batch", IntegerType()))
