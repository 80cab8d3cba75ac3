"""Start/stop pairing over streams: the windows of tracemill.operators.pairing, micro-batch by micro-batch.

Each batch is paired together with the starts that the batches before it left open, which are a stored table, one version a
batch; starts that stay open go on to the next.  So what is kept is no more than what is open, and everything else is the
windows that a finished log is paired with.  A batch that is run again starts from the same open starts and replaces its own
result.  Rows of a key are taken in arrival order (seq) within a batch, and batches follow each other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import pairing
from tracemill.operators.recursion import checkpoint_dir

KEY = ["worker", "operator"]
#: What pairs rows (worker, operator, seq, time_ns, action): intervals, and starts that are still open.
Pairing = Callable[[DataFrame], tuple[DataFrame, DataFrame]]


def slots(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A start takes the slot, a stop or end closes it; the last row of a key is open if it is a start."""
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct("seq", "time_ns", "action"), "seq").alias("r"))
    return pairing.slot(rows, KEY, F.col("action") == "start"), last.select(*KEY, "r.seq", "r.time_ns", "r.action").where("action = 'start'")


def stacks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Starts nest, a stop closes the latest, an end closes all."""
    return pairing.stack(rows, KEY), pairing.unclosed(rows, KEY)


def paired(events: DataFrame, pair: Pairing, label: str) -> DataFrame:
    """Intervals (worker, operator, start_ns, duration_ns) of a stream (worker, operator, seq, time_ns, action), drained."""
    spark, schema = events.sparkSession, events.schema
    base = f"{checkpoint_dir(spark)}/tracemill/{label}-{uuid.uuid4().hex}"
    known = schemas.struct(schemas.ACTIVATIONS)
    ran = []

    def one(batch: DataFrame, number: int) -> None:
        before = spark.read.schema(schema).parquet(f"{base}/open-{number - 1}") if number else batch.limit(0)
        # read by both results
        rows = before.unionByName(batch).checkpoint()
        found, left = pair(rows)
        found.write.mode("overwrite").parquet(f"{base}/out/batch={number}")
        left.select(*schema.names).write.mode("overwrite").parquet(f"{base}/open-{number}")
        ran.append(number)

    query = events.writeStream.option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(one).start()
    query.awaitTermination()
    return spark.read.schema(known).parquet(f"{base}/out").select(*known.names) if ran else spark.createDataFrame([], known)
