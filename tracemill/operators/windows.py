"""Ranking and event collapsing."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.functions.scalars import EVENT_MARGIN_NS
from tracemill.operators.recursion import checkpoint_dir

#: Successive places of one worker that are looked at together for where runs of like events begin.
STRETCH = 1 << 20


def top_rank(df: DataFrame, by: str, n: int = 10, name: str = "rank") -> DataFrame:
    """Rows whose rank by a descending column is at most n; ties share a rank, so more than n rows may stay.  Nulls rank
    last.

    A distributed top-n finds the n best values, ties among them; a value's rank is one more than the rows above it, all of
    which are among the n.  Only these n values meet in a window; the rows get their rank by a join with them.
    """
    best = df.select(F.col(by).alias("_value")).orderBy(F.desc_nulls_last("_value")).limit(n).groupBy("_value").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.orderBy(F.desc_nulls_last("_value")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = best.select("_value", (F.coalesce(F.sum("_n").over(above), F.lit(0)) + 1).cast("int").alias(name))
    return df.join(F.broadcast(ranks), df[by].eqNullSafe(ranks["_value"])).drop("_value")  # n rows at most


def collapse_events(events: DataFrame, margin: int = EVENT_MARGIN_NS, order: str = "seq") -> DataFrame:
    """Successive events of a worker that are alike and overlap within the margin, as one: durations add up.

    A collapsed event ends at its start plus the summed durations, so each step depends on the one before it: a fold in
    arrival order (ties by start, kind and ref_id).  An event unlike the one before it begins anew whatever came before, so
    the fold is of runs of like events, each apart.  Where runs begin is found in stretches of places, whose last events
    alone meet per worker; a run is folded as a stream, in constant memory.
    """
    names = ["worker", "kind", "ref_id", "start_ns", "duration_ns", "collapsed_events"]
    turn = ["_place", "start_ns", "kind", "ref_id", "duration_ns"]
    checkpoint_dir(events.sparkSession)
    events = events.select(*names, F.col(order).alias("_place")).checkpoint()  # read three times
    rows = events.withColumn("_stretch", F.floor(F.col("_place") / STRETCH))
    like = F.struct("kind", "ref_id")
    within = Window.partitionBy("worker", "_stretch").orderBy(*turn)
    rows = rows.withColumns({"_before": F.lag(like).over(within), "_first": F.row_number().over(within) == 1})
    last = events.withColumn("_stretch", F.floor(F.col("_place") / STRETCH)).groupBy("worker", "_stretch").agg(F.max_by(like, F.struct(*turn)).alias("_last"))
    earlier = last.select(F.col("worker").alias("_worker"), F.col("_stretch").alias("_at"), F.lag("_last").over(Window.partitionBy("worker").orderBy("_stretch")).alias("_earlier"))
    rows = rows.join(earlier, (F.col("worker") == F.col("_worker")) & (F.col("_stretch") == F.col("_at")))
    before = F.when(F.col("_first"), F.col("_earlier")).otherwise(F.col("_before"))
    rows = rows.withColumn("_new", F.when(before.isNull() | ~before.eqNullSafe(like), 1).otherwise(0))
    # a run's number: runs begun in earlier stretches, and up to here in this one
    begun = rows.groupBy("worker", "_stretch").agg(F.sum("_new").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("worker").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = begun.select(F.col("worker").alias("_w"), F.col("_stretch").alias("_s"), offset.alias("_offset"))
    runs = rows.join(begun, (F.col("worker") == F.col("_w")) & (F.col("_stretch") == F.col("_s"))).withColumn("_run", F.col("_offset") + F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    taken = runs.select(*names, "_run", *[c for c in turn if c not in names]).repartition("worker", "_run").sortWithinPartitions("worker", "_run", *turn)
    schema = taken.select(*names).schema

    def fold(batches):
        run, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns[:7]), strict=True):
                row, this = list(row[:6]), (row[0], row[6])
                if this == run and max(0, state[3] - margin) <= row[3] + row[4] and state[3] + state[4] + margin >= row[3]:
                    state[4] += row[4]
                    state[5] += row[5]
                else:
                    out += [state] * (state is not None)
                    run, state = this, row
            yield made(out)
        yield made([state] * (state is not None))

    def made(rows):
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return taken.mapInArrow(fold, schema)
