"""Projection of the star-schema tables onto trace logs, which makes every relation testable on them.

Regions, nations and suppliers are operators at depths one to three of every worker; successive suppliers of a nation and
successive nations of a region are joined by channels, the first and last supplier also to their scope's ports.  Events
are schedule, shutdown and arrangement events of the suppliers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill import schemas

WORKERS = 4


def _as_log(df: DataFrame, ddl: str) -> DataFrame:
    """Fields that a kind doesn't have are null."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.struct(ddl).fields])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def operates(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = _table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).alias("id"), F.array(F.col("r_regionkey") + 1).alias("addr"), F.col("r_name").alias("name"))
    nations = _table(spark, sf_dir, "nation")
    nation = nations.select((100 + F.col("n_nationkey")).alias("id"), F.array(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1).alias("addr"), F.col("n_name").alias("name"))
    supplier = _table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (1000 + F.col("s_suppkey")).alias("id"), F.array(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1, F.col("s_suppkey") + 1).alias("addr"), F.col("s_name").alias("name")
    )
    cast = [d.select(F.col("id").cast("bigint"), F.col("addr").cast("array<bigint>"), "name") for d in (region, nation, supplier)]
    every = cast[0].unionByName(cast[1]).unionByName(cast[2])
    return _as_log(every.withColumns({"worker": F.explode(F.array(*map(F.lit, range(WORKERS)))), "kind": F.lit("Operates"), "seq": F.lit(-2), "time_ns": F.lit(0)}), schemas.TIMELY_LOG)


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = _table(spark, sf_dir, "nation")
    supplier = _table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    own, scope = F.col("s_suppkey") + 1, F.array(F.col("n_regionkey") + 1, F.col("n_nationkey") + 1)
    w = Window.partitionBy("n_nationkey").orderBy("s_suppkey")
    s = supplier.select(scope.alias("addr"), own.alias("op"), F.lead(own).over(w).alias("after"), F.lag(own).over(w).alias("before"), (F.col("n_nationkey") + 1).alias("n"))

    def link(df: DataFrame, ident: Column, source: Column, target: Column) -> DataFrame:
        return df.select(ident.cast("bigint").alias("id"), F.col("addr").cast("array<bigint>"), source.cast("bigint").alias("source_op"), target.cast("bigint").alias("target_op"))

    inner = link(s, 10 * F.col("op") + 1, F.col("op"), F.coalesce("after", F.lit(0)))
    ingress = link(s.where("before is null"), 10 * F.col("n") + 2, F.lit(0), F.col("op"))
    r = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    near = nations.select(F.array(F.col("n_regionkey") + 1).alias("addr"), (F.col("n_nationkey") + 1).alias("n"), F.lead(F.col("n_nationkey") + 1).over(r).alias("after"))
    outer = link(near.where("after is not null"), 10 * F.col("n") + 3, F.col("n"), F.col("after"))
    every = inner.unionByName(ingress).unionByName(outer)
    return _as_log(
        every.withColumns({"source_port": F.lit(0), "target_port": F.lit(0), "worker": F.explode(F.array(*map(F.lit, range(WORKERS)))), "kind": F.lit("Channels"), "seq": F.lit(-1), "time_ns": F.lit(0)}),
        schemas.TIMELY_LOG,
    )


def event_columns(events: DataFrame, suppliers: int) -> DataFrame:
    """seq, time_ns, worker, operator and what the event was; the same for a table and a stream."""
    return events.select(
        F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("time_ns"), F.pmod("user_id", F.lit(WORKERS)).cast("bigint").alias("worker"),
        (1000 + F.pmod(F.call_function("div", F.col("user_id"), F.lit(WORKERS)), F.lit(max(1, suppliers)))).cast("bigint").alias("operator"),
        F.col("event_type").alias("event"), F.col("value"), F.col("ts").cast("timestamp").alias("ts"),
    )


def supplier_count(spark: SparkSession, sf_dir: str) -> int:
    return _table(spark, sf_dir, "supplier").count()


def schedule(events: DataFrame) -> DataFrame:
    """Schedule and Shutdown rows of projected events."""
    rows = events.where(F.col("event").isin("view", "signup", "click", "error")).select(
        "seq", "time_ns", "worker", F.col("operator").alias("id"), F.when(F.col("event") == "error", "Shutdown").otherwise("Schedule").alias("kind"),
        F.when(F.col("event") != "error", F.col("event") != "click").alias("is_start"),
    )
    return _as_log(rows, schemas.TIMELY_LOG)


def arrangement_events(events: DataFrame) -> DataFrame:
    """Batch, Merge and Drop rows of projected events."""
    size = F.floor(F.col("value") * 100).cast("bigint")
    kind = F.when(F.col("event") == "purchase", "Batch").when(F.col("event").isin("signup", "click"), "Merge").when(F.col("event") == "error", "Drop")
    rows = events.withColumn("kind", kind).where("kind is not null").select(
        "seq", "time_ns", "worker", "kind", "operator", F.when(F.col("kind").isin("Batch", "Drop"), size).alias("length"),
        F.when(F.col("kind") == "Merge", F.pmod(F.floor("value"), F.lit(16))).alias("scale"), F.when(F.col("event") == "click", size).alias("complete"),
    )
    return _as_log(rows, schemas.DIFFERENTIAL_LOG)


def order_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operates and Shutdown rows of orders: born at the order date, dead at the last shipment."""
    orders, lines = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    shipped = lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at"))
    worker = F.pmod("o_orderkey", F.lit(WORKERS)).cast("bigint").alias("worker")

    def ns(c: str) -> Column:
        return (F.unix_micros(F.col(c).cast("timestamp")) * 1000).alias("time_ns")

    born = orders.select(F.lit(0).alias("seq"), ns("o_orderdate"), worker, F.lit("Operates").alias("kind"), F.col("o_orderkey").alias("id"))
    died = orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit(1).alias("seq"), ns("at"), worker, F.lit("Shutdown").alias("kind"), F.col("o_orderkey").alias("id"))
    return _as_log(born.unionByName(died), schemas.TIMELY_LOG)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One progress row per order, with its lines as message updates."""
    lines = _table(spark, sf_dir, "lineitem")
    update = F.struct(
        (1000 + F.col("l_suppkey")).cast("bigint").alias("node"), (F.col("l_linenumber") - 1).cast("bigint").alias("port"), F.col("l_linenumber").cast("string").alias("timestamp"),
        F.lit("u64").alias("timestamp_type"), F.floor("l_quantity").cast("bigint").alias("diff"),
    )
    rows = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(update)).alias("messages"))
    worker = F.pmod("l_orderkey", F.lit(WORKERS))
    return _as_log(
        rows.select(
            F.col("l_orderkey").alias("seq"), F.col("l_orderkey").alias("time_ns"), worker.alias("worker"), (F.pmod("l_orderkey", F.lit(2)) == 0).alias("is_send"), worker.alias("source_worker"),
            F.pmod("l_orderkey", F.lit(145)).alias("channel"), F.col("l_orderkey").alias("seq_no"), F.array(F.lit(1)).alias("addr"), "messages",
        ),
        schemas.PROGRESS_LOG,
    )


def trace(spark: SparkSession, sf_dir: str):
    """All logs of the projection."""
    from tracemill.plans.relations import Trace

    events = event_columns(_table(spark, sf_dir, "events"), supplier_count(spark, sf_dir))
    timely = operates(spark, sf_dir).unionByName(channels(spark, sf_dir)).unionByName(schedule(events))
    return Trace(timely, arrangement_events(events), progress(spark, sf_dir))


def dense_schedule(events: DataFrame) -> DataFrame:
    """What schedule() leaves out: nations scheduled by purchases, regions shut down by errors, and the engine log's other
    intervals, by the event's number."""
    own = F.col("operator") - 1000
    nations = events.where("event = 'purchase'").select("seq", "time_ns", "worker", (100 + own % 25).alias("id"), F.lit("Schedule").alias("kind"), (F.col("seq") % 2 == 0).alias("is_start"))
    regions = events.where("event = 'error'").select("seq", "time_ns", "worker", (1 + own % 5).alias("id"), F.lit("Shutdown").alias("kind"))
    kinds = F.array(*map(F.lit, ("Application", "GuardedMessage", "GuardedProgress", "Input", "Park")))
    kind = F.get(kinds, (F.col("seq") % 6 - 1).cast("int"))
    others = events.where("event <> 'error' and seq % 6 > 0").select(
        "seq", "time_ns", "worker", F.when(F.col("seq") % 6 == 1, own % 10).alias("id"), kind.alias("kind"), F.col("event").isin("view", "signup").alias("is_start")
    )
    return _as_log(nations, schemas.TIMELY_LOG).unionByName(_as_log(regions, schemas.TIMELY_LOG)).unionByName(_as_log(others, schemas.TIMELY_LOG))


def shortfalls(events: DataFrame) -> DataFrame:
    """Merges that every third view finds short."""
    rows = events.where("event = 'view' and seq % 3 = 0")
    return _as_log(rows.select("seq", "time_ns", "worker", F.lit("MergeShortfall").alias("kind"), "operator", F.floor("value").alias("shortfall")), schemas.DIFFERENTIAL_LOG)


def dense_trace(spark: SparkSession, sf_dir: str):
    """trace() with all kinds of events, several ports, scopes that run and end, and a fifth of the nations without an
    operator of their own."""
    from tracemill.plans.relations import Trace

    events = event_columns(_table(spark, sf_dir, "events"), supplier_count(spark, sf_dir))
    there = operates(spark, sf_dir).where("not (id between 100 and 999 and id % 5 = 3)")
    ports = channels(spark, sf_dir).withColumns({"source_port": F.col("id") % 3, "target_port": F.col("id") % 2})
    timely = there.unionByName(ports).unionByName(schedule(events)).unionByName(dense_schedule(events))
    return Trace(timely, arrangement_events(events).unionByName(shortfalls(events)), progress(spark, sf_dir))
