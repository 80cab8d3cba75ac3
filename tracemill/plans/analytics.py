"""Rankings, tables and documents derived from a trace's relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.operators import aggregates, joins, windows
from tracemill.plans.relations import Trace, by_worker_order


def operators_by_total_runtime(t: Trace) -> DataFrame:
    """Operators with their statistics over workers, ports and arrangements; greatest total first, ties by id."""
    shapes = t.operator_shapes.select(F.col("id").alias("operator"), F.size("inputs").alias("inputs"), F.size("outputs").alias("outputs"))
    arranged = t.aggregated_arrangements.select("operator", "max_size", "min_size", "batches")
    out = t.aggregated_summaries.join(by_worker_order(t.name_lookup, "name"), ["operator"], "left").join(by_worker_order(t.addr_lookup, "addr"), ["operator"], "left")
    out = out.join(shapes, ["operator"], "left").join(arranged, ["operator"], "left")
    return out.withColumn("addr", S.format_addr(F.col("addr"))).orderBy(F.desc("total_ns"), "operator")


def operators_by_arrangement_size(t: Trace) -> DataFrame:
    stats = t.aggregated_summaries.select("operator", "total_ns")
    out = t.aggregated_arrangements.join(stats, ["operator"]).join(by_worker_order(t.name_lookup, "name"), ["operator"], "left").join(by_worker_order(t.addr_lookup, "addr"), ["operator"], "left")
    return out.withColumn("addr", S.format_addr(F.col("addr"))).orderBy(F.desc("max_size"), "operator")


def program_overview(t: Trace) -> DataFrame:
    """One row of counts and the mean run time of workers."""
    parts = [("workers", t.workers), ("dataflows", t.dataflows), ("operators", t.operators), ("subgraphs", t.subgraphs), ("channels", t.channel_ids), ("arrangements", t.arrangement_ids)]
    counted = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in parts]
    run = t.total_runtime.agg(S.mean_ns(F.sum(S.saturating_sub(F.col("end_ns"), F.col("start_ns"))), F.count(F.lit(1))).alias("total_runtime_ns"))
    out = run
    for c in counted:
        out = out.crossJoin(c)  # one row each
    return out.select(*[n for n, _ in parts], "total_runtime_ns")


def worker_report(t: Trace, compat: bool = False) -> DataFrame:
    """Per worker: dataflows, operators, arrangements and run time of its own; with compat, graph counts of the whole
    program and the run time divided by the number of workers."""
    run = t.total_runtime.select("worker", S.saturating_sub(F.col("end_ns"), F.col("start_ns")).alias("runtime_ns"))
    arranged = aggregates.count_total(t.arrangement_ids, ["worker"], name="arrangements")
    zero = F.lit(0).cast("bigint")
    if compat:
        whole = program_overview(t).select("workers", "dataflows", "operators", "subgraphs", "channels")
        out = t.workers.crossJoin(whole).join(run, ["worker"], "left")  # one row on one side
        out = out.withColumn("runtime_ns", S.mean_ns(F.coalesce("runtime_ns", zero), F.col("workers"))).drop("workers")
    else:
        own = t.addr_ids.join(t.subgraphs.withColumn("is_subgraph", F.lit(True)), ["addr"], "left").groupBy("worker").agg(
            F.sum(F.when(F.col("is_subgraph") & S.is_top_level(F.col("addr")), 1).otherwise(0)).cast("bigint").alias("dataflows"),
            F.sum(F.when(F.col("is_subgraph").isNull(), 1).otherwise(0)).cast("bigint").alias("operators"),
            F.sum(F.when(F.col("is_subgraph"), 1).otherwise(0)).cast("bigint").alias("subgraphs"),
        )
        links = aggregates.count_total(t.channel_scopes, ["worker"], name="channels")
        out = t.workers.join(own, ["worker"], "left").join(links, ["worker"], "left").join(run, ["worker"], "left").fillna(0, ["dataflows", "operators", "subgraphs", "channels"])
    return joins.outer_default(out, arranged, ["worker"], arrangements=zero).select("worker", "dataflows", "operators", "subgraphs", "channels", "arrangements", "runtime_ns")


def bounds(t: Trace) -> DataFrame:
    """Least and greatest total over workers' summations: one row."""
    return t.summarized.agg(F.min("total_ns").alias("min_total_ns"), F.max("total_ns").alias("max_total_ns"))


def activation_lists(t: Trace) -> DataFrame:
    return aggregates.sort_by(t.activations, ["worker", "operator"], F.struct("start_ns", "duration_ns"), "activations")


def nested_activations(t: Trace) -> DataFrame:
    """Per operator, the activation lists of its workers."""
    return activation_lists(t).groupBy("operator").agg(F.array_sort(F.collect_list(F.struct("worker", "activations"))).alias("workers"))


def spline_lists(t: Trace) -> DataFrame:
    return aggregates.sort_by(t.spline_levels, ["worker", "operator"], F.struct("event_ns", "complete_size", "scale"), "spline_levels")


def _colored(nodes: DataFrame, limits: DataFrame, palette: str) -> DataFrame:
    out = nodes.crossJoin(limits)  # one row of bounds
    rgb = S.palette_color(S.heat_position(F.col("total_ns"), F.col("max_total_ns"), F.col("min_total_ns")), palette)
    out = out.withColumn("_rgb", rgb)
    return out.withColumns({"fill_color": S.hex_color(F.col("_rgb")), "text_color": S.text_color(F.col("_rgb"))}).drop("_rgb", "max_total_ns", "min_total_ns")


def html_nodes(t: Trace, palette: str = "inferno") -> DataFrame:
    """Leaves with their graph worker's statistics, arrangement and activation count, coloured by total run time."""
    g = F.col("worker") == t.graph_worker
    own = t.summarized.where(g).drop("worker")
    counts = aggregates.count_total(t.activations.where(g), ["operator"], name="activations")
    out = t.nodes.withColumnRenamed("id", "operator").join(own, ["operator"]).join(t.arrangements.where(g).drop("worker"), ["operator"], "left")
    out = joins.outer_default(out, counts, ["operator"], activations=F.lit(0).cast("bigint"))
    return _colored(out.withColumn("addr", S.format_addr(F.col("addr"))), bounds(t), palette)


def html_subgraphs(t: Trace, palette: str = "inferno") -> DataFrame:
    """Scopes with their statistics, coloured between each one's own extremes."""
    own = t.summarized.where(F.col("worker") == t.graph_worker).drop("worker")
    out = t.subgraph_nodes.withColumnRenamed("id", "operator").join(own, ["operator"]).withColumn("addr", S.format_addr(F.col("addr")))
    rgb = S.palette_color(S.heat_position(F.col("total_ns"), F.col("max_ns"), F.col("min_ns")), palette)
    return out.withColumn("_rgb", rgb).withColumns({"fill_color": S.hex_color(F.col("_rgb")), "text_color": S.text_color(F.col("_rgb"))}).drop("_rgb")


def html_edges(t: Trace) -> DataFrame:
    return t.edges.select("source_id", "target_id", "channel", S.format_addr(F.col("source_addr")).alias("source_addr"), S.format_addr(F.col("target_addr")).alias("target_addr"), "channel_kind").orderBy("channel")


def palette_sample(spark, palette: str = "inferno", n: int = 10) -> DataFrame:
    return spark.range(n).select((F.col("id") / n).alias("position"), S.hex_color(S.palette_color(F.col("id") / n, palette)).alias("color")).orderBy("position")


def vega_nodes(t: Trace) -> DataFrame:
    """One document per operator: totals, arrangement, activations, kind and the same per worker."""
    lists = activation_lists(t)
    per = t.summarized.join(t.arrangements, ["worker", "operator"], "left").join(lists, ["worker", "operator"], "left").join(spline_lists(t), ["worker", "operator"], "left")
    fields = ["count", "total_ns", "average_ns", "max_ns", "min_ns", "activations", "max_size", "min_size", "batches", "spline_levels"]
    per_worker = per.groupBy("operator").agg(
        F.array_sort(F.collect_list(F.struct("worker", F.struct(*fields).alias("stats")))).alias("per_worker"), F.array_sort(F.flatten(F.collect_list("activations"))).alias("activation_durations")
    )
    kind = F.when(F.col("is_subgraph"), "Subgraph").otherwise("Node")
    out = t.aggregated_summaries.join(by_worker_order(t.name_lookup, "name"), ["operator"]).join(by_worker_order(t.addr_lookup, "addr"), ["operator"])
    out = out.join(t.aggregated_arrangements, ["operator"], "left").join(per_worker, ["operator"], "left").join(t.subgraphs.withColumn("is_subgraph", F.lit(True)), ["addr"], "left")
    return out.withColumn("node_kind", kind).drop("is_subgraph")


def graph_orphans(t: Trace) -> DataFrame:
    """Addresses that the graph refers to, as parents of operators or ends of channels, without an operator of their own."""
    named = t.operator_addrs.select(S.parent(F.col("addr")).alias("addr")).where(F.size("addr") > 0)
    ends = t.channels.select(F.col("source_addr").alias("addr")).unionByName(t.channels.select(F.col("target_addr").alias("addr")))
    return joins.anti_join(named.unionByName(ends).distinct(), t.operator_addrs, ["addr"])


def pruned_edges(t: Trace) -> DataFrame:
    """Edges neither end of which is a scope."""
    out = joins.anti_join(t.edges, t.subgraphs.withColumnRenamed("addr", "source_addr"), ["source_addr"])
    return joins.anti_join(out, t.subgraphs.withColumnRenamed("addr", "target_addr"), ["target_addr"])


def dashboard(t: Trace) -> DataFrame:
    """Per operator: total run time and arrangement figures, the dashboard's base."""
    return t.aggregated_summaries.select("operator", "total_ns").join(t.aggregated_arrangements, ["operator"], "left")


def top_runtime(t: Trace, n: int = 10, subgraphs: bool = True) -> DataFrame:
    base = dashboard(t).select("operator", "total_ns")
    if not subgraphs:
        scopes = t.raw_operators.join(t.subgraphs, ["addr"], "left_semi").select(F.col("id").alias("operator"))
        base = joins.anti_join(base, scopes, ["operator"])
    return windows.top_rank(base, "total_ns", n)


def top_arrangement(t: Trace, n: int = 10) -> DataFrame:
    return windows.top_rank(dashboard(t).where("max_size > 0").select("operator", "max_size", "min_size"), "max_size", n)


def top_batches(t: Trace, n: int = 10) -> DataFrame:
    """Batches of the operators of greatest run time."""
    ranked = windows.top_rank(dashboard(t).where("batches > 0").select("operator", "total_ns", "batches"), "total_ns", n)
    return ranked.groupBy("operator", "rank").agg(F.sum("batches").alias("batches"))


def activation_scatter(t: Trace, n: int = 10) -> DataFrame:
    return top_runtime(t, n).select("operator", "rank").join(t.activations, ["operator"]).select("operator", "rank", "worker", "start_ns", "duration_ns")


def compaction(t: Trace) -> DataFrame:
    """Completed merges per scale."""
    return t.spline_levels.groupBy("scale").agg(F.count(F.lit(1)).alias("merges"))


def operator_tree(t: Trace) -> DataFrame:
    """Addresses of all operators with name and total run time (null where there is none), in order of address."""
    stats = t.aggregated_summaries.select("operator", "total_ns")
    names = by_worker_order(t.name_lookup, "name")
    return by_worker_order(t.addr_lookup, "addr").join(names, ["operator"], "left").join(stats, ["operator"], "left").orderBy("addr")
