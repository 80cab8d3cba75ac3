"""Every query of the engine by name, over the star-schema tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.operators import aggregates, joins, select, setops, windows
from tracemill.plans import analytics as A
from tracemill.plans import sql
from tracemill.plans.relations import Trace, reachability
from tracemill.sources import projection as P
from tracemill.streaming import queries as streams

Query = Callable[[SparkSession, str], DataFrame]


def _addr(df: DataFrame, *columns: str) -> DataFrame:
    """Address columns as text."""
    return df.withColumns({c: S.format_addr(F.col(c)) for c in columns or ("addr",)})


def _on_trace(f: Callable[[Trace], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(P.trace(spark, sf_dir))


def _on_dense(f: Callable[[Trace], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(P.dense_trace(spark, sf_dir))


def _on(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])


def _intervals(items: str) -> F.Column:
    return F.array_join(F.transform(items, lambda a: F.concat(a["start_ns"].cast("string"), F.lit("+"), a["duration_ns"].cast("string"))), ",")


def _lifespans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Trace(P.order_lives(spark, sf_dir)).lifespans


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Trace(P.operates(spark, sf_dir), progress=P.progress(spark, sf_dir)).operator_progress()
    parts = [found.select("worker", "operator", F.explode(c).alias("m"), F.lit(c == "output_messages").alias("is_send")) for c in ("input_messages", "output_messages")]
    return setops.concat(*parts).select("worker", "operator", "m.port", "m.channel", "is_send", "m.messages")


def _reachability(lines: DataFrame) -> DataFrame:
    log = lines.select(
        F.when(F.col("l_linenumber") % 2 == 0, "SourceUpdate").otherwise("TargetUpdate").alias("kind"), F.array(F.lit(0)).alias("tracker"), F.col("l_suppkey").alias("node"),
        F.col("l_linenumber").cast("bigint").alias("port"), F.lit("0").alias("timestamp"), F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("diff"),
    )
    return reachability(log).select("kind", "node", "port", "diff")


def _vega(t: Trace) -> DataFrame:
    return _addr(A.vega_nodes(t)).select(
        "operator", "name", "addr", F.col("count").alias("activations"), "total_ns", "average_ns", "max_ns", "min_ns", "max_size", "min_size", "batches", "node_kind",
        F.size("per_worker").cast("bigint").alias("workers"), F.size("activation_durations").cast("bigint").alias("durations"),
        F.array_join(F.transform("per_worker", lambda w: F.concat_ws("/", w["worker"].cast("string"), *[w["stats"][c].cast("string") for c in ("count", "total_ns", "max_size", "batches")])), ";").alias("per_worker"),
        _intervals("activation_durations").alias("activation_durations"),
    )


def _heat(t: Trace) -> DataFrame:
    position = S.heat_position(F.col("total_ns"), F.col("max_total_ns"), F.col("min_total_ns"))
    return t.summarized.crossJoin(A.bounds(t)).select("worker", "operator", F.round(position, 6).alias("position"))  # one row of bounds


def _luminance(part: DataFrame) -> DataFrame:
    div = lambda k: F.pmod(F.call_function("div", F.col("p_partkey"), F.lit(k)), F.lit(256)).cast("int")
    rgb = F.struct(F.pmod("p_partkey", F.lit(256)).cast("int").alias("r"), div(7).alias("g"), div(13).alias("b"))
    return part.select("p_partkey", F.round(S.luminance(rgb), 6).alias("luminance"), S.hex_color(rgb).alias("color"))


def _epochs(orders: DataFrame) -> DataFrame:
    a, b = S.epoch(F.col("o_orderkey"), F.col("o_custkey")), S.epoch(F.col("o_custkey"), F.pmod("o_orderkey", F.lit(7)))
    up, down = S.epoch_join(a, b), S.epoch_meet(a, b)
    return orders.select(
        "o_orderkey", up["system_ns"].alias("join_system"), up["data_ns"].alias("join_data"), down["system_ns"].alias("meet_system"), down["data_ns"].alias("meet_data"),
        S.epoch_less_equal(a, b).alias("less_equal"),
    )


def _granulated(events: DataFrame) -> DataFrame:
    t = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    return events.select("event_id", t.alias("t_ns"), S.granulate(t).alias("bucket_ns"))


def _changes(orders: DataFrame) -> DataFrame:
    return orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("bigint").alias("diff"))


def _steps(first: int, last: str) -> F.Column:
    return F.sequence(F.lit(first), F.col(last).cast("int") + first)


def _counts(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))


def _split(side: int) -> Query:
    return _on(lambda o: select.split(o, {"id": F.col("o_orderkey"), "price": F.col("o_totalprice")}, {"id": F.col("o_orderkey"), "status": F.col("o_orderstatus")})[side], "orders")


def _filter_split(side: int) -> Query:
    def run(orders: DataFrame) -> DataFrame:
        own = {"id": F.col("o_orderkey")}
        return select.filter_split(orders, F.col("o_totalprice") > 1000, own, F.col("o_orderstatus") == "F", own)[side]

    return _on(run, "orders")


def _flat_split(side: int) -> Query:
    return _on(lambda n: select.flat_split(n.select("n_nationkey", "n_regionkey"), _steps(0, "n_regionkey"), _steps(0, "n_nationkey"), "step")[side].select("n_nationkey", "step"), "nation")


def _tree(t: Trace) -> DataFrame:
    return _addr(A.operator_tree(t))


def _nested(t: Trace) -> DataFrame:
    each = F.transform("workers", lambda w: F.concat(w["worker"].cast("string"), F.lit(":"), _intervals_of(w["activations"])))
    return A.nested_activations(t).select("operator", F.array_join(each, ";").alias("workers"))


def _intervals_of(items: F.Column) -> F.Column:
    return F.array_join(F.transform(items, lambda a: F.concat(a["start_ns"].cast("string"), F.lit("+"), a["duration_ns"].cast("string"))), ",")


def _splines(t: Trace) -> DataFrame:
    cell = lambda s: F.concat_ws("/", s["event_ns"].cast("string"), s["complete_size"].cast("string"), s["scale"].cast("string"))
    return A.spline_lists(t).select("worker", "operator", F.array_join(F.transform("spline_levels", cell), ",").alias("spline_levels"))


_ENDS = ("source_addr", "target_addr")

QUERIES: dict[str, Query] = {
    "operators_by_total_runtime": _on_trace(A.operators_by_total_runtime),
    "activations": _on_trace(lambda t: t.activations),
    "lifespans": _lifespans,
    "timeline_events": _on_dense(lambda t: t.engine_timeline),
    "merge_timeline": _on_dense(lambda t: t.merge_timeline),
    "worker_timeline": _on_dense(lambda t: t.timeline_events),
    "operator_summation": _on_trace(lambda t: t.summarized),
    "aggregated_summation": _on_trace(lambda t: t.aggregated_summaries),
    "arrangement_stats": _on_trace(lambda t: t.arrangements),
    "aggregated_arrangements": _on_trace(lambda t: t.aggregated_arrangements),
    "spline_levels": _on_trace(lambda t: t.spline_levels),
    "arrangement_ids": _on_trace(lambda t: t.arrangement_ids),
    "arrangements_by_size": _on_trace(A.operators_by_arrangement_size),
    "workers": _on_trace(lambda t: t.workers),
    "dataflows": _on_trace(lambda t: _addr(t.dataflows)),
    "leaf_operators": _on_trace(lambda t: _addr(t.operators)),
    "subgraphs": _on_trace(lambda t: _addr(t.subgraph_nodes)),
    "subgraph_ids": _on_trace(lambda t: t.subgraph_ids),
    "nodes": _on_trace(lambda t: _addr(t.nodes)),
    "raw_operators": _on_trace(lambda t: _addr(t.raw_operators)),
    "raw_channels": _on_dense(lambda t: _addr(t.raw_channels)),
    "channel_scopes": _on_trace(lambda t: _addr(t.channel_scopes)),
    "dataflow_ids": _on_trace(lambda t: t.dataflow_ids),
    "addr_ids": _on_trace(lambda t: _addr(t.addr_ids)),
    "name_lookup": _on_trace(lambda t: t.name_lookup),
    "addr_lookup": _on_trace(lambda t: _addr(t.addr_lookup)),
    "distinct_channels": _on_trace(lambda t: t.channel_ids),
    "total_runtime": _on_trace(lambda t: t.total_runtime),
    "program_overview": _on_trace(A.program_overview),
    "worker_report": _on_trace(A.worker_report),
    "worker_report_compat": _on_trace(lambda t: A.worker_report(t, compat=True)),
    "runtime_bounds": _on_trace(A.bounds),
    "channels_normal": _on_trace(lambda t: _addr(t.channels_normal, *_ENDS)),
    "channels_crossing": _on_trace(lambda t: _addr(t.channels_crossing, *_ENDS)),
    "rewired_channels": _on_trace(lambda t: _addr(t.channels, *_ENDS)),
    "edges": _on_trace(lambda t: _addr(t.edges, *_ENDS)),
    "html_edges": _on_trace(A.html_edges),
    "graph_orphans": _on_dense(lambda t: _addr(A.graph_orphans(t))),
    "pruned_edges": _on_dense(lambda t: _addr(A.pruned_edges(t), *_ENDS)),
    "operator_shapes": _on_dense(lambda t: _addr(t.operator_shapes, "addr", "inputs", "outputs")),
    "dataflow_stats": _on_dense(lambda t: _addr(t.dataflow_stats())),
    "dataflow_stats_outer": _on_trace(lambda t: _addr(t.dataflow_stats(outer=True))),
    "dense_activations": _on_dense(lambda t: t.activations),
    "dense_lifespans": _on_dense(lambda t: t.lifespans),
    "dense_edges": _on_dense(lambda t: _addr(t.edges, *_ENDS)),
    "topk_runtime": _on_trace(A.top_runtime),
    "topk_arrangement": _on_trace(A.top_arrangement),
    "topk_batches": _on_trace(A.top_batches),
    "activation_scatter": _on_trace(A.activation_scatter),
    "compaction": _on_trace(A.compaction),
    "operator_tree": _on_trace(_tree),
    "nested_activations": _on_trace(_nested),
    "spline_lists": _on_trace(_splines),
    "aggregated_activations": _on_trace(lambda t: t.aggregated_activations().select("operator", _intervals("activations").alias("activations"))),
    "progress_messages": _progress,
    "reachability_fold": _on(_reachability, "lineitem"),
    "collapse_events": _on_trace(lambda t: windows.collapse_events(t.placed_timeline)),
    "vega_nodes": _on_dense(_vega),
    "html_nodes": _on_trace(A.html_nodes),
    "html_nodes_stats": _on_trace(lambda t: A.html_nodes(t).select("operator", "addr", "name", "activations", "total_ns", "max_size", "min_size", "batches")),
    "html_subgraphs": _on_dense(A.html_subgraphs),
    "palette_sample": lambda spark, sf_dir: A.palette_sample(spark),
    "heat_position": _on_trace(_heat),
    "luminance": _on(_luminance, "part"),
    "granulate_5ms": _on(_granulated, "events"),
    "format_addr": _on_trace(
        lambda t: t.operates.select(
            "worker", "id", S.format_addr(F.col("addr")).alias("addr"), S.format_addr(S.parent(F.col("addr"))).alias("parent"), S.last_segment(F.col("addr")).alias("last"),
            S.is_top_level(F.col("addr")).alias("top_level"),
        )
    ),
    "human_duration": _on(lambda o: o.select("o_orderkey", (F.col("o_orderkey") * 1234567891).alias("ns")).withColumn("text", S.human_duration(F.col("ns"))), "orders"),
    "map": _on(lambda d: select.map_rows(d, l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), net=F.col("l_extendedprice") * (1 - F.col("l_discount"))), "lineitem"),
    "filter": _on(lambda d: d.where("s_acctbal > 0"), "supplier"),
    "filter_map": _on(lambda d: select.filter_map(d, F.col("s_acctbal") > 0, id=F.col("s_suppkey"), name=F.upper("s_name")), "supplier"),
    "flat_map": _on(lambda d: select.flat_map(d, _steps(1, "n_regionkey"), "step").select("n_nationkey", "step"), "nation"),
    "split_left": _split(0),
    "split_right": _split(1),
    "filter_split_left": _filter_split(0),
    "filter_split_right": _filter_split(1),
    "flat_split_left": _flat_split(0),
    "flat_split_right": _flat_split(1),
    "keys": _on(lambda o: select.keys(o, "o_custkey"), "orders"),
    "negate": _on(lambda d: select.negate(d.select("l_orderkey", F.col("l_linenumber").alias("diff"))), "lineitem"),
    "join_map": _on(lambda o, c: joins.join_map(o.withColumnRenamed("o_custkey", "c_custkey"), c, ["c_custkey"], o_orderkey=F.col("o_orderkey"), c_name=F.col("c_name")), "orders", "customer"),
    "join_where": _on(
        lambda o, c: joins.join_where(
            o.withColumnRenamed("o_custkey", "c_custkey"), c, ["c_custkey"], F.col("o_totalprice") > F.col("c_acctbal"), o_orderkey=F.col("o_orderkey"), c_custkey=F.col("c_custkey")
        ),
        "orders", "customer",
    ),
    "semi_join": _on(lambda d, o: joins.semi_join(d, o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"]).select("l_orderkey", "l_linenumber"), "lineitem", "orders"),
    "anti_join": _on(lambda c, o: joins.anti_join(c, o.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey"), "customer", "orders"),
    "left_outer_default": _on(lambda c, o: joins.outer_default(c.select("c_custkey"), _counts(o), ["c_custkey"], n=F.lit(0).cast("bigint")), "customer", "orders"),
    "prefix_join": _on_trace(lambda t: _addr(joins.prefix_join(t.operator_addrs, "addr", t.subgraphs.withColumnRenamed("addr", "ancestor"), "ancestor"), "addr", "ancestor")),
    "union_all": _on(lambda s, c: setops.concat(s.select(F.col("s_nationkey").alias("k")), c.select(F.col("c_nationkey").alias("k"))), "supplier", "customer"),
    "union_distinct": _on(lambda s, c: setops.union_distinct(s.select(F.col("s_nationkey").alias("k")), c.select(F.col("c_nationkey").alias("k"))), "supplier", "customer"),
    "bag_difference": _on(lambda s, c: setops.bag_difference(c.select(F.col("c_nationkey").alias("k")), s.select(F.col("s_nationkey").alias("k"))), "supplier", "customer"),
    "intersect_by_key": _on(lambda n, s: setops.intersect_by_key(n.select("n_nationkey", "n_name"), s.select(F.col("s_nationkey").alias("n_nationkey")), ["n_nationkey"]), "nation", "supplier"),
    "count_total": _on(lambda d: aggregates.count_total(d, ["l_suppkey"]), "lineitem"),
    "distinct": _on(lambda d: aggregates.distinct(d, "l_returnflag", "l_linestatus"), "lineitem"),
    "threshold": _on(lambda d: aggregates.threshold(d.select("l_suppkey"), F.call_function("div", F.col("rows"), F.lit(2))), "lineitem"),
    "consolidate": _on(lambda o: aggregates.consolidate(_changes(o)), "orders"),
    "snapshot": _on(lambda o: aggregates.snapshot(_changes(o)), "orders"),
    "reduce_collect": _on(
        lambda d: aggregates.reduce_collect(d, ["l_suppkey"], F.col("l_linenumber"), "n").select("l_suppkey", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("line_numbers")), "lineitem"
    ),
    "sort_by": _on(lambda o: aggregates.sort_by(o, ["o_custkey"], F.col("o_orderkey"), "n").select("o_custkey", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("orders")), "orders"),
    "hierarchical_reduce": _on(lambda d: aggregates.hierarchical_reduce(d, ["l_returnflag"], "sum", "l_linenumber", "total"), "lineitem"),
    "hierarchical_sort_by": _on(
        lambda o: aggregates.hierarchical_sort_by(o, ["o_custkey"], F.pmod("o_orderkey", F.lit(100)), "n").select("o_custkey", F.array_join(F.transform("n", lambda x: x.cast("string")), ",").alias("orders")),
        "orders",
    ),
    "compact_held": _on(
        lambda o: aggregates.compact(
            select.hold(o.select(F.pmod("o_orderkey", F.lit(50)).alias("own_ns"), F.pmod("o_custkey", F.lit(3)).alias("record"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).cast("bigint").alias("diff")), "own_ns", F.col("own_ns") * 3 - 40),
            dirty=F.col("release_ns") < 60,
        ).groupBy("release_ns", "own_ns", "record").agg(F.sum("diff").alias("diff"), F.count(F.lit(1)).alias("rows")),
        "orders",
    ),
    "held_due": _on(lambda o: select.due(select.hold(o.select("o_orderkey", "o_custkey"), "o_custkey", F.pmod("o_orderkey", F.lit(1000))), F.lit(500))[0], "orders"),
    "map_in_place": _on(lambda c: select.map_in_place(c.select("c_custkey", "c_name"), c_name=F.lower("c_name")), "customer"),
    "map_timed": _on(lambda o: select.map_timed(o, "o_orderdate", id=F.col("o_orderkey"), year=F.year("o_orderdate")), "orders"),
    "filter_map_timed": _on(lambda o: select.filter_map_timed(o, "o_orderdate", F.year("o_orderdate") > 1995, id=F.col("o_orderkey")), "orders"),
    "escape_label": _on(lambda c: c.select("c_custkey", S.escape_label(F.concat_ws("\\", "c_name", "c_mktsegment")).alias("label")), "customer"),
    "extend_addr": _on_trace(lambda t: t.raw_operators.select("id", S.format_addr(S.extend(F.col("addr"), S.from_segments(F.col("id"), F.lit(7)))).alias("addr"))),
    "debug_duration": _on(lambda o: o.select("o_orderkey", S.debug_duration(F.col("o_orderkey") * 1500).alias("text")), "orders"),
    "from_seconds": _on(lambda s: s.select("s_suppkey", S.from_seconds(F.floor("s_acctbal").cast("double")).alias("ns")), "supplier"),
    "unsigned_ids": _on(
        lambda o: o.select("o_orderkey", (F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("o_orderkey")).cast("decimal(20,0)").alias("wide"))
        .select("o_orderkey", S.signed_id(F.col("wide")).alias("signed"), (S.unsigned_id(S.signed_id(F.col("wide"))) == F.col("wide")).alias("back")),
        "orders",
    ),
    "optional_aggregate": _on(lambda o: aggregates.optional_aggregate(o, ["o_custkey"], F.col("o_orderstatus") == "F", F.max("o_orderkey"), "latest"), "orders"),
    "epoch_lattice": _on(_epochs, "orders"),
    **streams.QUERIES,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: text for name, text in sql.QUERIES.items() if name in QUERIES}
