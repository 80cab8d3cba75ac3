"""The analytic relations of a trace: lazy plans over its logs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions import scalars as S
from tracemill.operators import aggregates, joins, pairing, recursion, setops


class Trace:
    """Relations of one trace.  Graph relations come from one worker's log (graph_worker), as all workers build the same
    graph; statistics come from all.  Every relation is a set."""

    def __init__(self, timely: DataFrame, differential: DataFrame | None = None, progress: DataFrame | None = None, graph_worker: int = 0, disable_timeline: bool = False):
        self.spark, self.timely, self.progress, self.graph_worker, self.disable_timeline = timely.sparkSession, timely, progress, graph_worker, disable_timeline
        self.differential = None if differential is None else differential.where("kind <> 'TraceShare'")

    # -- demultiplexed log ---------------------------------------------------------------------------------------------
    @cached_property
    def operates(self) -> DataFrame:
        return self.timely.where("kind = 'Operates'").select("worker", "id", "addr", "name", "time_ns", "seq")

    @cached_property
    def raw_operators(self) -> DataFrame:
        return self.operates.where(F.col("worker") == self.graph_worker).select("id", "addr", "name").distinct()

    @cached_property
    def name_lookup(self) -> DataFrame:
        return self.operates.select("worker", F.col("id").alias("operator"), "name").distinct()

    @cached_property
    def addr_lookup(self) -> DataFrame:
        return self.operates.select("worker", F.col("id").alias("operator"), "addr").distinct()

    @cached_property
    def dataflow_ids(self) -> DataFrame:
        return self.operates.where(S.is_top_level(F.col("addr"))).select("worker", F.col("id").alias("operator")).distinct()

    @cached_property
    def operator_addrs(self) -> DataFrame:
        return self.raw_operators.select("addr").distinct()

    @cached_property
    def addr_ids(self) -> DataFrame:
        return self.operates.select("worker", "addr", F.col("id").alias("operator")).distinct()

    @cached_property
    def raw_channels(self) -> DataFrame:
        rows = self.timely.where("kind = 'Channels'").where(F.col("worker") == self.graph_worker)
        return rows.select("id", "addr", "source_op", "source_port", "target_op", "target_port").distinct()

    @cached_property
    def channel_scopes(self) -> DataFrame:
        return self.timely.where("kind = 'Channels'").select("worker", F.col("id").alias("channel"), "addr").distinct()

    # -- lives, activations, timeline ----------------------------------------------------------------------------------
    @cached_property
    def lifespans(self) -> DataFrame:
        rows = self.timely.where("kind in ('Operates', 'Shutdown')").withColumnRenamed("id", "operator")
        paired = pairing.slot(rows, ["worker", "operator"], F.col("kind") == "Operates")
        return paired.select("worker", "operator", F.col("start_ns").alias("birth_ns"), (F.col("start_ns") + F.col("duration_ns")).alias("death_ns"))

    @cached_property
    def activations(self) -> DataFrame:
        rows = self.timely.where("kind in ('Schedule', 'Shutdown')").withColumnRenamed("id", "operator")
        return pairing.slot(rows, ["worker", "operator"], (F.col("kind") == "Schedule") & F.col("is_start"))

    @cached_property
    def _engine_intervals(self) -> DataFrame:
        kind = (
            F.when(F.col("kind").isin("Schedule", "Shutdown"), "Activation").when(F.col("kind") == "Application", "Application").when(F.col("kind") == "GuardedMessage", "Message")
            .when(F.col("kind") == "GuardedProgress", "Progress").when(F.col("kind") == "Input", "Input").when(F.col("kind") == "Park", "Parked")
        )
        action = F.when(F.col("kind") == "Shutdown", "end").when(F.col("is_start"), "start").otherwise("stop")
        rows = self.timely.withColumn("event", kind).where("event is not null").select(
            "seq", "time_ns", "worker", F.col("event").alias("kind"), F.when(F.col("event").isin("Activation", "Application"), F.col("id")).alias("ref_id"), action.alias("action")
        )
        return pairing.stack(rows, ["worker", "kind", "ref_id"], place="seq").withColumn("collapsed_events", F.lit(1).cast("bigint"))

    @cached_property
    def _merge_intervals(self) -> DataFrame:
        action = (
            F.when(F.col("kind") == "Drop", "end").when((F.col("kind") == "Merge") & F.col("complete").isNull(), "start").otherwise("stop")
        )
        rows = self._arranged.where("kind in ('Merge', 'MergeShortfall', 'Drop')").select("seq", "time_ns", "worker", F.lit("Merge").alias("kind"), F.col("operator").alias("ref_id"), action.alias("action"))
        return pairing.stack(rows, ["worker", "kind", "ref_id"], place="seq").withColumn("collapsed_events", F.lit(1).cast("bigint"))

    @cached_property
    def engine_timeline(self) -> DataFrame:
        """Stacked intervals of the engine log's seven kinds; a shutdown ends its operator's activations."""
        return self._engine_intervals.drop("seq")

    @cached_property
    def merge_timeline(self) -> DataFrame:
        """Stacked merges; a shortfall stops one, a drop ends all of its operator."""
        return self._merge_intervals.drop("seq")

    @cached_property
    def placed_timeline(self) -> DataFrame:
        """All intervals with seq, the arrival of the row that closes each: the order in which they become known."""
        if self.disable_timeline:
            return self.spark.createDataFrame([], schemas.struct(f"{schemas.TIMELINE}, seq BIGINT")).select("worker", "kind", "ref_id", "start_ns", "duration_ns", "seq", "collapsed_events")
        return setops.concat(self._engine_intervals, None if self.differential is None else self._merge_intervals)

    @cached_property
    def timeline_events(self) -> DataFrame:
        return self.placed_timeline.drop("seq")

    # -- statistics ----------------------------------------------------------------------------------------------------
    @cached_property
    def _arranged(self) -> DataFrame:
        return self.spark.createDataFrame([], schemas.struct(schemas.DIFFERENTIAL_LOG)) if self.differential is None else self.differential

    @cached_property
    def summarized(self) -> DataFrame:
        return aggregates.summation(self.activations, ["worker", "operator"])

    @cached_property
    def aggregated_summaries(self) -> DataFrame:
        return aggregates.across_workers(self.summarized)

    @cached_property
    def arrangements(self) -> DataFrame:
        """Sizes are lengths of batches and of completed merges; only batches are counted."""
        size = F.when(F.col("kind") == "Batch", F.col("length")).otherwise(F.col("complete"))
        rows = self._arranged.where("kind = 'Batch' or (kind = 'Merge' and complete is not null)")
        return rows.groupBy("worker", "operator").agg(F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.sum(F.when(F.col("kind") == "Batch", 1).otherwise(0)).cast("bigint").alias("batches"))

    @cached_property
    def aggregated_arrangements(self) -> DataFrame:
        n = F.count(F.lit(1))
        return self.arrangements.groupBy("operator").agg(F.max("max_size").alias("max_size"), F.min("min_size").alias("min_size"), S.mean_ns(F.sum("batches"), n).alias("batches"))

    @cached_property
    def spline_levels(self) -> DataFrame:
        rows = self._arranged.where("kind = 'Merge' and complete is not null")
        return rows.select("worker", "operator", F.col("time_ns").alias("event_ns"), "scale", F.col("complete").alias("complete_size"))

    @cached_property
    def arrangement_ids(self) -> DataFrame:
        return self._arranged.select("worker", "operator").distinct()

    @cached_property
    def workers(self) -> DataFrame:
        return self.timely.select("worker").distinct()

    @cached_property
    def total_runtime(self) -> DataFrame:
        """First and last event of each worker over the engine and arrangement logs."""
        times = setops.concat(self.timely.select("worker", "time_ns"), None if self.differential is None else self.differential.select("worker", "time_ns"))
        return times.groupBy("worker").agg(F.min("time_ns").alias("start_ns"), F.max("time_ns").alias("end_ns"))

    # -- hierarchy -----------------------------------------------------------------------------------------------------
    @cached_property
    def _parents(self) -> DataFrame:
        return self.operator_addrs.select(S.parent(F.col("addr")).alias("addr")).distinct()

    @cached_property
    def leaves(self) -> DataFrame:
        return joins.anti_join(self.operator_addrs, self._parents, ["addr"])

    @cached_property
    def subgraphs(self) -> DataFrame:
        return joins.semi_join(self.operator_addrs, self._parents, ["addr"])

    @cached_property
    def subgraph_ids(self) -> DataFrame:
        return self.addr_ids.join(self.subgraphs, ["addr"]).select("worker", "operator").distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        return joins.semi_join(self.raw_operators, self.leaves, ["addr"]).select("addr", "id", "name")

    @cached_property
    def subgraph_nodes(self) -> DataFrame:
        return joins.semi_join(self.raw_operators, self.subgraphs, ["addr"]).select("addr", "id", "name")

    @cached_property
    def operators(self) -> DataFrame:
        return joins.anti_join(self.operator_addrs, self.subgraphs, ["addr"])

    @cached_property
    def dataflows(self) -> DataFrame:
        return self.subgraphs.where(S.is_top_level(F.col("addr")))

    # -- channels ------------------------------------------------------------------------------------------------------
    @cached_property
    def channels_normal(self) -> DataFrame:
        """Channels between two operators of one scope, neither of which is a scope itself."""
        ends = self.raw_channels.where("source_op <> 0 and target_op <> 0").select(
            F.col("id").alias("channel"), S.push(F.col("addr"), F.col("source_op")).alias("source_addr"), S.push(F.col("addr"), F.col("target_op")).alias("target_addr")
        )
        ends = joins.anti_join(ends, self.subgraphs.withColumnRenamed("addr", "source_addr"), ["source_addr"])
        return joins.anti_join(ends, self.subgraphs.withColumnRenamed("addr", "target_addr"), ["target_addr"])

    @cached_property
    def channels_crossing(self) -> DataFrame:
        """Channels stitched through the ports of scopes: paths of two segments or more, named by their first.

        Going into a scope prolongs the path at its end and coming out of one at its start, so all steps in come first
        and all steps out after them; both take as many rounds as scopes nest, each over that round's paths alone.
        """
        recursion.checkpoint_dir(self.spark)
        base = self.raw_channels.select(
            F.col("id").alias("channel"), S.push(F.col("addr"), F.col("source_op")).alias("sa"), F.col("source_port").alias("sp"), S.push(F.col("addr"), F.col("target_op")).alias("ta"),
            F.col("target_port").alias("tp"), F.lit(1).alias("segments"),
        ).checkpoint()
        inward = base.where(F.element_at("sa", -1) == 0).select(F.col("sa").alias("at"), F.col("sp").alias("port"), F.col("ta").alias("to"), F.col("tp").alias("to_port"))
        outward = base.where(F.element_at("ta", -1) == 0).select(F.col("ta").alias("at"), F.col("tp").alias("port"), F.col("sa").alias("of"), F.col("sp").alias("of_port"), F.col("channel").alias("first"))

        def deeper(paths: DataFrame) -> DataFrame:
            met = paths.join(inward, (S.push(F.col("ta"), F.lit(0)) == F.col("at")) & (F.col("tp") == F.col("port")))
            return met.select("channel", "sa", "sp", F.col("to").alias("ta"), F.col("to_port").alias("tp"), (F.col("segments") + 1).alias("segments"))

        def outer(paths: DataFrame) -> DataFrame:
            met = paths.join(outward, (S.push(F.col("sa"), F.lit(0)) == F.col("at")) & (F.col("sp") == F.col("port")))
            return met.select(F.col("first").alias("channel"), F.col("of").alias("sa"), F.col("of_port").alias("sp"), "ta", "tp", (F.col("segments") + 1).alias("segments"))

        both = recursion.unfold(recursion.unfold(base, deeper), outer)
        found = both.where("segments >= 2").select("channel", F.col("sa").alias("source_addr"), F.col("ta").alias("target_addr"))
        return joins.anti_join(found, self.subgraphs.withColumnRenamed("addr", "target_addr"), ["target_addr"]).select("channel", "source_addr", "target_addr").distinct()

    @cached_property
    def channels(self) -> DataFrame:
        """channel_kind, channel, source_addr, target_addr of plain and scope-crossing channels."""
        plain = self.channels_normal.select(F.lit("Normal").alias("channel_kind"), "channel", "source_addr", "target_addr")
        return setops.union_distinct(plain, self.channels_crossing.select(F.lit("ScopeCrossing").alias("channel_kind"), "channel", "source_addr", "target_addr"))

    @cached_property
    def edges(self) -> DataFrame:
        """Channels from a leaf to any operator, with both ends."""
        source = self.nodes.select(F.col("addr").alias("source_addr"), F.col("id").alias("source_id"), F.col("name").alias("source_name"))
        target = self.raw_operators.select(F.col("addr").alias("target_addr"), F.col("id").alias("target_id"), F.col("name").alias("target_name"))
        return self.channels.join(source, ["source_addr"]).join(target, ["target_addr"]).distinct()

    @cached_property
    def channel_ids(self) -> DataFrame:
        return self.channels.select("channel").distinct()

    @cached_property
    def operator_shapes(self) -> DataFrame:
        """Distinct ports on which channels leave and reach each operator, ascending."""
        ends = self.raw_channels
        inputs = ends.select(S.push(F.col("addr"), F.col("target_op")).alias("addr"), F.col("target_port").alias("port"))
        outputs = ends.select(S.push(F.col("addr"), F.col("source_op")).alias("addr"), F.col("source_port").alias("port"))
        none = F.array().cast("array<bigint>")
        out = joins.outer_default(self.raw_operators.select("id", "addr"), aggregates.reduce_collect(inputs, ["addr"], F.col("port"), "inputs"), ["addr"], inputs=none)
        return joins.outer_default(out, aggregates.reduce_collect(outputs, ["addr"], F.col("port"), "outputs"), ["addr"], outputs=none).select("id", "addr", "inputs", "outputs")

    def dataflow_stats(self, outer: bool = False, lifespans: DataFrame | None = None) -> DataFrame:
        """Per top-level dataflow and worker: operators, subgraphs and channels below it, and its life.

        As these are inner joins, dataflows without any one of them are left out; `outer` keeps them with zeros."""
        scopes = self.subgraphs.withColumnRenamed("addr", "scope")

        def below(rows: DataFrame, name: str) -> DataFrame:
            each = joins.prefix_join(rows, "addr", scopes, "scope")
            return each.groupBy("scope").agg(F.count(F.lit(1)).alias(name)).select(F.col("scope").alias("addr"), name)

        how = "left" if outer else "inner"
        out = self.addr_ids.join(joins.semi_join(self.addr_ids, self.dataflow_ids, ["worker", "operator"]).select("addr").distinct(), ["addr"], "left_semi")
        for rows, name in ((self.operator_addrs, "operators"), (self.subgraphs, "subgraphs"), (self.raw_channels.select("addr", "id"), "channels")):
            out = out.join(below(rows, name), ["addr"], how)
        out = out.fillna(0, ["operators", "subgraphs", "channels"])
        lives = (self.lifespans if lifespans is None else lifespans).select("worker", "operator", "birth_ns", "death_ns")
        return out.join(lives, ["worker", "operator"], how).select(F.col("operator").alias("id"), "addr", "worker", "operators", "subgraphs", "channels", "birth_ns", "death_ns")

    # -- progress ------------------------------------------------------------------------------------------------------
    def operator_progress(self) -> DataFrame:
        """Messages per operator port and channel: sent ones are outputs, received ones inputs."""
        each = self.progress.select("worker", "channel", "is_send", F.explode("messages").alias("m"))
        per = each.groupBy("worker", F.col("m.node").alias("operator"), F.col("m.port").alias("port"), "channel", "is_send").agg(F.sum("m.diff").alias("messages"))
        part = F.struct("port", "messages", "channel")
        return per.groupBy("worker", "operator").agg(
            F.array_sort(F.collect_list(F.when(~F.col("is_send"), part))).alias("input_messages"), F.array_sort(F.collect_list(F.when(F.col("is_send"), part))).alias("output_messages")
        )

    def aggregated_activations(self) -> DataFrame:
        """All activations of each operator in order; none for operators never scheduled."""
        lists = aggregates.sort_by(self.activations, ["operator"], F.struct("start_ns", "duration_ns"), "activations")
        every = self.operates.select(F.col("id").alias("operator")).distinct()
        return joins.outer_default(every, lists, ["operator"], activations=F.array().cast("array<struct<start_ns: bigint, duration_ns: bigint>>"))

    def all(self) -> dict[str, DataFrame]:
        """Every result relation by name."""
        named = (
            "workers operators dataflows arrangement_ids total_runtime nodes edges timeline_events name_lookup addr_lookup operator_shapes summarized aggregated_summaries arrangements "
            "aggregated_arrangements spline_levels"
        ).split()
        found = {n: getattr(self, n).distinct() for n in named}
        found |= {"channels": self.channel_ids, "subgraphs": self.subgraph_nodes, "dataflow_stats": self.dataflow_stats(), "operator_activations": self.activations}
        return found | ({"operator_progress": self.operator_progress()} if self.progress is not None else {})


def reachability(log: DataFrame) -> DataFrame:
    """Net count of each (tracker, node, port, timestamp), zeros gone."""
    return log.groupBy("kind", "tracker", "node", "port", "timestamp").agg(F.sum("diff").alias("diff")).where("diff <> 0")


def by_worker_order(lookup: DataFrame, value: str) -> DataFrame:
    """Of each operator, the value that the first worker having it gives."""
    return lookup.groupBy("operator").agg(F.min_by(value, "worker").alias(value))

