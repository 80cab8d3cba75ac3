"""The graph and dashboard page: result relations as JSON in one HTML file, and whole beside it."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.plans import analytics as A
from tracemill.plans.relations import Trace

#: Rows of a relation that the page itself holds at most: the first in its order.  The page says where there are more.
PAGE_ROWS = 50_000
_PAGE = Path(__file__).with_name("page.html")


def to_json(df: DataFrame, rows: int | None = None) -> list[dict]:
    """Rows as documents, one partition after another; at most so many."""
    text = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}))
    return [json.loads(r[0]) for r in (text if rows is None else text.limit(rows)).toLocalIterator()]


#: What the page shows, and the order of each relation.
_ORDERS = {
    "graph_nodes": ("addr",), "graph_scopes": ("addr",), "nodes": ("-total_ns", "operator"), "subgraphs": ("-total_ns", "operator"), "edges": ("channel", "source_addr", "target_addr"),
    "orphans": ("addr",), "palette_colors": ("position",), "timeline_events": ("start_ns", "worker", "kind", "ref_id", "duration_ns"), "vega": ("-total_ns", "operator"),
    "activations": ("start_ns", "worker", "operator", "duration_ns"), "spline_levels": ("event_ns", "worker", "operator"), "compaction": ("scale",),
}


def relations(t: Trace, palette: str = "inferno") -> dict[str, DataFrame]:
    """What the page shows."""

    def named(df: DataFrame) -> DataFrame:
        return df.select("id", "name", S.format_addr(F.col("addr")).alias("addr"))

    return {
        "graph_nodes": named(t.nodes), "graph_scopes": named(t.subgraph_nodes), "nodes": A.html_nodes(t, palette), "subgraphs": A.html_subgraphs(t, palette), "edges": A.html_edges(t),
        "orphans": A.graph_orphans(t).select(S.format_addr(F.col("addr")).alias("addr")), "palette_colors": A.palette_sample(t.spark, palette), "timeline_events": t.timeline_events,
        "vega": A.vega_nodes(t).drop("per_worker", "activation_durations").withColumn("addr", S.format_addr(F.col("addr"))), "activations": t.activations,
        "spline_levels": t.spline_levels, "compaction": A.compaction(t),
    }


def graph_data(t: Trace, palette: str = "inferno", path: str | None = None) -> dict:
    """The page's rows by relation, with `totals`, the number of rows that each relation has.  With a path, every relation
    is written there whole, as JSON lines, and read back for the page."""
    data: dict = {"totals": {}}
    for name, df in relations(t, palette).items():
        if path:
            df.write.mode("overwrite").json(f"{path}/{name}")
            df = t.spark.read.schema(df.schema).json(f"{path}/{name}")
        ordered = df.orderBy(*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in _ORDERS[name]])
        data[name] = to_json(ordered, PAGE_ROWS)
        data["totals"][name] = len(data[name]) if len(data[name]) < PAGE_ROWS else df.count()
    data["palette_colors"] = [r["color"] for r in data["palette_colors"]]
    data["totals"].pop("palette_colors")
    return data


def page(t: Trace, palette: str = "inferno", path: str | None = None) -> str:
    return _PAGE.read_text(encoding="utf-8").replace("DATA", json.dumps(graph_data(t, palette, path)).replace("</", "<\\/"), 1)
