"""The text report: tables and the operator tree, rendered on the driver.

All rows are shown: a row per operator or worker, so the report grows with the program, not with its run.  They come one
partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.plans import analytics as A
from tracemill.plans.relations import Trace


def table(title: str, header: Sequence[str], rows: Iterable[Sequence]) -> str:
    cells = [[str(x) if x is not None else "" for x in row] for row in [header, *rows]]
    widths = [max(len(row[k]) for row in cells) for k in range(len(header))]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    text = ["| " + " | ".join(c.ljust(w) for c, w in zip(row, widths, strict=True)) + " |" for row in cells]
    return "\n".join([*([title] if title else []), line, text[0], line.replace("-", "="), *text[1:], line])


def _rows(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(r) for r in df.select(*columns).toLocalIterator()]


def _times(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: S.debug_duration(F.col(c)) for c in columns})


def tree(rows: Iterable[tuple[Sequence[int], str, int | None]]) -> str:
    """Operators (address, name, total) as an indented tree; siblings without a total first, then greatest total first,
    then by address.  Missing ancestors show as their last segment alone."""
    nodes: dict[tuple, tuple[str, int | None]] = {}
    children: dict[tuple, set[tuple]] = {}
    for addr, name, total in rows:
        addr = tuple(addr)
        nodes[addr] = name, total
        for k in range(1, len(addr) + 1):
            children.setdefault(addr[: k - 1], set()).add(addr[:k])
    out: list[str] = []
    pending = [((), -1)]
    while pending:
        at, depth = pending.pop()
        if at:
            name, total = nodes.get(at, (None, None))
            out.append("  " * depth + f"{list(at)}" + (f" {name}" if name else "") + (f", {total} ns" if total is not None else ""))
        order = sorted(children.get(at, ()), key=lambda c: ((t := nodes.get(c, ("", None))[1]) is not None, -(t or 0), c))
        pending += [(c, depth + 1) for c in reversed(order)]
    return "\n".join(out)


def build(t: Trace, differential: bool = True) -> str:
    overview = A.program_overview(t).withColumn("total_runtime_ns", S.debug_duration(F.col("total_runtime_ns"))).first()
    shown = [("Workers", "workers"), ("Dataflows", "dataflows"), ("Operators", "operators"), ("Subgraphs", "subgraphs"), ("Channels", "channels")]
    shown += [("Arrangements", "arrangements")] * differential + [("Total Runtime", "total_runtime_ns")]
    parts = [table("", ("Program Overview", ""), [(n, overview[c]) for n, c in shown])]
    columns = ["worker", "dataflows", "operators", "subgraphs", "channels", *["arrangements"] * differential, "runtime_ns"]
    parts.append(table("Per-Worker Statistics", columns, _rows(_times(A.worker_report(t), "runtime_ns").orderBy("worker"), *columns)))
    ranked = A.operators_by_total_runtime(t)
    columns = ["name", "operator", "addr", "total_ns", "count", "average_ns", "max_ns", "min_ns", "inputs", "outputs", *["max_size", "min_size", "batches"] * differential]
    parts.append(table("Operators Ranked by Total Runtime", columns, _rows(_times(ranked, "total_ns", "average_ns", "max_ns", "min_ns").drop("x"), *columns)))
    if differential:
        columns = ["name", "operator", "addr", "total_ns", "max_size", "min_size", "batches"]
        parts.append(table("Operators Ranked by Arrangement Size", columns, _rows(_times(A.operators_by_arrangement_size(t), "total_ns"), *columns)))
    parts.append("Operator Tree\n" + tree(_rows(A.operator_tree(t), "addr", "name", "total_ns")))
    return "\n\n".join(parts) + "\n"
