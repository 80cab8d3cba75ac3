"""Queries against their SQL on the small tables, and streams against their batch twins."""

import duckdb
import pytest

from tests.conftest import SF
from tracemill.plans import catalog, sql

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def other():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    return repr(round(v, 9)) if isinstance(v, float) else repr(v)


def compare(df, rel):
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    ours = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    theirs = sorted(tuple(norm(v) for _, v in sorted(zip(rel.columns, r, strict=True))) for r in rel.fetchall())
    assert ours == theirs


CHOSEN = (
    "operators_by_total_runtime worker_timeline lifespans arrangement_stats program_overview worker_report edges operator_shapes dataflow_stats topk_batches aggregated_activations "
    "progress_messages collapse_events timeline_events worker_timeline html_subgraphs vega_nodes graph_orphans stream_session stream_late human_duration threshold hierarchical_reduce stream_activations stream_timeline stream_lifespans stream_summation"
).split()


@pytest.mark.parametrize("name", CHOSEN)
def test_against_sql(spark, other, name):
    compare(catalog.QUERIES[name](spark, SF), other.sql(sql.QUERIES[name]))


def test_names():
    assert set(sql.QUERIES) <= set(catalog.QUERIES)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(sql.QUERIES)
