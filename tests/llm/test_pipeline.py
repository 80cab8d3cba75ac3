import re

import duckdb
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm.test_near_dup import plain
from tests.test_catalog import TABLES, compare
from tracemill.llm import queries


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.selectExpr("*", "'keep' AS score", "1 AS rate", "2 AS _kept")
    kept = corpus_pipeline.quality(spark, extra, SF)
    assert kept.columns == extra.columns and 0 < kept.count() < docs.count()
    one = corpus_pipeline.one_of_each(spark, kept, SF)
    want = {i for i, (_, c) in plain([(r["doc_id"], r["text"]) for r in kept.collect()], 80).items() if i == c}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == extra.columns
    red = corpus_pipeline.redacted(spark, one, SF)
    assert red.columns == extra.columns
    before = {r["doc_id"]: r["text"] for r in one.collect()}
    for r in red.collect():
        assert r["text"] == re.sub(r'(token = ")[0-9a-f]{40}', r"\1[secret]", before[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    mix = corpus_pipeline.mixed(spark, red, SF)
    assert mix.columns == extra.columns and 0 < mix.count() <= red.count()
    packed = corpus_pipeline.packed(spark, mix, SF).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mix.collect()}


def test_run_equals_its_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["line_quality", "near_dup", "secrets", "mixing", "packing"]
    found = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toArrow())
    pieces = lambda df: sorted(tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in df.collect())
    whole = lambda df: {(r["doc_id"], r["doc_tokens"]) for r in df.collect()}
    assert whole(found) == whole(docs) and len(pieces(found)) > 0


def odd(spark):
    """Null, empty, long and repeated rows, null ids, clashing names."""
    long = " ".join(f"word{k} and" for k in range(60_000)) + "."
    rows = [(1, "A fine day is here, and we walk along the river.", "en", "web"), (1, "A fine day is here, and we walk along the river.", "en", "web"), (2, None, None, None), (3, "", "en", "web")]
    rows += [(None, "A fine day is here, and we walk along the river.", "en", "web"), (None, None, "en", "web"), (None, "Nobody knows who wrote this line.", None, "web"), (5, long, "de", None)]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "'c' AS score", "'c' AS mark", "'c' AS kept", "'c' AS copies", "'c' AS topic", "'c' AS tokens", "'c' AS rate", "'c' AS _lang", "'c' AS _s", "'c' AS start")


@pytest.mark.parametrize("k", range(5))
def test_stages_with_odd_rows(spark, k):
    docs, (name, stage) = odd(spark), corpus_pipeline.STAGES[k]
    found = stage(spark, docs, SF)
    rows = found.collect()
    if k < 4:
        assert found.columns == docs.columns
    if name == "near_dup":
        got = sorted(((r["doc_id"], r["text"] and r["text"][:8]) for r in rows), key=str)
        assert got == sorted([(1, "A fine d"), (2, None), (3, ""), (None, None), (None, "Nobody k"), (5, "word0 an")], key=str)
    if name == "secrets":
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    if name == "packing":
        assert {r["doc_id"] for r in rows} == {1, 2, 3, 5, None}
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == found.columns


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    compare(queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name]))
