import base64
import hashlib
import math

import numpy as np
import pytest

from tracemill.llm import topk_search, warc
from tracemill.llm.storage import Workspace


def plain(vectors, k=5):
    ok = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(i, np.floor(256 * np.array(v)).astype(int))
    out = []
    for q in sorted(i for i in ok if i % 50 == 0):
        rest = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(rest)]
    return out


@pytest.mark.parametrize("sizes", [(2048, 512, 8), (40, 3, 2)])
def test_top_k(spark, monkeypatch, sizes):
    for name, size in zip(("CANDIDATES", "QUERIES", "TOGETHER"), sizes, strict=True):
        monkeypatch.setattr(topk_search, name, size)
    rng = np.random.RandomState(2)
    rows = [(i, rng.randn(8).tolist()) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 520)] + [(i, [0.0] * 8) for i in range(520, 551)]
    rows += [(600, None), (650, [float("nan")] + [0.0] * 7), (700, [float("inf")] * 8), (None, [1.0] * 8), (3, rows[3][1]), (601, [None] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    found = topk_search.top_k(df, df.where("vec_id % 50 = 0"), Workspace(spark, "test")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == plain(rows)


def test_very_large_components(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.randn(6).tolist()) for i in range(120)] + [(200 + i, (rng.randn(6) * 1e7).tolist()) for i in range(4)] + [(300, [1e300, 0.0, 0.0, 0.0, 0.0, 0.0]), (301, [-1e306] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, df.where("vec_id % 50 = 0"), Workspace(spark, "test")).collect()
    whole = {i: [int(math.floor(256 * x)) for x in v] for i, v in rows if i != 301}  # 256 * 1e306 is not finite
    want = []
    for q in sorted(i for i in whole if i % 50 == 0):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], v, strict=True)))), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == want


def test_few_candidates(spark):
    rows = [(0, [-1.0, 2.0]), (50, [-1.0, 2.0]), (3, [1.0, -5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, df.where("vec_id % 50 = 0"), Workspace(spark, "test")).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found) == plain(rows)
    none = df.limit(0)
    assert topk_search.top_k(none, none, Workspace(spark, "test")).count() == 0
    assert topk_search.top_k(df.where("vec_id = 0"), df.where("vec_id = 0"), Workspace(spark, "test")).count() == 0


def test_surt():
    assert warc.surt("http://User@WWW.Example.com:80/a/b?c=1#x") == "com,example,www)/a/b?c=1"
    assert warc.surt("https://m.x.net") == "net,x,m)/" and warc.surt(None) == "" and warc.surt("x.org?q") == "org,x)/?q"


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    bodies = ["<p>é</p>", None, "", "same", "same", "same", "z" * 500_000]
    rows = [(k, "http://hot.example.com/", f"page {k}") for k in range(40)] + [(100 + k, f"http://a{k}.org/x\n{k}", b) for k, b in enumerate(bodies)]
    rows += [(200, None, "no url"), (None, "http://n.org/", "same"), (None, None, None), (7, "http://hot.example.com/", "page 7")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    found = warc.round_trip(pages, Workspace(spark, "test")).collect()
    assert len(found) == len(rows)
    last = {}
    for i, _, b in rows:
        if i is not None:
            last[b or ""] = max(i, last.get(b or "", -1))
    want = []
    for i, _, b in rows:
        data, first = (b or "").encode(), last.get(b or "")
        again = first is not None and (i is None or i < first)
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0), Workspace(spark, "test")).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, Workspace(spark, "test"), min_revisit_bytes=10**9).collect()} == {"response"}


def test_lookup_of_single_places(spark):
    pages = spark.createDataFrame([(k, f"http://s{k % 7}.org/{k}", f"b{k}") for k in range(300)], "page_id long, url string, html string")
    space = Workspace(spark, "test")
    shards = warc.index(warc.write(pages, space), space)
    wanted = spark.createDataFrame([("org,s3)/31", 31), ("org,s0)/0", 0), ("org,s0)/1", 1), ("", None), ("zz", 5)], "key string, page_id long")
    assert sorted(r["page_id"] for r in warc.lookup(wanted, shards, space).collect()) == [0, 31]
