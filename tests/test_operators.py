import collections
import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import aggregates, recursion, select, windows
from tracemill.plans.relations import Trace, reachability
from tests.test_pairing import log


def changes(spark, rows):
    return spark.createDataFrame(rows, "k string, diff long")


@pytest.mark.parametrize(
    ("rows", "left"),
    [
        ([("foo", 143), ("bar", 57), ("bar", -57), ("bar", 57), ("bar", -60)], {("foo", 143), ("bar", -3)}),
        ([("foobar", -2), ("foobar", 5), ("foo", 10), ("foo", 10463)], {("foo", 10473), ("foobar", 3)}),
        ([("foo", 10), ("foo", -10)], set()),
    ],
)
def test_consolidate(spark, rows, left):
    assert {tuple(r) for r in aggregates.consolidate(changes(spark, rows)).collect()} == left
    assert {r["k"] for r in aggregates.snapshot(changes(spark, rows)).collect()} == {k for k, n in left if n > 0}


def test_sort_by_and_reduce(spark):
    df = spark.createDataFrame([(1, x) for x in (5, 1, 1, 3)], "k long, v long")
    assert aggregates.sort_by(df, ["k"], F.col("v"), "x").first()["x"] == [1, 1, 3, 5]
    assert aggregates.reduce_collect(df, ["k"], F.col("v"), "x").first()["x"] == [1, 3, 5]
    for name, want in (("sum", 10), ("min", 1), ("max", 5)):
        # buckets are of the value, so a sum counts repeats too
        assert aggregates.hierarchical_reduce(df, ["k"], name, "v", "x").first()["x"] == want


def test_hierarchical_sort_is_the_sort(spark):
    rng = random.Random(3)
    rows = [(k, rng.randrange(-50, 50), rng.choice([1, 1, 2, -1])) for k in (1, 2) for _ in range(400)] + [(3, 7, 1), (3, 7, -1)]
    df = spark.createDataFrame(rows, "k long, v long, diff long")
    want = {}
    for k in (1, 2):
        times = {v: sum(d for kk, vv, d in rows if (kk, vv) == (k, v)) for v in range(-50, 50)}
        want[k] = [v for v, n in times.items() for _ in range(max(0, n))]
    assert {r["k"]: r["x"] for r in aggregates.hierarchical_sort_by(df, ["k"], F.col("v"), "x", F.col("diff")).collect()} == want


HELD = [("foobar", 10, 11, -2), ("foo", 10, 10, 10), ("foo", 10, 10, 10463), ("foobar", 10, 11, 5), ("bar", 6, 6, 57), ("bar", 6, 6, -57), ("bar", 6, 6, 57), ("bar", 6, 6, -60), ("baz", 30, 30, 4), ("baz", 30, 30, -4)]


@pytest.mark.parametrize(
    ("dirty", "left"),
    [
        (None, {("foobar", 10, 11, 3): 1, ("foo", 10, 10, 10473): 1, ("bar", 6, 6, -3): 1}),
        ("release_ns = 10", {("foobar", 10, 11, 3): 1, ("foo", 10, 10, 10473): 1, ("bar", 6, 6, 57): 2, ("bar", 6, 6, -57): 1, ("bar", 6, 6, -60): 1, ("baz", 30, 30, 4): 1, ("baz", 30, 30, -4): 1}),
        ("release_ns = 99", None),
    ],
)
def test_compaction_of_held_changes(spark, dirty, left):
    df = spark.createDataFrame(HELD, "record string, release_ns long, at long, diff long")
    found = collections.Counter(tuple(r) for r in aggregates.compact(df, dirty=None if dirty is None else F.expr(dirty)).select("record", "release_ns", "at", "diff").collect())
    assert found == (collections.Counter(HELD) if left is None else left)


def test_hold_and_due(spark):
    df = spark.createDataFrame([(1, 5), (2, 30)], "n long, t long")
    out, kept = select.due(select.hold(df, "t", F.lit(20)), F.lit(21))
    assert [tuple(r) for r in out.collect()] == [(1, 5, 20)] and [tuple(r) for r in kept.collect()] == [(2, 30, 30)]


def test_top_rank_ties(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([9, 7, 7, 5, None])], "k long, v long")
    assert sorted(r["k"] for r in windows.top_rank(df, "v", 2).collect()) == [0, 1, 2]


def test_top_rank_of_a_ten_way_tie_and_fewer_rows(spark):
    df = spark.createDataFrame([(k, 3 if k < 10 else 5) for k in range(12)], "k long, v long")
    assert sorted((r["k"], r["rank"]) for r in windows.top_rank(df, "v", 3).collect()) == [(k, 3) for k in range(10)] + [(10, 1), (11, 1)]
    assert windows.top_rank(df, "v", 50).count() == 12 and windows.top_rank(df.limit(0), "v", 3).count() == 0


@pytest.mark.parametrize("stretch", [1 << 20, 4])
def test_collapse_against_a_plain_fold(spark, monkeypatch, stretch):
    monkeypatch.setattr(windows, "STRETCH", stretch)
    rng = random.Random(7)
    rows = [(w, rng.choice(["Parked", "Activation"]), rng.choice([None, 9007199254740993]), 10 * n + rng.randint(0, 9), rng.randint(0, 25), n, 1) for w in (0, 1) for n in range(60)]
    df = spark.createDataFrame(rows, "worker long, kind string, ref_id long, start_ns long, duration_ns long, seq long, collapsed_events long").repartition(3)
    want = []
    for w in (0, 1):
        state = None
        for row in sorted((r for r in rows if r[0] == w), key=lambda r: r[5]):
            if state and state[1:3] == list(row[1:3]) and max(0, state[3] - 3) <= row[3] + row[4] and state[3] + state[4] + 3 >= row[3]:
                state[4] += row[4]
                state[5] += 1
            else:
                state = [*row[:5], 1]
                want.append(state)
    got = [[r[c] for c in ("worker", "kind", "ref_id", "start_ns", "duration_ns", "collapsed_events")] for r in windows.collapse_events(df, margin=3).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[5] > 1 for r in got)


def test_iterate_reaches_all(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    seed = spark.createDataFrame([(1,)], "n long")
    out = recursion.iterate(seed, lambda new: new.join(links, F.col("n") == F.col("a")).select(F.col("b").alias("n")))
    assert sorted(r["n"] for r in out.collect()) == [1, 2, 3]


def test_crossing_closure_against_fixed_point(spark):
    """A dataflow [1] with scopes [1,1] and [1,1,1]: channels through both borders, in and out."""
    ops = [(1, [1]), (2, [1, 1]), (3, [1, 1, 1]), (4, [1, 1, 1, 1]), (5, [1, 2]), (6, [1, 1, 2])]
    chans = [(10, [1], 2, 1), (11, [1, 1], 0, 1), (12, [1, 1, 1], 0, 1), (13, [1, 1, 1], 1, 0), (14, [1, 1], 1, 0), (15, [1], 1, 2), (16, [1, 1], 1, 2)]
    rows = [{"kind": "Operates", "id": i, "addr": a, "name": str(i), "time_ns": 0} for i, a in ops]
    rows += [{"kind": "Channels", "id": i, "addr": a, "source_op": s, "source_port": 0, "target_op": t, "target_port": 0, "time_ns": 0} for i, a, s, t in chans]
    # sessions may bound recursive queries; nothing here is one
    limits = {"spark.sql.cteRecursionRowLimit": "3", "spark.sql.cteRecursionLevelLimit": "1"}
    for name, value in limits.items():
        spark.conf.set(name, value)
    t = Trace(log(spark, rows))
    base = [(i, tuple(a + [s]), tuple(a + [d])) for i, a, s, d in chans]
    links = {(s, d, (i,)) for i, s, d in base}
    while True:
        more = {(s, d2, p + (i,)) for s, d, p in links for i, s2, d2 in base if s2 == d + (0,)}
        more |= {(s2, d, (i,) + p) for s, d, p in links for i, s2, d2 in base if d2 == s + (0,)}
        if more <= links:
            break
        links |= more
    scopes = {(1,), (1, 1), (1, 1, 1)}
    want = {(p[0], s, d) for s, d, p in links if len(p) > 1 and d not in scopes}
    got = {(r["channel"], tuple(r["source_addr"]), tuple(r["target_addr"])) for r in t.channels_crossing.collect()}
    for name in limits:
        spark.conf.unset(name)
    assert got == want and got
    assert {(r["source_id"], r["target_id"]) for r in t.edges.collect()} >= {(5, 4), (4, 5), (4, 6)}


def test_reachability(spark):
    rows = [("SourceUpdate", [0], 1, 0, "t", 1), ("SourceUpdate", [0], 1, 0, "t", -1), ("SourceUpdate", [0], 2, 0, "t", 3)]
    df = spark.createDataFrame(rows, "kind string, tracker array<long>, node long, port long, timestamp string, diff long")
    assert [(r["node"], r["diff"]) for r in reachability(df).collect()] == [(2, 3)]
