"""Golden vectors and property tests of start/stop pairing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.operators import pairing, windows
from tracemill.plans.relations import Trace
from tracemill.streaming import stateful


def log(spark, rows, ddl=schemas.TIMELY_LOG):
    names = [f.name for f in schemas.struct(ddl).fields]
    return spark.createDataFrame([tuple(r.get(n, k if n == "seq" else 0 if n == "worker" else None) for n in names) for k, r in enumerate(rows)], schemas.struct(ddl))


def test_activation_golden(spark):
    rows = [{"kind": "Schedule", "id": 0, "time_ns": 1000, "is_start": True}, {"kind": "Schedule", "id": 0, "time_ns": 10000, "is_start": False}]
    t = Trace(log(spark, rows))
    assert [tuple(r) for r in t.activations.collect()] == [(0, 0, 1000, 9000)]
    assert [tuple(r) for r in t.timeline_events.collect()] == [(0, "Activation", 0, 1000, 9000, 1)]


def test_merge_golden(spark):
    rows = [
        {"kind": "Merge", "operator": 0, "time_ns": 1000, "scale": 1}, {"kind": "Merge", "operator": 0, "time_ns": 10000, "complete": 1000, "scale": 1},
        {"kind": "Merge", "operator": 1, "time_ns": 20000}, {"kind": "MergeShortfall", "operator": 1, "time_ns": 21000}, {"kind": "TraceShare", "operator": 9, "time_ns": 1},
    ]
    t = Trace(log(spark, []), log(spark, rows, schemas.DIFFERENTIAL_LOG))
    assert sorted(tuple(r) for r in t.merge_timeline.collect()) == [(0, "Merge", 0, 1000, 9000, 1), (0, "Merge", 1, 20000, 1000, 1)]
    assert sorted(tuple(r) for r in t.arrangement_ids.collect()) == [(0, 0), (0, 1)]
    assert [tuple(r) for r in t.spline_levels.collect()] == [(0, 0, 10000, 1, 1000)]


def simulate(rows):
    """Stacks and slots by key, row by row."""
    stacks, slots, line, acts = {}, {}, [], []
    for key, t, action in rows:
        open_ = stacks.setdefault(key, [])
        if action == "start":
            open_.append(t)
            slots[key] = t
            continue
        if action == "stop" and open_:
            s = open_.pop()
            line.append((*key, s, max(0, t - s)))
        elif action == "end":
            line += [(*key, s, max(0, t - s)) for s in open_]
            open_.clear()
        s = slots.pop(key, None)
        if s is not None:
            acts.append((*key, s, max(0, t - s)))
    return sorted(line), sorted(acts)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairing_matches_simulation(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0
    for _ in range(1500):
        t = max(0, t + rng.choice([0, 0, 1, 5, -2]))
        rows.append(((rng.randrange(3), rng.randrange(4)), t, rng.choices(["start", "stop", "end"], [5, 4, 1])[0]))
    df = spark.createDataFrame([(k, w, o, t, a) for k, ((w, o), t, a) in enumerate(rows)], "seq long, worker long, operator long, time_ns long, action string")
    line, acts = simulate(rows)
    assert sorted(tuple(r) for r in pairing.stack(df, ["worker", "operator"]).collect()) == line
    assert sorted(tuple(r) for r in pairing.slot(df, ["worker", "operator"], F.col("action") == "start").collect()) == acts


def test_lifespans_and_empty_logs(spark):
    rows = [{"kind": "Operates", "id": 5, "time_ns": 10}, {"kind": "Shutdown", "id": 5, "time_ns": 40}, {"kind": "Shutdown", "id": 6, "time_ns": 50}]
    assert [tuple(r) for r in Trace(log(spark, rows)).lifespans.collect()] == [(0, 5, 10, 40)]
    empty = Trace(log(spark, []))
    assert empty.activations.count() == empty.timeline_events.count() == empty.arrangements.count() == empty.channels.count() == 0


def test_collapse(spark):
    rows = [(0, 0, "A", 1, 0, 1_000_000), (1, 0, "A", 1, 1_400_000, 100), (2, 0, "B", 1, 1_400_200, 5), (3, 0, "A", 1, 9_000_000, 7), (4, 1, "A", 1, 9_000_000, 7)]
    df = spark.createDataFrame(rows, "seq long, worker long, kind string, ref_id long, start_ns long, duration_ns long").withColumn("collapsed_events", F.lit(1).cast("long"))
    found = sorted(tuple(r) for r in windows.collapse_events(df).collect())
    assert found == [(0, "A", 1, 0, 1_000_100, 2), (0, "A", 1, 9_000_000, 7, 1), (0, "B", 1, 1_400_200, 5, 1), (1, "A", 1, 9_000_000, 7, 1)]


@pytest.mark.parametrize("seed", [4, 5])
def test_streams_pair_across_batches(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [((rng.randrange(2), rng.randrange(3)), 10 * n, rng.choice(["start", "start", "stop", "end", "stop"]) if n % 9 else "start") for n in range(120)]
    for n in range(6):  # a file a batch
        part = [(*key, t // 10, t, action) for key, t, action in rows[20 * n : 20 * n + 20]]
        spark.createDataFrame(part, "worker long, operator long, seq long, time_ns long, action string").coalesce(1).write.parquet(str(tmp_path / f"f{n}"))
        time.sleep(0.02)
    line, acts = simulate(rows)
    for pair, want in ((stateful.stacks, line), (stateful.slots, acts)):
        stream = spark.readStream.schema("worker long, operator long, seq long, time_ns long, action string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
        assert sorted(tuple(r) for r in stateful.paired(stream, pair, "test").collect()) == want
