import io
import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_pairing import log
from tracemill import cli, schemas, sinks
from tracemill.plans import render, report
from tracemill.sources import frames, logs, projection


def test_frames_round_trip():
    deep = {"kind": "Operates", "id": 4, "addr": [0] * 100, "name": "foobarbaz"}
    sent = [frames.progress([(0, 1), (4, 5)]), frames.messages(0, [{"kind": "Operates", "id": 0, "addr": [0], "name": "foobar"}]), frames.messages(40, [deep])]
    data = frames.encode(sent)
    assert list(frames.decode(io.BytesIO(data))) == sent
    with pytest.raises(ValueError):
        list(frames.decode(io.BytesIO(data[:-3])))


def test_frame_source(spark, tmp_path):
    row = {"seq": 1, "time_ns": 5, "worker": 2, "kind": "Schedule", "id": 7, "is_start": True}
    (tmp_path / "timely.worker-2.frames").write_bytes(frames.encode([frames.progress([(0, 1)]), frames.messages(3, [row])]))
    (tmp_path / "other.worker-2.frames").write_bytes(b"junk")
    found = logs.read_log(spark, [str(tmp_path)], "timely", "frames").select("capability_ns", "time_ns", "worker", "id").collect()
    assert [tuple(r) for r in found] == [(3, 5, 2, 7)]


def test_logs_round_trip_and_cli(spark, tmp_path):
    t = projection.trace(spark, SF)
    t.timely.coalesce(1).write.parquet(str(tmp_path / "logs/timely.parquet"))
    t.differential.coalesce(1).write.parquet(str(tmp_path / "logs/differential.parquet"))
    import shutil

    flat = tmp_path / "flat"
    flat.mkdir()
    for kind in ("timely", "differential"):
        shutil.copy(next((tmp_path / f"logs/{kind}.parquet").glob("part-*.parquet")), flat / f"{kind}.worker-0.parquet")
    out = cli.main(["--replay-logs", str(flat), "-d", "--report-file", str(tmp_path / "report.txt"), "--output-dir", str(tmp_path / "page"), "--save-logs", str(tmp_path / "saved"), "-q"], spark)
    assert out.activations.count() == t.activations.count()
    text = (tmp_path / "report.txt").read_text()
    assert "Program Overview" in text and "Operators Ranked by Total Runtime" in text and "Operator Tree" in text
    page = (tmp_path / "page/index.html").read_text()
    data = json.loads(page[page.index("const data = ") + 13 : page.index(";\nconst SVG")].replace("<\\/", "</"))
    assert {(e["source_id"], e["target_id"]) for e in data["edges"]} == {(r["source_id"], r["target_id"]) for r in t.edges.collect()} and data["edges"]
    assert {n["id"] for n in data["graph_nodes"]} == {r["id"] for r in t.nodes.collect()} and len(data["palette_colors"]) == 10
    top = sorted((r["total_ns"] for r in t.aggregated_summaries.collect()), reverse=True)
    assert [v["total_ns"] for v in data["vega"]] == top and data["totals"]["activations"] == len(data["activations"]) == t.activations.count()
    assert spark.read.json(str(tmp_path / "page/data/timeline_events")).count() == t.timeline_events.count()
    assert spark.read.parquet(str(tmp_path / "saved/timely")).count() == t.timely.count()


def test_page_says_what_it_leaves_out(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(render, "PAGE_ROWS", 3)
    data = render.graph_data(projection.dense_trace(spark, SF), path=f"file://{tmp_path}")
    assert len(data["activations"]) == 3 < data["totals"]["activations"] == spark.read.json(str(tmp_path / "activations")).count()
    assert data["activations"] == sorted(data["activations"], key=lambda r: r["start_ns"]) and data["orphans"]


def test_tree_order():
    rows = [([6, 2], "a", 5), ([7, 2, 5], "b", None), ([1, 2, 3], "c", 1), ([1, 2, 5], "d", 9), ([1, 2, 4], "e", None)]
    lines = [x.strip() for x in report.tree(rows).splitlines()]
    assert lines.index("[1, 2, 4] e") < lines.index("[1, 2, 5] d, 9 ns") < lines.index("[1, 2, 3] c, 1 ns")


def test_empty_and_extract(spark):
    assert logs.empty(spark, "timely").columns == [f.name for f in schemas.struct(schemas.TIMELY_LOG).fields]
    df = spark.createDataFrame([("a", 2), ("a", -1), ("b", -1)], "k string, diff long")
    assert [r["k"] for r in sinks.extract(df).collect()] == ["a"]


def test_shard_keeps_keys_together(spark):
    rows = [{"kind": "Schedule", "id": k % 5, "time_ns": k, "is_start": True} for k in range(50)]
    parts = logs.shard(log(spark, rows), 3).withColumn("p", F.spark_partition_id()).groupBy("id").agg(F.countDistinct("p").alias("n")).collect()
    assert {r["n"] for r in parts} == {1}
