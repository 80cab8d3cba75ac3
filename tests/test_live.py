"""Producing logs, and reading them live."""

import json
import socket
import threading
import time

from pyspark.sql import functions as F

from tests.test_pairing import log
from tracemill import cli
from tracemill.functions import events
from tracemill.functions import scalars as S
from tracemill.operators import select
from tracemill.sources import frames, live, logs, producer
from tracemill.streaming import gate
from tracemill.streaming.progress import Status, watermark


def test_producer_to_frames(spark, tmp_path):
    with producer.TraceLogger(tmp_path, "timely", 3) as out:
        out.publish(10, [{"time_ns": 5, "kind": "Operates", "id": 0, "addr": [0], "name": "foobar"}])
        out.publish(20, [{"time_ns": 15, "kind": "Schedule", "id": 0, "is_start": True}, {"time_ns": 16, "kind": "Schedule", "id": 0, "is_start": False}])
        out.publish(20, [])
    found = logs.read_log(spark, [str(tmp_path)], "timely", "frames").orderBy("seq").select("seq", "capability_ns", "worker", "kind", "time_ns").collect()
    assert [tuple(r) for r in found] == [(0, 0, 3, "Operates", 5), (1, 10, 3, "Schedule", 15), (2, 10, 3, "Schedule", 16)]


def test_live_socket_is_recorded(spark, tmp_path):
    rows = [{"seq": 0, "time_ns": 0, "worker": 0, "kind": "Input", "is_start": True}, {"seq": 1, "time_ns": 100_000_000, "worker": 0, "kind": "Input", "is_start": False}]
    server = socket.create_server(("127.0.0.1", 0))

    def serve():  # the source connects once to try the port and once to read
        for _ in range(2):
            connection, _ = server.accept()
            connection.sendall("".join(json.dumps(r) + "\n" for r in rows).encode())

    threading.Thread(target=serve, daemon=True).start()
    status = Status()
    spark.streams.addListener(status)
    logs.record({"timely": logs.socket_log(spark, "127.0.0.1", server.getsockname()[1], "timely")}, str(tmp_path), 4)
    spark.streams.removeListener(status)
    found = logs.recorded(spark, str(tmp_path), "timely").orderBy("seq").select("time_ns", "kind", "is_start").collect()
    assert [tuple(r) for r in found] == [(0, "Input", True), (100_000_000, "Input", False)]


def test_listener_takes_so_many_connections_until_they_close(spark, tmp_path):
    listener = live.Listener("127.0.0.1:0", "timely", str(tmp_path), connections=2)
    for worker in (0, 1):
        producer.send(listener.address, [{"seq": k, "time_ns": 10 * k, "worker": worker, "kind": "Input", "is_start": k % 2 == 0} for k in range(50)])
    assert listener.wait(20)
    assert logs.read_log(spark, [str(tmp_path)], "timely", "json").groupBy("worker").count().orderBy("worker").collect() == [(0, 50), (1, 50)]
    waiting = live.Listener("127.0.0.1:0", "timely", str(tmp_path / "none"))
    assert not waiting.wait(0.3)


def test_frames_through_a_listener(spark, tmp_path):
    listener = live.Listener("127.0.0.1:0", "timely", str(tmp_path), encoding="frames")
    big = (1 << 63) + 5
    with socket.create_connection(listener.address) as s:
        s.sendall(frames.encode([frames.messages(3, [{"seq": 1, "time_ns": 5, "worker": 2, "kind": "Operates", "id": big, "addr": [0, big], "name": "x"}]), frames.progress([(3, -1)])]))
    assert listener.wait(20)
    row = logs.read_log(spark, [str(tmp_path)], "timely", "frames").select("id", S.unsigned_id(F.col("id")).alias("wide"), "addr").first()
    assert int(row["wide"]) == big and row["addr"] == [0, row["id"]] and row["id"] < 0


def test_gate_defers_and_drops_nothing(spark, tmp_path):
    second = 1_000_000_000
    for n, times in enumerate([[100, 1], [2, 90], [3, 7]]):  # files out of order
        spark.createDataFrame([(t * second, n) for t in times], "time_ns long, file int").coalesce(1).write.parquet(str(tmp_path / f"in/f{n}"))
        time.sleep(0.05)
    stream = spark.readStream.schema("time_ns long, file int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    found = gate.gated(stream).collect()
    assert sorted(r["time_ns"] // second for r in found) == [1, 2, 3, 7, 90, 100]
    last = max(r["batch"] for r in found)
    assert {r["time_ns"] // second for r in found if r["batch"] == last} == {90, 100}


def test_command_line_rest(capsys):
    assert cli.main(["--completions", "bash"]) is None and "--connections" in capsys.readouterr().out
    assert all("completions" in cli.completions(s) for s in cli.SHELLS)


def test_predicates(spark):
    df = log(spark, [{"kind": "Park", "is_start": True, "time_ns": 1, "park_ns": 5}, {"kind": "Park", "is_start": False, "time_ns": 2}, {"kind": "Shutdown", "id": 1, "time_ns": 3}])
    assert (df.where(events.is_park()).count(), df.where(events.is_unpark()).count(), events.of_kind(df, "Shutdown").first()["id"]) == (1, 1, 1)
    assert {r["kind"]: r["count"] for r in events.counts(df).collect()}["Park"] == 2
    assert {r["time_ns"] for r in select.delay(df, "time_ns", F.lit(2)).collect()} == {2, 3}


def test_watermark_of_no_progress():
    class Query:
        lastProgress = None

    assert watermark(Query()) is None
