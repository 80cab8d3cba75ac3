"""Readers of trace logs: tables, framed archives, sockets and file streams."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import schemas
from tracemill.functions import scalars as S


def empty(spark: SparkSession, kind: str) -> DataFrame:
    """A log without rows, in place of an absent optional one."""
    return spark.createDataFrame([], schemas.struct(schemas.LOGS[kind]))


def read_log(spark: SparkSession, dirs: list[str], kind: str, fmt: str = "parquet") -> DataFrame:
    """A log from directories of files named `<kind>.<anything>`; fmt is parquet, json or frames.

    Directories without such files add nothing.  Runs in one directory merge; keep runs in directories of their own to
    tell them apart.  TraceShare events are dropped at the source.
    """
    reader = spark.read.schema(schemas.struct(schemas.LOGS[kind])).option("pathGlobFilter", f"{kind}.*").option("recursiveFileLookup", "true")
    if fmt == "frames":
        from tracemill.sources.frames import FrameSource

        spark.dataSource.register(FrameSource)
        log = spark.read.format("frames").schema(schemas.struct(schemas.LOGS[kind])).option("kind", kind).load(",".join(dirs))
    else:
        log = reader.format(fmt).load(dirs)
    return log.where("kind <> 'TraceShare'") if kind == "differential" else log


def stream_log(spark: SparkSession, path: str, kind: str, fmt: str = "parquet", files_per_trigger: int = 16) -> DataFrame:
    """A log as a stream of the files that arrive in a directory, so many a micro-batch at most."""
    return spark.readStream.schema(schemas.struct(schemas.LOGS[kind])).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", f"{kind}.*").format(fmt).load(path)


def socket_log(spark: SparkSession, host: str, port: int, kind: str) -> DataFrame:
    """A log as JSON lines from a socket; one stream per port of the tracer.  Malformed lines are dropped."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    parsed = lines.select(F.from_json("value", schemas.struct(schemas.LOGS[kind])).alias("e")).where("e is not null").select("e.*")
    return parsed.where("kind <> 'TraceShare'") if kind == "differential" else parsed


def connect(spark: SparkSession, address: str = "127.0.0.1", ports: dict[str, int] | None = None) -> dict[str, DataFrame]:
    """The socket streams of a live program: engine, arrangement and progress logs."""
    return {kind: socket_log(spark, address, port, kind) for kind, port in (ports or {"timely": 51317, "differential": 51318, "timely-progress": 51319}).items()}


def shard(log: DataFrame, partitions: int) -> DataFrame:
    """Rows dealt by the key that keeps what belongs together in one partition."""
    kind = F.col("kind") if "kind" in log.columns else F.lit("")
    ref = F.col("id") if "id" in log.columns else F.col("operator") if "operator" in log.columns else F.lit(0)
    return log.repartition(partitions, S.distinguishing_key(F.col("worker"), kind, ref))


def ticks(spark: SparkSession, per_second: int = 2) -> DataFrame:
    """A clock stream, for re-timing by processing time."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def record(streams: dict[str, DataFrame], path: str, seconds: float) -> None:
    """Keep live streams as Parquet in a folder per kind for so long, then stop them; recorded() reads them back."""
    from tracemill.operators.recursion import checkpoint_dir

    started = []
    for kind, stream in streams.items():
        at = f"{checkpoint_dir(stream.sparkSession)}/tracemill/record-{uuid.uuid4().hex}"
        started.append(stream.writeStream.format("parquet").option("path", f"{path}/{kind}").option("checkpointLocation", at).start())
    end = time.monotonic() + seconds
    for query in started:
        query.awaitTermination(max(0, int(end - time.monotonic())))
        query.processAllAvailable()
        query.stop()


def recorded(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(schemas.struct(schemas.LOGS[kind])).parquet(f"{path}/{kind}")
