"""Shared working storage: intermediate tables live in the folder that the cluster names in spark.checkpoint.dir.

A table written there outlives any executor, and a plan that reads it back starts from files instead of a long lineage.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch: bounds what a Python worker holds of a table of long texts.
ARROW_ROWS = 1000


def base_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local session may name none (tests): it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def limit_arrow_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower the session's rows in an Arrow batch.  The setting stays: plans read it when they run, after a query returns."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


class Workspace:
    """Named Parquet tables under one fresh folder of the shared storage."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{base_dir(spark)}/tracemill/{label}-{uuid.uuid4().hex}"
        # the virtual machine outlives the session, so what a stopped session left can still be removed
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        atexit.register(self.remove)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table and return its stored form."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def remove(self, name: str = "") -> None:
        """Delete one table that nothing reads any more, or the whole folder."""
        try:
            path = self._jvm.org.apache.hadoop.fs.Path(self.at(name) if name else self.path)
            path.getFileSystem(self._conf).delete(path, True)
        except (Py4JError, OSError):  # the virtual machine has ended before this process
            pass
