"""Fixed points.  Every round is stored in the shared folder, so no limit of rows or levels applies."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder.  Only a local session may name none (tests): it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tracemill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def iterate(seed: DataFrame, step: Callable[[DataFrame], DataFrame], rounds: int = 100) -> DataFrame:
    """All rows reachable from the seed by `step`: semi-naive, each round works on the new rows of the one before."""
    checkpoint_dir(seed.sparkSession)
    known = new = seed.distinct().checkpoint()
    for _ in range(rounds):
        new = step(new).select(*seed.columns).distinct().join(known, seed.columns, "left_anti").checkpoint()
        if new.isEmpty():
            return known
        known = known.unionByName(new).checkpoint()
    raise RuntimeError(f"no fixed point within {rounds} rounds")


def unfold(seed: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The seed and all rows that repeated steps lead to, as a bag: each round's rows are stored and are the next one's
    input, until a round has none.  For steps that end by themselves, such as one scope deeper each."""
    checkpoint_dir(seed.sparkSession)
    every = new = seed
    while not (new := step(new).select(*seed.columns).checkpoint()).isEmpty():
        every = every.unionByName(new)
    return every
