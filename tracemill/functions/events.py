"""Predicates on event kinds and the fields that a kind carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import schemas

#: Fields of each kind, in the logs' flat columns.
FIELDS = {
    "Operates": ("id", "addr", "name"),
    "Channels": ("id", "addr", "source_op", "source_port", "target_op", "target_port"),
    "PushProgress": ("id",),
    "Messages": ("is_send", "channel", "msg_source", "msg_target", "seq_no", "length"),
    "Schedule": ("id", "is_start"),
    "Shutdown": ("id",),
    "Application": ("id", "is_start"),
    "GuardedMessage": ("is_start",),
    "GuardedProgress": ("is_start",),
    "CommChannels": ("id", "comm_kind"),
    "Input": ("is_start",),
    "Park": ("is_start", "park_ns"),
    "Text": ("name",),
    "Batch": ("operator", "length"),
    "Merge": ("operator", "scale", "length1", "length2", "complete"),
    "Drop": ("operator", "length"),
    "MergeShortfall": ("operator", "scale", "shortfall"),
    "TraceShare": ("operator", "diff"),
}


def is_kind(kind: str) -> Column:
    if kind not in FIELDS:
        raise ValueError(f"{kind} is no event kind; there are {', '.join(FIELDS)}")
    return F.col("kind") == kind


def is_start() -> Column:
    return F.coalesce(F.col("is_start"), F.lit(False))


def is_stop() -> Column:
    return F.coalesce(~F.col("is_start"), F.lit(False))


def is_progress() -> Column:
    """A captured frame that moves the frontier (column `changes`), not one with rows (column `rows`)."""
    return F.col("changes").isNotNull()


def is_messages() -> Column:
    return F.col("rows").isNotNull()


is_data = is_messages


def is_park() -> Column:
    return is_kind("Park") & is_start()


def is_unpark() -> Column:
    return is_kind("Park") & is_stop()


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    """One kind's rows with its own fields; the predicate reaches the scan."""
    return log.where(is_kind(kind)).select("seq", "time_ns", "worker", *FIELDS[kind])


def counts(log: DataFrame) -> DataFrame:
    """Rows of each known kind, absent ones with 0."""
    known = schemas.TIMELY_KINDS if "addr" in log.columns else schemas.DIFFERENTIAL_KINDS
    every = log.sparkSession.createDataFrame([(k,) for k in known], "kind string")
    return every.join(log.groupBy("kind").count(), ["kind"], "left").fillna(0, ["count"])
