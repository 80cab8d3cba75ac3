"""Typed tables of the engine.  Times are nanoseconds in BIGINT; addresses are ARRAY<BIGINT>; seq is the arrival order."""

from pyspark.sql.types import StructType

TIMELY_LOG = (
    "seq BIGINT, capability_ns BIGINT, time_ns BIGINT, worker BIGINT, kind STRING, id BIGINT, addr ARRAY<BIGINT>, name STRING, "
    "source_op BIGINT, source_port BIGINT, target_op BIGINT, target_port BIGINT, is_start BOOLEAN, park_ns BIGINT, is_send BOOLEAN, "
    "channel BIGINT, msg_source BIGINT, msg_target BIGINT, seq_no BIGINT, length BIGINT, comm_kind STRING"
)
DIFFERENTIAL_LOG = (
    "seq BIGINT, capability_ns BIGINT, time_ns BIGINT, worker BIGINT, kind STRING, operator BIGINT, length BIGINT, scale BIGINT, "
    "length1 BIGINT, length2 BIGINT, complete BIGINT, shortfall BIGINT, diff BIGINT"
)
_UPDATES = "ARRAY<STRUCT<node: BIGINT, port: BIGINT, timestamp: STRING, timestamp_type: STRING, diff: BIGINT>>"
PROGRESS_LOG = (
    "seq BIGINT, capability_ns BIGINT, time_ns BIGINT, worker BIGINT, is_send BOOLEAN, source_worker BIGINT, channel BIGINT, "
    f"seq_no BIGINT, addr ARRAY<BIGINT>, messages {_UPDATES}, internal {_UPDATES}"
)
REACHABILITY_LOG = "seq BIGINT, time_ns BIGINT, worker BIGINT, kind STRING, tracker ARRAY<BIGINT>, node BIGINT, port BIGINT, timestamp STRING, diff BIGINT"

LOGS = {"timely": TIMELY_LOG, "differential": DIFFERENTIAL_LOG, "timely-progress": PROGRESS_LOG, "reachability": REACHABILITY_LOG}

#: Event kinds of each log.
TIMELY_KINDS = (
    "Operates", "Channels", "PushProgress", "Messages", "Schedule", "Shutdown", "Application", "GuardedMessage", "GuardedProgress", "CommChannels", "Input", "Park", "Text",
)
DIFFERENTIAL_KINDS = ("Batch", "Merge", "Drop", "MergeShortfall", "TraceShare")

ACTIVATIONS = "worker BIGINT, operator BIGINT, start_ns BIGINT, duration_ns BIGINT"
LIFESPANS = "worker BIGINT, operator BIGINT, birth_ns BIGINT, death_ns BIGINT"
TIMELINE = "worker BIGINT, kind STRING, ref_id BIGINT, start_ns BIGINT, duration_ns BIGINT, collapsed_events BIGINT"


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)
