"""Schemas of the telemetry tables and the order of model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SYSCALL_TYPES = ("Execve", "Openat", "Connect", "Clone")


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "binary": T.BinaryType(), "timestamp": T.TimestampType()}


def _struct(text: str) -> T.StructType:
    """A flat schema from "name type, name type"."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in text.split(","))])


SYSCALL = _struct(
    "event_id bigint, timestamp_ns bigint, pid bigint, tid bigint, ppid bigint, syscall_type string, filename string, "
    "ip_address string, port int, child_pid bigint, open_flags bigint, syscall_result int"
)
RAW_SYSCALL = _struct(
    "timestamp bigint, pid bigint, tid bigint, ppid bigint, syscall_type bigint, ipv4_addr binary, port int, "
    "filename_len int, syscall_result int, open_flags bigint, filename binary"
)
PROCESS_SNAPSHOT = _struct("pid bigint, process_name string, binary_path string, uid bigint, parent_pid bigint, start_time_ticks bigint, cgroup string")
PROCESS_INFO = _struct("pid bigint, process_name string, binary_path string")
CONTRIBUTION = _struct("feature_name string, contribution_score double")
CORPUS = _struct("timestamp double, processId bigint, processName string, eventName string, returnValue bigint, args string, sus int, evil int")
ALERT = T.StructType(
    _struct("alert_id bigint, timestamp timestamp, pid bigint, process_name string, binary_path string").fields
    + [T.StructField("ancestry_chain", T.ArrayType(PROCESS_INFO))]
    + _struct("threat_score double, model_hash string").fields
    + [T.StructField("top_features", T.ArrayType(CONTRIBUTION)), T.StructField("summary", T.StringType())]
)
MODEL_NODE = _struct(
    "tree_id int, node_id int, mode string, feature_index int, threshold double, true_node int, false_node int, missing_true boolean, weight double"
)
ENRICHMENT_RECORD = T.StructType(
    _struct("record_type string, pid bigint, ancestry_truncated boolean, enrichment_partial boolean").fields
    + [T.StructField("ancestry_chain", T.ArrayType(_struct("pid bigint, ppid bigint, process_name string, binary_path string")))]
)

#: Scalar features in model order.
SCALAR_FEATURES = (
    "pid",
    "window_start_ns",
    "window_end_ns",
    "total_syscalls",
    "execve_count",
    "openat_count",
    "connect_count",
    "clone_count",
    "execve_ratio",
    "openat_ratio",
    "connect_ratio",
    "clone_ratio",
    "path_entropy",
    "unique_ips",
    "unique_files",
    "child_spawn_count",
    "avg_inter_syscall_time_ns",
    "min_inter_syscall_time_ns",
    "max_inter_syscall_time_ns",
    "stddev_inter_syscall_time_ns",
    "wrote_etc",
    "wrote_tmp",
    "wrote_dev",
    "read_sensitive_file_count",
    "write_sensitive_file_count",
    "outbound_connection_count",
    "loopback_connection_count",
    "distinct_ports",
    "failed_syscall_count",
    "short_lived",
    "window_duration_ns",
    "events_per_second",
)
PRIOR_FEATURES = ("bigrams.__process_positive_rate__", "bigrams.__event_positive_rate__", "trigrams.__path_positive_rate__")
MANIFEST = SCALAR_FEATURES + PRIOR_FEATURES
FEATURE_VECTOR = T.StructType(
    [
        T.StructField(
            n,
            T.BooleanType()
            if n in ("wrote_etc", "wrote_tmp", "wrote_dev", "short_lived")
            else T.DoubleType()
            if n.endswith(("ratio", "entropy", "_time_ns", "per_second"))
            else T.LongType(),
        )
        for n in SCALAR_FEATURES
    ]
    + [T.StructField("bigrams", T.MapType(T.StringType(), T.DoubleType())), T.StructField("trigrams", T.MapType(T.StringType(), T.DoubleType()))]
)


def process_key(df: DataFrame) -> list[str]:
    """The columns that name a process: host_id where the table has it, and pid."""
    return [c for c in ("host_id", "pid") if c in df.columns]


def window_key(df: DataFrame) -> list[str]:
    return [c for c in ("host_id", "pid", "lifetime", "window_start_ns") if c in df.columns]
