"""From scored windows to alerts: threshold, explanation, identity, numbering, logs."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import clamp01, finite_or_zero, redact_pointers
from fleetlens.operators.ordering import numbered
from fleetlens.schemas import MANIFEST, process_key, window_key

MAX_ID = 2**63 - 1


def checked_threshold(threshold: float) -> float:
    if not 0.0 <= threshold <= 1.0:
        raise ValueError("threshold must be a number from 0 to 1")
    return threshold


def alert_filter(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows with a score at or above the threshold."""
    return scored.filter(F.col("threat_score") >= checked_threshold(threshold))


def top_features(contribs: Column, n: int = 5, manifest: tuple[str, ...] = MANIFEST) -> Column:
    """The n contributions of largest size (names break ties), non-finite ones as 0, filled up with unused names at 0."""
    clean = F.transform(contribs, lambda c: F.struct((-F.abs(finite_or_zero(c["contribution_score"]))).alias("order"), c["feature_name"].alias("feature_name"), finite_or_zero(c["contribution_score"]).alias("contribution_score")))
    best = F.transform(F.array_sort(clean), lambda c: F.struct(c["feature_name"].alias("feature_name"), c["contribution_score"].alias("contribution_score")))
    unused = F.array_except(F.array(*[F.lit(x) for x in manifest]), F.transform(contribs, lambda c: c["feature_name"]))
    filling = F.transform(unused, lambda x: F.struct(x.alias("feature_name"), F.lit(0.0).alias("contribution_score")))
    return F.slice(F.concat(best, filling), 1, n)


def alert_identity(name: Column, path: Column, chain: Column, pid: Column) -> Column:
    """struct(process_name, binary_path): the event's, else the last ancestor's, else a stand-in."""
    last = F.try_element_at(chain, F.lit(-1))
    return F.struct(
        F.coalesce(name, last["process_name"], F.lit("unknown-process")).alias("process_name"),
        F.coalesce(path, last["binary_path"], F.concat(F.lit("/proc/"), pid.cast("string"), F.lit("/exe"))).alias("binary_path"),
    )


def alert_chain(chain: Column, identity: Column, pid: Column) -> Column:
    """The chain with redacted texts, ending in the process itself."""
    entry = lambda p, n, b: F.struct(p.cast("bigint").alias("pid"), redact_pointers(n).alias("process_name"), redact_pointers(b).alias("binary_path"))
    clean = F.transform(F.coalesce(chain, F.array().cast("array<struct<pid: bigint, process_name: string, binary_path: string>>")), lambda p: entry(p["pid"], p["process_name"], p["binary_path"]))
    own = F.array(entry(pid, identity["process_name"], identity["binary_path"]))
    return F.when(F.coalesce(F.try_element_at(clean, F.lit(-1))["pid"] == pid, F.lit(False)), clean).otherwise(F.concat(clean, own))


def alert_summary(name: Column, pid: Column, score: Column, threshold: float, top: Column) -> Column:
    """One line: who scored what against which threshold, and the three largest contributions."""
    parts = F.array_join(F.transform(F.slice(top, 1, 3), lambda c: F.format_string("%s=%.3f", c["feature_name"], c["contribution_score"])), ", ")
    return redact_pointers(F.format_string("%s (pid %d) scored %.4f against threshold %.4f; top contributors: %s", name, pid, score, F.lit(float(threshold)), parts))


def alert_ids(alerts: DataFrame, last_id: int = 0) -> DataFrame:
    """alert_id: last_id + 1, + 2, ... in (timestamp_ns, host_id, pid) order. The alerts are staged once, in ranges of
    this order, so any number of them may be numbered; the table goes with the caller's `storage.scratch`."""
    if not 0 <= last_id < MAX_ID:
        raise ValueError("last_id is out of range")
    order = [c for c in ("timestamp_ns", "host_id", "pid") if c in alerts.columns]
    at, room = F.col("alert_id"), F.lit(MAX_ID - last_id)
    return numbered(alerts, order, "alert_id").withColumn("alert_id", F.when(at <= room, at + last_id).otherwise(F.raise_error(F.lit("alert ids are used up")).cast("bigint")))


def inference_log(scored: DataFrame) -> DataFrame:
    """One row per scored vector, alert or not."""
    return scored.select(
        F.lit("inference_result").alias("log_type"), F.col("window_end_ns").alias("timestamp_ns"), *process_key(scored), clamp01(F.col("threat_score")).alias("threat_score"), "model_hash", top_features(F.col("contributions")).alias("top_features")
    )


def window_identity(windowed: DataFrame) -> DataFrame:
    """Latest identity in each window: process_name, binary_path, ancestry_chain."""
    names = [c for c in ("process_name", "binary_path", "ancestry_chain") if c in windowed.columns]
    if not names:
        return windowed.select(*window_key(windowed)).distinct()
    at = F.struct("timestamp_ns", "event_id")
    return windowed.groupBy(*window_key(windowed)).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in names])


def build_alerts(scored: DataFrame, windows: DataFrame | None = None, threshold: float = 0.7, last_id: int = 0) -> DataFrame:
    """Alerts of scored windows. scored: window key, window_end_ns, threat_score, model_hash, contributions;
    windows: window key and what is known of process_name, binary_path, ancestry_chain; None: scored has these itself
    (features_all with identity)."""
    hits = known = alert_filter(scored, threshold)
    if windows is not None:
        known = windows.select(*window_key(windows), *[c for c in ("process_name", "binary_path", "ancestry_chain") if c in windows.columns])
        hits = hits.join(known, window_key(windows), "left")
    column = lambda c, kind: F.col(c) if c in known.columns else F.lit(None).cast(kind)
    chain = column("ancestry_chain", "array<struct<pid: bigint, process_name: string, binary_path: string>>")
    hits = hits.withColumn("identity", alert_identity(column("process_name", "string"), column("binary_path", "string"), chain, F.col("pid")))
    hits = hits.withColumns({"top_features": top_features(F.col("contributions")), "timestamp_ns": F.col("window_end_ns"), "chain": alert_chain(chain, F.col("identity"), F.col("pid"))})
    return alert_ids(hits, last_id).select(
        "alert_id", F.timestamp_micros(F.expr("timestamp_ns div 1000")).alias("timestamp"), *process_key(hits),
        redact_pointers(F.col("identity.process_name")).alias("process_name"), redact_pointers(F.col("identity.binary_path")).alias("binary_path"), F.col("chain").alias("ancestry_chain"),
        clamp01(F.col("threat_score")).alias("threat_score"), "model_hash", "top_features", alert_summary(F.col("identity.process_name"), F.col("pid"), F.col("threat_score"), threshold, F.col("top_features")).alias("summary"),
    )


