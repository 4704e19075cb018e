"""Investigation and monitoring: newest events, latest states, timelines, rates, health, log comparison."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import clean_control, is_finite
from fleetlens.operators.ordering import previous
from fleetlens.schemas import process_key
from fleetlens.storage import staged

MINUTE_NS = 60 * 1_000_000_000
RANGES = {"30m": 30, "1h": 60, "6h": 360, "24h": 1440, "all": None}
SEVERITY_FLOORS = {"all": None, "medium+": 0.8, "high": 0.9}


def recent_events(events: DataFrame, pid: int | None = None, limit: int = 100) -> DataFrame:
    """Newest events first, of one pid if asked; limit is held between 1 and 4096."""
    rows = events if pid is None else events.filter(F.col("pid") == pid)
    return rows.orderBy(F.desc("timestamp_ns"), F.desc("event_id")).limit(max(1, min(limit, 4096)))


def latest_process(states: DataFrame) -> DataFrame:
    """The last state of each process (order it by timestamp_ns descending to show it)."""
    others = [c for c in states.columns if c not in process_key(states)]
    last = states.groupBy(*process_key(states)).agg(F.max_by(F.struct(*others), F.struct("timestamp_ns", "event_id")).alias("s"))
    return last.select(*process_key(states), "s.*")


def process_state(enriched: DataFrame, scored: DataFrame) -> DataFrame:
    """Latest name, path, depth and last syscall of each process, with its last known score.

    scored: process key, window_end_ns, threat_score (null scores don't replace known ones).
    """
    key = process_key(enriched)
    last = latest_process(enriched)
    known = scored.filter("threat_score is not null").groupBy(*key).agg(F.max_by("threat_score", "window_end_ns").alias("threat_score"))
    name = F.coalesce("process_name", F.concat(F.lit("pid-"), F.col("pid").cast("string")))
    path = F.coalesce("binary_path", F.concat(F.lit("/proc/"), F.col("pid").cast("string"), F.lit("/exe")))
    own = F.array(F.struct(F.col("pid"), name.alias("process_name"), path.alias("binary_path")))
    chain = F.when(F.size("ancestry_chain") > 0, F.col("ancestry_chain")).otherwise(own) if "ancestry_chain" in enriched.columns else own
    line = F.concat_ws(" ", "syscall_type", F.coalesce("filename", "ip_address", F.col("child_pid").cast("string")), F.concat(F.lit("= "), F.col("syscall_result").cast("string")))
    return last.join(known, key, "left").select(
        *key, name.alias("process_name"), path.alias("binary_path"), F.least(F.size(chain) - 1, F.lit(65535)).alias("depth"), chain.alias("ancestry_chain"), line.alias("last_syscall"), F.col("timestamp_ns").alias("updated_ns"), "threat_score"
    )


def process_tree(states: DataFrame, offset: int = 0, rows: int = 50, parents_first: bool = False) -> DataFrame:
    """Text lines of a process list, latest first (or in tree order), paged. states: process_state, exited optional."""
    exited = F.col("exited") if "exited" in states.columns else F.lit(False)
    score = F.when(is_finite(F.col("threat_score")), F.format_string("%.3f", "threat_score")).otherwise("unscored")
    mark = F.when(exited, F.lit(" (exited)")).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), clean_control(F.col("process_name")), F.lit(" ["), F.col("pid").cast("string"), F.lit("] "), score, mark)
    order = [F.transform("ancestry_chain", lambda p: p["pid"])] if parents_first else [F.desc("updated_ns")]
    return states.withColumn("line", line).orderBy(*order, *process_key(states)).offset(max(0, offset)).limit(max(1, rows))


def retained_exited(old: DataFrame, new: DataFrame) -> DataFrame:
    """The newest states, and the older ones that are gone from them as exited."""
    gone = old.join(new, process_key(old), "left_anti").withColumn("exited", F.lit(True))
    fresh = new if "exited" in new.columns else new.withColumn("exited", F.lit(False))
    return fresh.unionByName(gone, allowMissingColumns=True)


def process_detail(features: DataFrame) -> DataFrame:
    """Labelled text fields of a window and lines "name xN" of its non-zero counts."""
    counts = [(n, f"{n.lower()}_count") for n in ("Execve", "Openat", "Connect", "Clone")]
    lines = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{n} x"), F.col(c).cast("string"))) for n, c in counts]))
    return features.select(
        *process_key(features), "window_start_ns", F.concat_ws(" - ", F.col("window_start_ns").cast("string"), F.col("window_end_ns").cast("string")).alias("window"),
        F.format_string("entropy %.3f", "path_entropy").alias("entropy"), F.format_string("unique files %d", "unique_files").alias("files"), F.format_string("unique ips %d", "unique_ips").alias("ips"),
        F.format_string("failed %d", "failed_syscall_count").alias("failed"), F.format_string("rate %.1f/s", "events_per_second").alias("rate"),
        F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise("no syscalls in this window").alias("counts"),
    )


def signature_match(features: DataFrame, signatures: DataFrame, fallback: str = "unmatched") -> DataFrame:
    """Adds pattern: the signature whose count columns all agree. signatures: those columns and pattern, user data."""
    columns = [c for c in signatures.columns if c != "pattern"]
    return features.join(signatures.dropDuplicates(columns), columns, "left").withColumn("pattern", F.coalesce("pattern", F.lit(fallback)))


def alert_timeline(alerts: DataFrame, severity: str = "all", time_range: str = "all", now=None) -> DataFrame:
    """Alerts at or above a severity, not older than the range before `now` (the cut itself counts), newest first."""
    if severity not in SEVERITY_FLOORS:
        raise ValueError(f"severity must be one of {sorted(SEVERITY_FLOORS)}")
    if time_range not in RANGES:
        raise ValueError(f"time_range must be one of {sorted(RANGES)}")
    floor, minutes = SEVERITY_FLOORS[severity], RANGES[time_range]
    out = alerts if floor is None else alerts.filter(F.col("threat_score") >= floor)
    if minutes is not None:
        at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
        out = out.filter(F.col("timestamp") >= at - F.make_dt_interval(mins=F.lit(minutes)))
    return out.orderBy(F.desc("timestamp"), F.desc("alert_id"))


def alert_merge(old: DataFrame, new: DataFrame, keep: int = 4096) -> DataFrame:
    """New alerts replace old ones of the same id; the newest `keep` stay."""
    if keep < 1:
        raise ValueError("keep must be 1 at least")
    rows = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    others = [c for c in old.columns if c != "alert_id"]
    last = rows.groupBy("alert_id").agg(F.max_by(F.struct(*others), F.struct("turn", "timestamp")).alias("s")).select("alert_id", "s.*")
    return last.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(keep)


def latest_alerts(alerts: DataFrame, n: int = 64) -> DataFrame:
    return alerts.orderBy(F.desc("timestamp"), F.desc("alert_id")).limit(n)


def event_rate(events: DataFrame, seconds: int = 1) -> DataFrame:
    """Adds events_per_second: events of the host (all events, without host_id) in the trailing second, both ends included.

    Events are dealt by spans of that length. Each span also gets the events of the one before it, so no task needs
    more than two spans of a host."""
    span, key = seconds * 1_000_000_000, [c for c in ("host_id",) if c in events.columns]
    at = F.expr(f"timestamp_ns div {span}L")
    both = events.withColumn("span", F.explode(F.array(at, at + 1)))
    w = Window.partitionBy(*key, "span").orderBy("timestamp_ns").rangeBetween(-span, 0)
    return both.withColumn("events_per_second", F.count("*").over(w) / seconds).filter(F.col("span") == at).drop("span")


def latency_p99(samples: DataFrame, keep: int = 4096) -> DataFrame:
    """One row: the 99th percentile by rank floor((n - 1) * 99 / 100) of the newest `keep` samples (ts_ns, latency); 0 if none."""
    newest = samples.orderBy(F.desc("ts_ns"), F.desc("latency")).limit(keep)
    return newest.agg(F.sort_array(F.collect_list("latency")).alias("l")).select(F.coalesce(F.get("l", F.floor((F.size("l") - 1) * 99 / 100).cast("int")), F.lit(0)).alias("p99"))


def health_state(samples: DataFrame, rss_limit: int) -> DataFrame:
    """Adds health: BackPressure while running and enabled with drops, evictions or memory at the limit; else the state."""
    enabled = F.coalesce("enabled", F.lit(True)) if "enabled" in samples.columns else F.lit(True)
    pressed = (F.coalesce("dropped", F.lit(0)) > 0) | (F.coalesce("evicted", F.lit(0)) > 0) | (F.col("rss") >= rss_limit)
    return samples.withColumn("health", F.when((F.col("state") == "Running") & enabled & pressed, "BackPressure").otherwise(F.col("state")))


def state_history(samples: DataFrame) -> DataFrame:
    """Only the samples whose state differs from the one before (per host where there are hosts). Samples are spread over
    ranges of time, which carry their last state on."""
    told = previous(samples, "state", ["ts_ns"], "history", [c for c in ("host_id",) if c in samples.columns])
    return told.filter("before is null or before <> state").drop("before")


def counter_totals(per_cpu: DataFrame) -> DataFrame:
    """Sum of the per-CPU counters of each syscall; missing counts as 0."""
    return per_cpu.groupBy("syscall_type").agg(F.sum(F.coalesce("count", F.lit(0))).cast("bigint").alias("total"))


def correlate_alerts(events: DataFrame, alerts: DataFrame, port: int, baseline_id: int = 0) -> DataFrame:
    """Alerts above baseline_id of the process that most often connects to the marker port."""
    key = process_key(events)
    top = events.filter((F.col("syscall_type") == "Connect") & (F.col("port") == port)).groupBy(*key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *key).limit(1)
    return alerts.filter(F.col("alert_id") > baseline_id).join(F.broadcast(top), key, "left_semi")


#: Lines of a block and children of a node in a tree of digests.
FAN = 1024


def digest_tree(log: DataFrame, name: str, fan: int = FAN) -> list[DataFrame]:
    """Levels of a tree of digests over a log (line_no from 0, line), staged, leaves first: node, digest, bytes, n.

    A leaf's digest is that of its lines' digests in order, a node's that of its children's; the last level is the root
    (no rows for an empty log). Every node has up to `fan` children, so no task gathers more than that."""
    line = F.coalesce("line", F.lit(""))
    rows = log.select((F.col("line_no") / fan).alias("up"), F.col("line_no").alias("node"), F.sha2(line.cast("binary"), 256).alias("digest"), (F.octet_length(line) + 1).cast("bigint").alias("bytes"), F.lit(1).cast("bigint").alias("n"))
    levels = []
    while True:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"])
        level = rows.groupBy(F.floor("up").cast("bigint").alias("node")).agg(F.sha2(F.concat_ws("", parts).cast("binary"), 256).alias("digest"), F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
        levels.append(staged(level, name))
        if levels[-1].agg(F.coalesce(F.max("node"), F.lit(0))).first()[0] == 0:
            return levels
        rows = levels[-1].select((F.col("node") / fan).alias("up"), "node", "digest", "bytes", "n")


def digest_of_leaves(leaves: DataFrame) -> str | None:
    """The digest of a log's leaf digests in order, one leaf's own; null if there is none. One task reads the sorted
    digests (64 bytes for a block of lines) as they come and holds none of them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, whole = 0, None, hashlib.sha256()
        for batch in batches:
            for x in batch.column("digest").to_pylist():
                n, first = n + 1, first or x
                whole.update(x.encode())
        yield pa.RecordBatch.from_pydict({"digest": pa.array([whole.hexdigest() if n > 1 else first], pa.string())})

    row = leaves.select("node", "digest").repartition(1).sortWithinPartitions("node").select("digest").mapInArrow(digest, "digest string").first()
    return row[0] if row else None


def log_diff(expected: DataFrame, observed: DataFrame, head_bytes: int = 4096, fan: int = FAN, two_levels: bool = False) -> DataFrame:
    """One row on two versions of an append-only log (line_no from 0 without gaps, line): lengths in bytes and digests of
    the whole (null if empty), the byte offset of the first difference (null if equal), the number of different lines
    and whether the first lies in the head.

    Both sides become trees of digests; two_levels: the digest of the whole is that of the leaves' digests, however many
    there are (`digest_of_leaves`), else the tree's root. The first difference is found by descending to the first child that differs,
    with the bytes of the children before it; only lines of blocks that differ are compared. A null line counts as empty.
    """
    e, o = digest_tree(expected, "expected", fan), digest_tree(observed, "observed", fan)
    top = max(len(e), len(o)) - 1
    root = lambda tree: tree[-1].agg(F.max("digest"), F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    (e_digest, e_bytes, e_lines), (o_digest, o_bytes, o_lines) = root(e), root(o)
    first, different = None, 0
    if e_digest != o_digest or len(e) != len(o):
        node, first = 0, 0  # levels above a tree's root have one node, on the way to every leaf
        for depth in range(top, -1, -1):
            if depth >= min(len(e), len(o)):  # one tree is lower: it ends under the other's first node
                continue
            a, b = (tree[depth].filter(F.floor(F.col("node") / fan) == node) for tree in (e, o))
            both = a.select("node", F.col("digest").alias("x"), F.col("bytes").alias("size")).join(b.select("node", F.col("digest").alias("y"), F.col("bytes").alias("other")), "node", "full_outer")
            rows = both.orderBy("node").collect()  # fan at most
            node = next(r["node"] for r in rows if r["x"] != r["y"])
            first += sum(r["size"] for r in rows if r["node"] < node)
        line = F.coalesce("line", F.lit(""))
        block = lambda df, blocks: df.withColumn("block", F.floor(F.col("line_no") / fan).cast("bigint")).join(blocks, "block", "left_semi").select("line_no", line.alias("line"))
        wrong = e[0].select("node", F.col("digest").alias("x")).join(o[0].select("node", F.col("digest").alias("y")), "node", "full_outer").filter(~F.col("x").eqNullSafe(F.col("y"))).select(F.col("node").alias("block"))
        pairs = block(expected, wrong).withColumnRenamed("line", "a").join(block(observed, wrong).withColumnRenamed("line", "b"), "line_no", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        different = pairs.count()
        r = pairs.orderBy("line_no").first()
        before = expected if r["a"] is not None else observed
        inside = before.filter((F.col("line_no") >= node * fan) & (F.col("line_no") < r["line_no"]))
        first += inside.agg(F.coalesce(F.sum(F.octet_length(line) + 1), F.lit(0))).first()[0]
        if r["a"] is not None and r["b"] is not None:
            x, y = r["a"].encode(), r["b"].encode()
            first += next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
    if two_levels:
        e_digest, o_digest = digest_of_leaves(e[0]), digest_of_leaves(o[0])
    row = (e_bytes, o_bytes, e_digest, o_digest, first, different, first is not None and first < head_bytes)
    return expected.sparkSession.createDataFrame([row], "expected_bytes bigint, observed_bytes bigint, expected_digest string, observed_digest string, first_difference bigint, different_lines bigint, in_head boolean")
