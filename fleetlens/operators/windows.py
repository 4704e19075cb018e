"""Per-process windows anchored at a process's first event, de-duplication, and what closes windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.ordering import as_of, running_sums
from fleetlens.schemas import process_key, window_key

NS = 1_000_000_000
#: Columns that must agree for two opens to be one; those that the table lacks are passed over.
IDENTITY = ("ppid", "syscall_type", "filename", "ip_address", "port", "child_pid", "open_flags", "syscall_result", "process_name", "binary_path", "cgroup", "uid", "ancestry_chain", "ancestry_truncated")


def lifetimes(events: DataFrame, exits: DataFrame | None) -> DataFrame:
    """Adds lifetime: how many exits of the pid came before the event. exits: process key, exit_ns."""
    if exits is None:
        return events.withColumn("lifetime", F.lit(0).cast("bigint"))
    marks = exits.select(*process_key(events), F.col("exit_ns").alias("at"))
    return as_of(events, marks, process_key(events), "ended", strict=True).withColumn("lifetime", F.coalesce(F.size("ended"), F.lit(0)).cast("bigint")).drop("ended")


def window_anchored(events: DataFrame, window_s: int = 30, exits: DataFrame | None = None) -> DataFrame:
    """Adds lifetime, window_start_ns and window_end_ns: half-open windows of window_s from the first event on.

    The first event of each lifetime is a pre-aggregated minimum joined back, so a busy pid is never sorted whole.
    """
    if window_s <= 0:
        raise ValueError("window_s must be positive")
    rows, size = lifetimes(events, exits), window_s * NS
    key = [*process_key(events), "lifetime"]
    first = rows.groupBy(*key).agg(F.min("timestamp_ns").alias("first_ns"))
    index = F.expr(f"(timestamp_ns - first_ns) div {size}L")  # a double would be wrong beyond 2 ** 53 ns
    placed = rows.join(first, key).withColumn("window_start_ns", F.col("first_ns") + index * size)
    return placed.withColumn("window_end_ns", F.col("window_start_ns") + size).drop("first_ns")


def window_short_lived(events: DataFrame, exits: DataFrame, window_s: int = 30) -> DataFrame:
    """window_anchored with exits; a lifetime's last window ends at its exit if that comes earlier, as short_lived."""
    rows = window_anchored(events, window_s, exits)
    key = process_key(events)
    order = Window.partitionBy(*key).orderBy("exit_ns")
    ends = exits.select(*key, "exit_ns", (F.row_number().over(order) - 1).cast("bigint").alias("lifetime"))
    last = rows.groupBy(*key, "lifetime").agg(F.max("window_start_ns").alias("last_start"))
    closing = last.join(ends, [*key, "lifetime"]).select(*key, "lifetime", F.col("last_start").alias("window_start_ns"), "exit_ns")
    joined = rows.join(closing, [*key, "lifetime", "window_start_ns"], "left")
    early = F.col("exit_ns").isNotNull() & (F.col("exit_ns") < F.col("window_end_ns"))
    return joined.withColumns(
        {"window_end_ns": F.when(early, F.greatest("exit_ns", "window_start_ns")).otherwise(F.col("window_end_ns")), "short_lived": F.coalesce(early, F.lit(False))}
    ).drop("exit_ns")


def window_flush(windows: DataFrame, as_of_ns: int) -> DataFrame:
    """Windows that are over at as_of_ns."""
    return windows.filter(F.col("window_end_ns") <= as_of_ns)


def window_reconfigure(events: DataFrame, settings: DataFrame) -> DataFrame:
    """Windows whose settings may change: settings (effective_ns, window_s and, if given, dedup_ms; one row at least)
    hold from the next window on. Adds window_start_ns, window_end_ns and, with dedup_ms, dedup_ns: the width of
    de-duplication that the window was born with, which `dedup_openat` and the features take from there.

    The settings are few by nature (one row per change of configuration) and collected; more than 10,000 are an error.
    Under one setting a process's windows tile time from the end of the window that was open when the setting came
    (from the process's first event at the start). That end follows from the process's last event under each earlier
    setting, so a fold over a few rows per process finds all anchors, and events are joined to them.
    """
    widths = "dedup_ms" in settings.columns
    changes = settings.select("effective_ns", "window_s", *(["dedup_ms"] if widths else [])).orderBy("effective_ns").limit(10_001).collect()
    if not changes or len(changes) > 10_000:
        raise ValueError("settings must have between 1 and 10,000 rows")
    numbers = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    at, sizes, key = numbers(r[0] for r in changes), numbers(r[1] * NS for r in changes), process_key(events)
    width = numbers(dedup_width(r[2]) if widths else 0 for r in changes)
    ts = F.col("timestamp_ns")
    rows = events.withColumn("setting", F.greatest(F.size(F.filter(at, lambda a: a <= ts)) - 1, F.lit(0)))
    spans = rows.groupBy(*key, "setting").agg(F.min("timestamp_ns").alias("first"), F.max("timestamp_ns").alias("last"))
    lists = spans.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("setting", "first", "last"))).alias("spans"))
    steps = lambda t, end, step: ((t - end) - (t - end) % step)
    nothing = F.lit(None).cast("bigint")

    def fold(acc: Column, span: Column) -> Column:
        end, step = F.coalesce(acc["end"], span["first"]), F.get(sizes, span["setting"])
        moved = span["last"] >= end
        start = F.when(moved, end + steps(span["last"], end, step)).otherwise(acc["start"])
        kept = F.array_append(acc["kept"], F.struct(span["setting"].alias("setting"), acc["start"].alias("open_start"), end.alias("open_end"), acc["born"].alias("open_born")))
        return F.struct(start.alias("start"), F.when(moved, start + step).otherwise(end).alias("end"), F.when(moved, span["setting"]).otherwise(acc["born"]).alias("born"), kept.alias("kept"))

    none = F.array().cast("array<struct<setting: int, open_start: bigint, open_end: bigint, open_born: int>>")
    zero = F.struct(nothing.alias("start"), nothing.alias("end"), F.lit(None).cast("int").alias("born"), none.alias("kept"))
    anchors = lists.select(*key, F.inline(F.aggregate("spans", zero, fold)["kept"]))
    placed, step = rows.join(anchors, [*key, "setting"]), F.get(sizes, F.col("setting"))
    fresh = ts >= F.col("open_end")
    start = F.when(fresh, F.col("open_end") + steps(ts, F.col("open_end"), step)).otherwise(F.col("open_start"))
    out = placed.withColumn("window_start_ns", start).withColumn("window_end_ns", F.when(fresh, F.col("window_start_ns") + step).otherwise(F.col("open_end")))
    out = out.withColumn("dedup_ns", F.get(width, F.when(fresh, F.col("setting")).otherwise(F.col("open_born"))))
    return out.select(*events.columns, "window_start_ns", "window_end_ns", *(["dedup_ns"] if widths else []))


def active_windows(windows: DataFrame, cap: int) -> DataFrame:
    """ts_ns, open: how many windows are open from each change on, and over_cap. windows: one row each, with start and end.

    Two levels of running sums: by range of time, then within it, so no task sorts all changes.
    """
    if cap < 1:
        raise ValueError("cap must be 1 at least")
    ends = windows.select(F.explode(F.array(F.struct(F.col("window_start_ns").alias("ts_ns"), F.lit(1).alias("d")), F.struct(F.col("window_end_ns").alias("ts_ns"), F.lit(-1).alias("d")))).alias("e")).select("e.*")
    steps = ends.groupBy("ts_ns").agg(F.sum("d").alias("d"))
    open_ = running_sums(steps, ["ts_ns"], "active", d=F.col("d")).select("ts_ns", F.col("d").cast("bigint").alias("open"))
    return open_.withColumn("over_cap", F.col("open") > cap)


def peak_windows(active: DataFrame) -> DataFrame:
    """One row: the most windows open at once and since when first, from `active_windows`; null if there are none."""
    return active.agg(F.max("open").alias("peak"), F.max_by("ts_ns", F.struct("open", -F.col("ts_ns"))).alias("since_ns"))


def dedup_width(dedup_ms: float) -> int:
    width = int(dedup_ms * 1_000_000)
    if width < 1:
        raise ValueError("dedup_ms must be 1 ns at least")
    return width


def width_of(windowed: DataFrame, dedup_ms: float) -> Column:
    """The width of de-duplication in nanoseconds: the window's own (dedup_ns), where it has one."""
    width = F.lit(dedup_width(dedup_ms))
    return F.coalesce("dedup_ns", width) if "dedup_ns" in windowed.columns else width


def dedup_openat(windowed: DataFrame, dedup_ms: float = 100, ordered: bool = True) -> DataFrame:
    """Collapses repeated opens of one file inside a window; repeat_count adds up, the first row stays. The width is the
    window's own where rows have dedup_ns.

    ordered: rows in (timestamp_ns, event_id) order. Otherwise arrival order (event_id), in which a row that is older
    than one before it in the window never merges. Gaps and islands by window functions: a row is held against the row
    before it of the same run of opens and the same identity, which is the last of that record.
    """
    width, key, rows = width_of(windowed, dedup_ms), window_key(windowed), windowed
    if "repeat_count" not in rows.columns:
        rows = rows.withColumn("repeat_count", F.lit(1).cast("bigint"))
    same = [c for c in IDENTITY if c in rows.columns]
    rows = rows.withColumn("repeat_count", F.greatest("repeat_count", F.lit(1)).cast("bigint"))
    candidate = (F.col("syscall_type") == "Openat") & F.col("filename").isNotNull()
    order, ts = ["timestamp_ns", "event_id"] if ordered else ["event_id"], F.col("timestamp_ns")
    in_order = Window.partitionBy(*key).orderBy(*order)
    run = F.sum(F.when(F.col("syscall_type") == "Openat", 0).otherwise(1)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    older = F.lit(False) if ordered else F.coalesce(ts < F.max(ts).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    rows = rows.withColumns({"run": run, "older": older})
    alike = [*key, "run", *same, "alone"]
    rows = rows.withColumn("alone", F.when(candidate, F.lit(-1)).otherwise(F.col("event_id")))
    like = Window.partitionBy(*alike).orderBy(*order)
    rows = rows.withColumn("fresh", (F.col("older") | F.coalesce(ts - F.lag(ts).over(like) >= width, F.lit(True))).cast("int"))
    rows = rows.withColumn("record", F.sum("fresh").over(like.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.sum("repeat_count").over(Window.partitionBy(*alike, "record"))
    return rows.withColumn("repeat_count", total).filter("fresh = 1").drop("run", "older", "alone", "fresh", "record")
