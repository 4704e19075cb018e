"""The behaviour vector of each window: one grouped aggregation, with grams, entropy and timing joined on the window key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.scalars import sensitive_dir, write_intent_flags
from fleetlens.operators.windows import IDENTITY, width_of
from fleetlens.schemas import SYSCALL_TYPES, window_key


def weight() -> Column:
    return F.greatest(F.coalesce(F.col("repeat_count"), F.lit(1)), F.lit(1)).cast("bigint")


def with_weight(windowed: DataFrame) -> DataFrame:
    return windowed if "repeat_count" in windowed.columns else windowed.withColumn("repeat_count", F.lit(1).cast("bigint"))


def _sum_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, weight())), F.lit(0)).cast("bigint")


def _counted(column: str) -> Column:
    return F.count_distinct(column).cast("bigint")


def _sensitive(writes: bool) -> Column:
    intent = write_intent_flags(F.col("open_flags"))
    return sensitive_dir(F.col("filename")).isNotNull() & (intent if writes else ~intent)


def _wrote(place: str) -> Column:
    hit = write_intent_flags(F.col("open_flags")) & (sensitive_dir(F.col("filename")) == place)
    return F.coalesce(F.bool_or(hit), F.lit(False))


#: Plain aggregates of a window; each f_* function below is one or a few of them.
AGGREGATES = {
    "total_syscalls": lambda: F.sum(weight()).cast("bigint"),
    **{f"{t.lower()}_count": (lambda t=t: _sum_if(F.col("syscall_type") == t)) for t in SYSCALL_TYPES},
    "failed_syscall_count": lambda: _sum_if(F.col("syscall_result") < 0),
    "unique_files": lambda: _counted("filename"),
    "unique_ips": lambda: _counted("ip_address"),
    "distinct_ports": lambda: _counted("port"),
    "outbound_connection_count": lambda: _sum_if(F.col("ip_address").isNotNull()),
    "loopback_connection_count": lambda: _sum_if(F.col("ip_address").startswith("127.")),
    "child_spawn_count": lambda: _sum_if((F.col("syscall_type") == "Clone") & F.col("child_pid").isNotNull()),
    "read_sensitive_file_count": lambda: _sum_if(_sensitive(False)),
    "write_sensitive_file_count": lambda: _sum_if(_sensitive(True)),
    "wrote_etc": lambda: _wrote("etc"),
    "wrote_tmp": lambda: _wrote("tmp"),
    "wrote_dev": lambda: _wrote("dev"),
}


#: The distinct counts as sizes of sets: no expansion of the rows.
DISTINCT = {n: (lambda c=c: F.size(F.collect_set(c)).cast("bigint")) for n, c in (("unique_files", "filename"), ("unique_ips", "ip_address"), ("distinct_ports", "port"))}


def aggregated(windowed: DataFrame, *names: str) -> DataFrame:
    """The named aggregates of each window (all if none is named)."""
    return with_weight(windowed).groupBy(*window_key(windowed), "window_end_ns").agg(*[AGGREGATES[n]().alias(n) for n in names or AGGREGATES])


def f_total(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "total_syscalls")


def f_type_counts(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, *[f"{t.lower()}_count" for t in SYSCALL_TYPES])


def _ratio(count: str) -> Column:
    return F.when(F.col("total_syscalls") > 0, F.col(count) / F.col("total_syscalls")).otherwise(0.0)


def f_type_ratios(windowed: DataFrame) -> DataFrame:
    counts = aggregated(windowed, "total_syscalls", *[f"{t.lower()}_count" for t in SYSCALL_TYPES])
    return counts.select(*window_key(windowed), *[_ratio(f"{t.lower()}_count").alias(f"{t.lower()}_ratio") for t in SYSCALL_TYPES])


def f_failed(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "failed_syscall_count")


def f_unique_files(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "unique_files")


def f_unique_ips(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "unique_ips")


def f_ports(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "distinct_ports")


def f_outbound(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "outbound_connection_count")


def f_loopback(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "loopback_connection_count")


def f_children(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "child_spawn_count")


def f_sensitive(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "read_sensitive_file_count", "write_sensitive_file_count")


def f_wrote(windowed: DataFrame) -> DataFrame:
    return aggregated(windowed, "wrote_etc", "wrote_tmp", "wrote_dev")


def f_path_entropy(windowed: DataFrame) -> DataFrame:
    """path_entropy in nats over file names; windows without a file name have no row here and 0 in the vector.
    Two sums instead of shares: H = ln(N) - sum(n ln n) / N."""
    key = window_key(windowed)
    per_file = with_weight(windowed).filter("filename is not null").groupBy(*key, "filename").agg(F.sum(weight()).alias("n"))
    sums = per_file.groupBy(*key).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.ln("n")).alias("part"))
    return sums.select(*key, F.greatest(F.ln("total") - F.col("part") / F.col("total"), F.lit(0.0)).alias("path_entropy"))


def f_timing(records: DataFrame) -> DataFrame:
    """Gaps between consecutive de-duplicated records; all 0 with fewer than two."""
    key = window_key(records)
    gap = F.col("timestamp_ns") - F.lag("timestamp_ns").over(Window.partitionBy(*key).orderBy("timestamp_ns", "event_id"))
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    parts = {"avg": F.avg("gap"), "min": F.min("gap"), "max": F.max("gap"), "stddev": F.stddev_pop("gap")}
    return records.withColumn("gap", gap).groupBy(*key).agg(*[zero(c).alias(f"{n}_inter_syscall_time_ns") for n, c in parts.items()])


def grams(windowed: DataFrame, n: int) -> DataFrame:
    """gram, count and freq in long form: runs of n syscall types in (timestamp_ns, event_id) order.

    Repeats count as that many events. A record repeated r times is r equal types in a row, so it stands for at
    most n of them in any gram that leaves it; inner grams of one type alone are added by count.
    """
    if n < 2:
        raise ValueError("n must be 2 at least")
    key, rows = window_key(windowed), with_weight(windowed)
    spread = rows.withColumn("inside", F.greatest(weight() - n, F.lit(0))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(weight(), F.lit(n)))))
    w = Window.partitionBy(*key).orderBy("timestamp_ns", "event_id", "copy")
    following = [F.col("syscall_type"), *[F.lead("syscall_type", k).over(w) for k in range(1, n)]]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() for c in following])
    runs = spread.withColumn("gram", F.when(whole, F.concat_ws("->", *following))).filter("gram is not null").select(*key, "gram", F.lit(1).cast("bigint").alias("c"))
    inner = rows.filter(weight() > n).select(*key, F.array_join(F.array_repeat("syscall_type", n), "->").alias("gram"), (weight() - n).alias("c"))
    counts = runs.unionByName(inner).groupBy(*key, "gram").agg(F.sum("c").alias("count"))
    totals = counts.groupBy(*key).agg(F.sum("count").alias("total"))
    return counts.join(totals, key).withColumn("freq", F.col("count") / F.col("total")).drop("total")


def _gram_map(windowed: DataFrame, n: int, name: str) -> DataFrame:
    return grams(windowed, n).groupBy(*window_key(windowed)).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("gram", "freq")))).alias(name))


def f_bigrams(windowed: DataFrame) -> DataFrame:
    return _gram_map(windowed, 2, "bigrams")


def f_trigrams(windowed: DataFrame) -> DataFrame:
    return _gram_map(windowed, 3, "trigrams")


def f_duration(windows: DataFrame) -> DataFrame:
    return windows.withColumn("window_duration_ns", F.col("window_end_ns") - F.col("window_start_ns"))


def f_rate(windows: DataFrame) -> DataFrame:
    """events_per_second from total_syscalls and window_duration_ns."""
    seconds = F.greatest(F.col("window_duration_ns") / 1e9, F.lit(1e-9))
    return windows.withColumn("events_per_second", F.when(F.col("total_syscalls") > 0, F.col("total_syscalls") / seconds).otherwise(0.0))


def f_short_lived(windowed: DataFrame) -> DataFrame:
    flag = F.bool_or("short_lived") if "short_lived" in windowed.columns else F.lit(False)
    return windowed.groupBy(*window_key(windowed)).agg(flag.alias("short_lived"))


def spaced(rows: DataFrame, dedup_ms: float = 100) -> DataFrame:
    """Adds gap (time since the record before, null for repeats of a record and a window's first) and file_n (weight of
    the file name in the window), on one exchange by window key.

    Three sorts within it: by time (runs of opens), by file name and what else makes records alike (repeats; the count
    of the file name uses the same order), by time again (gaps).
    """
    key, width = window_key(rows), width_of(rows, dedup_ms)
    by_time = Window.partitionBy(*key).orderBy("timestamp_ns", "event_id")
    opens = F.col("syscall_type") == "Openat"
    out = rows.withColumn("run", F.sum(F.when(opens, 0).otherwise(1)).over(by_time.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("alone", F.when(opens & F.col("filename").isNotNull(), F.lit(-1)).otherwise(F.col("event_id")))
    same = [c for c in IDENTITY if c in rows.columns and c != "filename"]
    like = Window.partitionBy(*key, "filename", "run", *same, "alone").orderBy("timestamp_ns", "event_id")
    fresh = F.coalesce(F.col("timestamp_ns") - F.lag("timestamp_ns").over(like) >= width, F.lit(True))
    out = out.withColumn("fresh", fresh).withColumn("file_n", F.sum(weight()).over(Window.partitionBy(*key, "filename")))
    before = F.last(F.when(F.col("fresh"), F.col("timestamp_ns")), ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("gap", F.when(F.col("fresh"), F.col("timestamp_ns") - before)).drop("run", "alone", "fresh")


def features_all(windowed: DataFrame, dedup_ms: float = 100, maps: bool = True, identity: bool = False) -> DataFrame:
    """The whole vector of each window, from events with window columns (not yet de-duplicated).

    One exchange by window key serves all scalars: `spaced`, then one aggregate. Distinct values are sets of a window.
    maps adds the grams. identity adds the window's latest process_name, binary_path and ancestry_chain, where events
    have them, as `window_identity` does.
    """
    key, rows = window_key(windowed), with_weight(windowed)
    flag = F.bool_or("short_lived") if "short_lived" in rows.columns else F.lit(False)
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    timing = {"avg": F.avg("gap"), "min": F.min("gap"), "max": F.max("gap"), "stddev": F.stddev_pop("gap")}
    named = F.col("filename").isNotNull()
    total, part = F.sum(F.when(named, weight())), F.sum(F.when(named, weight() * F.ln("file_n")))
    entropy = F.coalesce(F.greatest(F.ln(total) - part / total, F.lit(0.0)), F.lit(0.0))
    at = F.struct("timestamp_ns", "event_id")
    known = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in ("process_name", "binary_path", "ancestry_chain") if identity and c in rows.columns]
    out = spaced(rows, dedup_ms).groupBy(*key).agg(
        F.max("window_end_ns").alias("window_end_ns"), flag.alias("short_lived"), *[a().alias(n) for n, a in (AGGREGATES | DISTINCT).items()],
        entropy.alias("path_entropy"), *[zero(c).alias(f"{n}_inter_syscall_time_ns") for n, c in timing.items()], *known,
    )
    out = f_rate(f_duration(out.withColumns({f"{t.lower()}_ratio": _ratio(f"{t.lower()}_count") for t in SYSCALL_TYPES})))
    if maps:
        empty = F.create_map().cast("map<string,double>")
        out = out.join(f_bigrams(rows), key, "left").join(f_trigrams(rows), key, "left")
        out = out.withColumns({m: F.coalesce(m, empty) for m in ("bigrams", "trigrams")})
    return out
