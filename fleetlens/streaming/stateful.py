"""Stateful operators: pairing of phases and anchored windows, with event-time timers.

Rows wait in state until the watermark passes them and then go on in order of time, so what comes out doesn't depend on
the order of arrival within the watermark's delay: it is what the batch operators give on the same rows. Spark's own
filter of late rows would lose rows; it is left out (the operators don't see the watermark's column), and a row that
comes behind the watermark comes out at once, marked late (`late_events`, `on_time`). All state of a process goes
after its exit or a time of silence.

State is kept by group: the processes whose key's hash is equal modulo `GROUPS`. Rows go in and out of it as packed
tables (Arrow, compressed), so that its costs are those of tables, not of rows and keys: a group's rows that wait must
fit a worker's memory, and more groups make them fewer.

They need the RocksDB state store (`use_rocksdb`).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.ingest import PAIRED_TYPES, Calls, begins, with_status
from fleetlens.operators.windows import dedup_width
from fleetlens.schemas import process_key

NS, MS = 1_000_000_000, 1_000_000
EVENT = "event_id bigint, timestamp_ns bigint, syscall_type string, filename string, ip_address string, port int, child_pid bigint, open_flags bigint, syscall_result int"
PHASE = "timestamp_ns bigint, phase string, ppid bigint, filename string, open_flags bigint, ip_address string, port int, child_pid bigint, syscall_result int"
PAIRED = PHASE + ", pair_status string, exit_ns bigint, late boolean"
HEARTBEAT = "Heartbeat"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def with_event_time(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Adds event_time and a watermark on it; nanoseconds stay in timestamp_ns."""
    return events.withColumn("event_time", F.timestamp_micros(F.expr("timestamp_ns div 1000"))).withWatermark("event_time", delay)


def passed_ns(timer_values) -> float:
    """The watermark in nanoseconds. Spark's is 0 before there is one, and never under it: no row is behind that, so
    rows of times before 1970 wait until a later time moves the watermark."""
    return timer_values.getCurrentWatermarkInMs() * MS or float("-inf")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


#: Groups of keys that share their state; a stream's number of groups must not change between its restarts.
GROUPS = 64
#: Rows of a packed table that goes in or out, at most.
PACKED_ROWS = 200_000


def packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def by_group(rows: DataFrame, key: list[str], wanted: Column) -> DataFrame:
    """key_group and packed tables of its rows, from the rows that are wanted; these keep their types."""
    columns = [c for c in rows.columns if c != "key_group"]
    numbered = rows.withColumn("key_group", F.when(wanted, F.pmod(F.xxhash64(*key), F.lit(GROUPS))).cast("int"))

    def parts(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        table = table.filter(pc.is_valid(table["key_group"]))
        table = table.take(pc.sort_indices(table["key_group"]))
        found, at = np.unique(table["key_group"].to_numpy(), return_index=True)
        cuts = [*at.tolist(), table.num_rows]
        tables = [packed(table.slice(a, b - a).select(columns)) for a, b in zip(cuts, cuts[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(tables, pa.binary())], names=["key_group", "packed"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= PACKED_ROWS:
                yield from parts(held)
                held, n = [], 0
        if n:
            yield from parts(held)

    return numbered.mapInArrow(pack, "key_group int, packed binary")


def as_rows(given: DataFrame, schema: T.StructType) -> DataFrame:
    """The rows of packed tables."""
    arrow = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column("packed"):
                yield from unpacked(blob.as_py()).cast(arrow).to_batches()

    return given.mapInArrow(unpack, schema)


class Grouped(StatefulProcessor):
    """Rows of a group of keys, held until the watermark has passed them: state `rows` (packed tables), and `kept`, a
    packed table of what is known of each key. Comes out: packed tables of the schema."""

    def __init__(self, key: list[str], schema: T.StructType) -> None:
        self.key, self.schema, self.passed = key, to_arrow_schema(schema), {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "packed binary")
        self.kept = handle.getValueState("kept", "packed binary")

    def _wake(self, ns: int, mark: int) -> None:
        """A timer for what is due next, unless the group has one by then. Those up to the watermark fire in this batch."""
        at = max(ns // MS + 1, 1)
        if not any(mark < t <= at for t in list(self.handle.listTimers())):
            self.handle.registerTimer(at)

    def _given(self, rows: pa.Table) -> Iterator[pd.DataFrame]:
        """rows as they go out; columns they don't have are null."""
        whole = pa.Table.from_arrays([(rows[f.name] if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type)).cast(f.type) for f in self.schema], schema=self.schema)
        for k in range(0, whole.num_rows, PACKED_ROWS):
            yield pd.DataFrame({"packed": [packed(whole.slice(k, PACKED_ROWS))]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now, mark, fresh, first = passed_ns(timerValues), timerValues.getCurrentWatermarkInMs(), [], None
        for frame in rows:
            for blob in frame["packed"]:
                table = unpacked(blob)
                behind = pc.less(table["timestamp_ns"], int(max(now, -(2**63))))
                if n := pc.sum(behind).as_py() or 0:
                    late, table = table.filter(behind), table.filter(pc.invert(behind))
                    yield from self._given(late.append_column("late", pa.array([True] * n)))
                    blob = packed(table)
                if table.num_rows:
                    fresh.append((blob,))
                    low = pc.min(table["timestamp_ns"]).as_py()
                    first = low if first is None else min(first, low)
        if fresh:
            self.rows.appendList(fresh)
            self._wake(first, mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.passed.get(key) == mark:  # an earlier timer of the group has done all up to the watermark
            return
        self.passed[key] = mark
        tables = [unpacked(blob) for (blob,) in self.rows.get()]
        kept = unpacked(self.kept.get()[0]).to_pylist() if self.kept.exists() else []
        rows = self.in_order(pa.concat_tables(tables)) if tables else None
        tables.clear()  # a group may be large: no second copy of it
        at, left, known, due = self.go_on(rows, {tuple(r[c] for c in self.key): r for r in kept}, passed_ns(timerValues))
        if rows is not None:
            self.rows.clear()
        if left:
            self.rows.put([(packed(rows.take(pa.array(left[k : k + PACKED_ROWS], pa.int64()))),) for k in range(0, len(left), PACKED_ROWS)])
        if known:
            self.kept.update((packed(pa.Table.from_pylist(known, schema=self.known)),))
        else:
            self.kept.clear()
        if due is not None:
            self._wake(due, mark)
        for k in range(0, len(at), PACKED_ROWS):
            out = self.made(rows, at[k : k + PACKED_ROWS])
            yield from self._given(out.append_column("late", pa.array(np.zeros(out.num_rows, bool))))

    def in_order(self, rows: pa.Table) -> pa.Table:
        """rows by key and time."""
        raise NotImplementedError

    def go_on(self, rows: pa.Table | None, known: dict[tuple, dict], now: float) -> tuple[list[tuple], list[int], list[dict], int | None]:
        """What comes out (as `made` takes it), the numbers of the rows that stay, what is known of each key, and when
        (ns) something is due next."""
        raise NotImplementedError

    def made(self, rows: pa.Table, out: list[tuple]) -> pa.Table:
        raise NotImplementedError

    def close(self) -> None:
        pass


def _sorted(rows: pa.Table, *by: str) -> pa.Table:
    """Nulls first, as in Spark."""
    return rows.take(pc.sort_indices(rows, [(c, "ascending") for c in by], null_placement="at_start"))


class Pairing(Grouped):
    """First in, first out pairing of enter and exit phases per (process, tid, type). Rows that stay are those that the
    watermark hasn't passed and those that wait for their other phase; known are the two counts of `Calls`."""

    def __init__(self, timeout_ms: int, key: list[str], rows: T.StructType, schema: T.StructType) -> None:
        super().__init__(key, schema)
        self.timeout_ns = timeout_ms * MS
        self.known = pa.schema([*[to_arrow_schema(rows).field(c) for c in key], ("lost_enters", pa.int64()), ("lost_exits", pa.int64())])

    def in_order(self, rows):
        return _sorted(rows, *self.key, "timestamp_ns", "phase", "syscall_result")

    def made(self, rows, out):
        return with_status(rows, out)

    def go_on(self, rows, known, now):
        if rows is None:  # the timer of a call that has been paired since
            return [], [], list(known.values()), None
        times, enter = rows["timestamp_ns"].to_numpy().tolist(), pc.equal(rows["phase"], "enter").to_pylist()
        cuts = [*np.flatnonzero(begins(rows, self.key)).tolist(), len(times)]
        keys = rows.select(self.key).take(pa.array(cuts[:-1], pa.int64())).to_pylist()
        out, stay, due = [], [], []
        for a, b, key in zip(cuts, cuts[1:], keys, strict=False):
            lost = known.pop(tuple(key.values()), {"lost_enters": 0, "lost_exits": 0})
            calls = Calls(self.timeout_ns, lost["lost_enters"], lost["lost_exits"])
            calls.out = out
            end = bisect_left(times, now, a, b)
            for i in range(a, end):
                calls.push(times[i], enter[i], i)
            calls.expire(now)
            waits = calls.waiting()
            stay += [*waits, *range(end, b)]
            due += [*[times[i] + self.timeout_ns for i in waits[:1]], *times[end : min(end + 1, b)]]
            if calls.lost_enters or calls.lost_exits:
                known[tuple(key.values())] = key | {"lost_enters": calls.lost_enters, "lost_exits": calls.lost_exits}
        return out, stay, list(known.values()), min(due, default=None)


def unfiltered(events: DataFrame) -> DataFrame:
    """events without the watermark's column: timers follow the watermark, but no row is lost for being behind it."""
    return events.drop("event_time")


def _fields(df: DataFrame, columns: list[str], *more: str) -> T.StructType:
    """The schema of some columns of df and of more ("name type")."""
    return T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in columns], *T.StructType.fromDDL(", ".join(more)).fields])


def pair_stream(decoded: DataFrame, timeout_ms: int = 250) -> DataFrame:
    """Pairs a stream of phases of Openat and Connect (with event_time and watermark); same columns and statuses as
    `pair_enter_exit` in mode stateful, and late: rows behind the watermark, not paired. Other types are ignored."""
    two = unfiltered(decoded)
    key = [*process_key(two), "tid", "syscall_type"]
    rows = two.select(*key, *[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in PHASE.split(", "))])
    schema = _fields(rows, rows.columns, "pair_status string", "exit_ns bigint", "late boolean")
    groups = by_group(rows, key, F.col("syscall_type").isin(*PAIRED_TYPES))  # a filter before would take heartbeats from the watermark
    got = groups.groupBy("key_group").transformWithStateInPandas(statefulProcessor=Pairing(timeout_ms, key, rows.schema, schema), outputStructType="packed binary", outputMode="Append", timeMode="EventTime")
    return as_rows(got, schema)


class Windows(Grouped):
    """Anchored windows of processes. Rows that stay are in no closed window yet; known are a process's open window's
    start and end, its width of de-duplication, its lifetime, which is the time of the lifetime's first event, and its
    last event.

    Windows close when the watermark passes their end; until then an earlier first event moves the anchor back. A new
    window takes the settings that hold at the event that opens it. An exit row (syscall_type Exit) closes its window
    early and drops the anchor. All state goes with it, or idle_s after the last event: then the process anchors anew.
    """

    def __init__(self, settings: list[tuple[int, int, int]], idle_ns: int, key: list[str], rows: T.StructType, schema: T.StructType) -> None:
        super().__init__(key, schema)
        self.settings, self.idle_ns = sorted(settings), idle_ns
        self.known = pa.schema([*[to_arrow_schema(rows).field(c) for c in key], *[(n, pa.int64()) for n in ("start", "end", "lifetime", "width", "last")]])

    def _settings(self, ts: int) -> tuple[int, int]:
        """(length, de-duplication width) in nanoseconds at a time."""
        return [(size * NS, width) for at, size, width in self.settings if at <= ts or at == self.settings[0][0]][-1]

    def in_order(self, rows):
        rows = rows.append_column("is_exit", pc.fill_null(pc.equal(rows["syscall_type"], "Exit"), False))
        return _sorted(rows, *self.key, "timestamp_ns", "is_exit", "event_id").drop_columns("is_exit")

    def made(self, rows, out):
        at, facts = zip(*out, strict=True)
        got = rows.take(pa.array(at, pa.int64()))
        for name, values in zip(("lifetime", "window_start_ns", "window_end_ns", "dedup_ns", "short_lived"), zip(*facts, strict=True), strict=True):
            got = got.append_column(name, pa.array(values))
        return got

    def go_on(self, rows, known, now):
        out, stay, due, left = [], [], [], []
        if rows is not None:
            times, exits = rows["timestamp_ns"].to_numpy().tolist(), pc.equal(rows["syscall_type"], "Exit").to_pylist()
            cuts = [*np.flatnonzero(begins(rows, self.key)).tolist(), len(times)]
            keys = rows.select(self.key).take(pa.array(cuts[:-1], pa.int64())).to_pylist()
            for a, b, key in zip(cuts, cuts[1:], keys, strict=False):
                was = known.pop(tuple(key.values()), None)
                start, end, life, width, last = (was[c] for c in ("start", "end", "lifetime", "width", "last")) if was else (None,) * 5
                ahead, inside = bisect_left(times, now, a, b), []

                def close(until: int, early: bool, inside=inside) -> None:
                    facts = (life, start, until, width, early)  # noqa: B023
                    out.extend((i, facts) for i in inside)
                    inside.clear()

                for i in range(a, ahead):
                    ts = last = times[i]
                    if exits[i]:
                        if start is not None:
                            close(max(ts, start) if ts < end else end, ts < end)
                        start = end = life = width = last = None
                        continue
                    if end is None:
                        (size, width), start, life = self._settings(ts), ts, ts
                        end = ts + size
                    elif ts >= end:
                        close(end, False)
                        size, width = self._settings(ts)
                        start = end + (ts - end) // size * size
                        end = start + size
                    inside.append(i)
                if end is not None and end <= now:
                    close(end, False)
                waits = [*inside, *range(ahead, b)]
                stay += waits
                due += times[ahead : min(ahead + 1, b)]
                if end is not None and (waits or last + self.idle_ns > now):
                    left.append(key | {"start": start, "end": end, "lifetime": life, "width": width, "last": last})
                    due += [end] if inside else [] if waits else [last + self.idle_ns]
        silent = [r for r in known.values() if r["last"] + self.idle_ns > now]
        due += [r["last"] + self.idle_ns for r in silent]
        return out, stay, left + silent, min(due, default=None)


def window_stream(events: DataFrame, window_s: int = 30, changes: list[tuple] | None = None, dedup_ms: float = 100, idle_s: int = 86_400) -> DataFrame:
    """Events of closed windows, with lifetime, window_start_ns, window_end_ns, dedup_ns, short_lived and late: what
    features_all takes, once `on_time` has taken away the rows marked late (these are in no window).

    events: a stream with event_time and watermark; exits are rows of syscall_type Exit. changes: (effective_ns,
    window_s) or (effective_ns, window_s, dedup_ms) after the first settings. A process that is silent for idle_s after
    its last window anchors anew.
    """
    settings = [(at, size, dedup_width(width[0] if width else dedup_ms)) for at, size, *width in [(0, window_s), *(changes or [])]]
    every = unfiltered(events)
    key = process_key(every)
    rows = every.select(*key, *[F.col(n).cast(t).alias(n) for n, t in (x.split() for x in EVENT.split(", "))])
    names = _fields(rows, key, "lifetime bigint", "window_start_ns bigint", "window_end_ns bigint", "dedup_ns bigint", "short_lived boolean", "late boolean")
    schema = T.StructType([*names.fields, *[f for f in rows.schema.fields if f.name not in key]])
    groups = by_group(rows, key, F.coalesce(F.col("syscall_type") != HEARTBEAT, F.lit(True)))
    got = groups.groupBy("key_group").transformWithStateInPandas(statefulProcessor=Windows(settings, idle_s * NS, key, rows.schema, schema), outputStructType="packed binary", outputMode="Append", timeMode="EventTime")
    return as_rows(got, schema)


def with_heartbeats(events: DataFrame, beats: DataFrame) -> DataFrame:
    """events and heartbeats as one stream, before its watermark: a host's clock goes on when its processes are silent.

    beats: timestamp_ns and, where events have one, host_id. Windows ignore them, and they leave no state."""
    kinds = {f.name: f.dataType for f in events.schema}
    given = {"syscall_type": F.lit(HEARTBEAT), "pid": F.lit(-1)}
    return events.unionByName(beats.select(*[(F.col(c) if c in beats.columns else given.get(c, F.lit(None))).cast(t).alias(c) for c, t in kinds.items()]))


def beating(spark: SparkSession, per_second: int = 1) -> DataFrame:
    """A stream of heartbeats (timestamp_ns) at the time of this clock."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load().select((F.unix_micros("timestamp") * 1000).alias("timestamp_ns"))


def late_events(closed: DataFrame) -> DataFrame:
    """The side output of `window_stream` and `pair_stream`: rows that came behind the watermark, as they came."""
    names = _names(EVENT if "event_id" in closed.columns else "tid bigint, syscall_type string, " + PHASE)
    return closed.filter("late").select(*process_key(closed), *names)


def on_time(closed: DataFrame) -> DataFrame:
    """The rows of `window_stream` or `pair_stream` that aren't late."""
    return closed.filter(~F.col("late")).drop("late")
