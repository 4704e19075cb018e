"""Decoding of raw records, clean-up of events, pairing of enter and exit phases."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.pandas.types import to_arrow_schema

from fleetlens.operators.ordering import as_of, numbered, stretches
from fleetlens.schemas import SYSCALL_TYPES, process_key
from fleetlens.storage import new_path, scratch, staged, written

EXIT_BIT, LONGEST_FILENAME = 1 << 31, 256
PAIRED_TYPES = ("Openat", "Connect")
#: What becomes of a call in the fold over a thread.
STATUSES = ("paired", "enter_only", "late_exit")
PAIRED, ENTER_ONLY, LATE_EXIT = range(3)


def _filename_hex() -> Column:
    raw = F.hex(F.substring("filename", 1, LONGEST_FILENAME))
    return F.regexp_extract(F.substring(raw, F.lit(1), 2 * F.col("filename_len")), "^((?:(?!00)..)*)", 1)


def decode_filename(raw: DataFrame) -> DataFrame:
    """file_name (text up to the first NUL; null if empty) and file_reject (filename_length, filename_utf8 or null)."""
    text = F.unhex(_filename_hex()).cast("string")
    valid = F.is_valid_utf8(text)
    reject = F.when(F.col("filename_len") > LONGEST_FILENAME, "filename_length").when(F.coalesce(~valid, F.lit(False)), "filename_utf8")
    name = F.when((F.col("filename_len") > 0) & (F.col("filename_len") <= LONGEST_FILENAME) & valid & (text != ""), text)
    return raw.withColumns({"file_name": name, "file_reject": reject})


def decode_raw(raw: DataFrame) -> DataFrame:
    """One row per record: type, phase and the columns that this type and phase carry; reject_kind is null for good rows."""
    code = F.col("syscall_type").bitwiseAND(F.lit(EXIT_BIT - 1))
    kind = F.element_at(F.array(*map(F.lit, SYSCALL_TYPES)), F.when(code.between(1, 4), code).otherwise(1).cast("int"))
    is_exit = F.shiftright(F.col("syscall_type"), 31).bitwiseAND(F.lit(1)) == 1
    step = decode_filename(raw).withColumns({"kind": F.when(code.between(1, 4), kind), "phase": F.when(is_exit, "exit").otherwise("enter")})
    opens = (F.col("kind") == "Openat") & (F.col("phase") == "enter")
    connects = (F.col("kind") == "Connect") & (F.col("phase") == "enter")
    octets = [F.conv(F.substring(F.hex("ipv4_addr"), 2 * k + 1, 2), 16, 10) for k in range(4)]
    keep = process_key(raw)
    return step.select(
        *keep,
        "tid",
        "ppid",
        F.col("timestamp").alias("timestamp_ns"),
        F.col("kind").alias("syscall_type"),
        "phase",
        F.when(opens, F.col("file_name")).alias("filename"),
        F.when(opens, F.col("open_flags")).alias("open_flags"),
        F.when(connects, F.concat_ws(".", *octets)).alias("ip_address"),
        F.when(connects, F.col("port")).alias("port"),
        F.when((F.col("kind") == "Clone") & (F.col("phase") == "exit") & (F.col("syscall_result") > 0), F.col("syscall_result")).cast("bigint").alias("child_pid"),
        F.when(F.col("phase") == "exit", F.col("syscall_result")).alias("syscall_result"),
        F.when(F.col("kind").isNull(), "unknown_type").when(opens, F.col("file_reject")).alias("reject_kind"),
    )


def reject_report(decoded: DataFrame) -> DataFrame:
    """Number of records by reject kind, accepted ones as `accepted`."""
    return decoded.groupBy(F.coalesce("reject_kind", F.lit("accepted")).alias("kind")).agg(F.count("*").alias("n"))


def pair_enter_exit(decoded: DataFrame, timeout_ms: int = 250, mode: str = "serial", overlapping: bool = True) -> DataFrame:
    """Merges the phases of Openat and Connect calls per (process, tid, type).

    Adds pair_status: paired, enter_only (result null), late_exit (no row for the pipeline, kept for `pair_report`),
    passthrough (Execve enters, Clone exits) and ignored (Execve exits, Clone enters). `emitted` keeps what goes on.
    mode serial: window functions, for threads whose calls of a type don't overlap. mode stateful: first in, first
    out over overlapping calls, with counts of what went out alone (`Calls`), staged; both phases may come in either
    order within the timeout. The two agree where calls don't overlap and no enter is missing. overlapping False: mode
    stateful by the rule of mode serial (`Turns`), which then agree on any rows, with threads cut at pauses.
    """
    if timeout_ms <= 0:
        raise ValueError("timeout_ms must be positive")
    if mode not in ("serial", "stateful"):
        raise ValueError("mode must be serial or stateful")
    rows = decoded.filter("reject_kind is null").drop("reject_kind") if "reject_kind" in decoded.columns else decoded
    two = F.col("syscall_type").isin(*PAIRED_TYPES)
    single = rows.filter(~two).withColumn("pair_status", F.when((F.col("syscall_type") == "Execve") == (F.col("phase") == "enter"), "passthrough").otherwise("ignored"))
    single = single.withColumn("exit_ns", F.lit(None).cast("bigint"))
    timeout = timeout_ms * 1_000_000
    if mode == "serial":
        w = Window.partitionBy(*process_key(rows), "tid", "syscall_type").orderBy("timestamp_ns", F.when(F.col("phase") == "enter", 0).otherwise(1))
        near = lambda c, d: (c("phase") == d) & (F.abs(c("timestamp_ns") - F.col("timestamp_ns")) <= timeout)
        after = lambda name: F.lead(name).over(w)
        before = lambda name: F.lag(name).over(w)
        pairs = rows.filter(two).withColumns(
            {"next_exit": F.coalesce(near(after, "exit"), F.lit(False)), "next_ns": after("timestamp_ns"), "next_result": after("syscall_result"), "prev_enter": F.coalesce(near(before, "enter"), F.lit(False))}
        )
        is_enter = F.col("phase") == "enter"
        status = F.when(is_enter & F.col("next_exit"), "paired").when(is_enter, "enter_only").when(F.col("prev_enter"), "merged").otherwise("late_exit")
        out = pairs.withColumn("pair_status", status).filter("pair_status <> 'merged'")
        out = out.withColumns({"exit_ns": F.when(F.col("pair_status") == "paired", F.col("next_ns")), "syscall_result": F.when(F.col("pair_status") == "paired", F.col("next_result")).when(~is_enter, F.col("syscall_result"))})
        out = out.drop("next_exit", "next_ns", "next_result", "prev_enter")
    else:
        out = pair_calls(rows.filter(two), timeout, Calls if overlapping else Turns)
    return out.unionByName(single)


class Calls:
    """First in, first out pairing of one thread's calls of a type, row by row in order of time.

    An enter waits for its exit as long as an exit for its enter. Whatever goes out alone leaves a count behind: an
    enter that went out unpaired takes the next exit that finds no waiting enter with it, an exit that was dropped the
    next enter that finds no waiting exit. So a late result never goes to a newer call. Rows are known by their numbers
    in a table; enters and exits never wait at once, and rows that wait may be pushed again in order.
    """

    def __init__(self, timeout_ns: int, lost_enters: int = 0, lost_exits: int = 0) -> None:
        self.timeout_ns, self.lost_enters, self.lost_exits = timeout_ns, lost_enters, lost_exits
        self.enters, self.exits, self.out = deque(), deque(), []

    def expire(self, now: float) -> None:
        """Lets go what has waited longer than the timeout."""
        while self.enters and now - self.enters[0][0] > self.timeout_ns:
            self.out.append((self.enters.popleft()[1], ENTER_ONLY, None))
            self.lost_enters += 1
        while self.exits and now - self.exits[0][0] > self.timeout_ns:
            self.out.append((self.exits.popleft()[1], LATE_EXIT, None))
            self.lost_exits += 1

    def push(self, ts: int, enter: bool, at: int) -> None:
        self.expire(ts)
        if enter:
            if self.exits:
                self.out.append((at, PAIRED, self.exits.popleft()[1]))
            elif self.lost_exits:
                self.lost_exits -= 1
                self.out.append((at, ENTER_ONLY, None))
            else:
                self.enters.append((ts, at))
        elif self.enters:
            self.out.append((self.enters.popleft()[1], PAIRED, at))
        elif self.lost_enters:
            self.lost_enters -= 1
            self.out.append((at, LATE_EXIT, None))
        else:
            self.exits.append((ts, at))

    def waiting(self) -> list[int]:
        return [at for _, at in (*self.enters, *self.exits)]

    def renumber(self) -> None:
        """What waits stands in a new table, in the order of `waiting` from its first row."""
        self.enters, self.exits = (deque((ts, at) for at, (ts, _) in enumerate(q)) for q in (self.enters, self.exits))


class Turns(Calls):
    """Pairing of calls that take turns: an exit belongs to the row just before it, if that is an enter within the
    timeout. Nothing else waits or is counted."""

    def expire(self, now: float) -> None:
        super().expire(now)
        self.lost_enters = self.lost_exits = 0

    def push(self, ts: int, enter: bool, at: int) -> None:
        self.expire(ts)
        waits = self.enters.popleft()[1] if self.enters else None
        if waits is not None:
            self.out.append((waits, ENTER_ONLY, None) if enter else (waits, PAIRED, at))
        elif not enter:
            self.out.append((at, LATE_EXIT, None))
        if enter:
            self.enters.append((ts, at))


def with_status(rows: pa.Table, out: list[tuple]) -> pa.Table:
    """The rows of what `Calls` gave out, with pair_status and exit_ns."""
    at, status, exits = (pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else ((), (), ())))
    results = pc.if_else(pc.equal(status, PAIRED), exits, pc.if_else(pc.equal(status, LATE_EXIT), at, pa.scalar(None, pa.int64())))
    got = rows.take(at)
    got = got.set_column(got.schema.get_field_index("syscall_result"), "syscall_result", rows["syscall_result"].take(results))
    return got.append_column("exit_ns", rows["timestamp_ns"].take(exits)).append_column("pair_status", pa.array(STATUSES).take(status))


def begins(rows: pa.Table, key: list[str]) -> np.ndarray:
    """For each row whether its key differs from that of the row before; nulls are equal."""
    odd = np.ones(rows.num_rows, bool)
    for k, c in enumerate(key):
        col = rows[c].combine_chunks()
        a, b = col.slice(1), col.slice(0, max(len(col) - 1, 0))
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        odd[1:] = np.asarray(differs) if k == 0 else odd[1:] | np.asarray(differs)
    return odd


def in_time(row: dict) -> tuple:
    """The order of a thread's phases: time, enters first, then what tells equal ones apart."""
    return row["timestamp_ns"], row["phase"], row["syscall_result"] is not None, row["syscall_result"] or 0


def pair_calls(two: DataFrame, timeout_ns: int, rule: type[Calls] = Calls) -> DataFrame:
    """Rows of Openat and Connect with pair_status and exit_ns, staged, by the rule of `Calls`, or of `Turns`.

    A thread's rows are cut into chunks at pauses longer than the timeout, where nothing waits, so that only the two
    counts go from one chunk to the next. All chunks are folded at once, with counts of 0; counts then follow from what
    each chunk adds, and chunks that began with other counts are folded again until none did. A thread that fits one
    chunk is folded once; the first wrong chunk of a thread is right after each turn. A fold reads its chunks in order
    of time, sorted by Spark, and holds the rows that wait, so a chunk may have any length.
    """
    spark, path = two.sparkSession, new_path(two.sparkSession, "pairs")
    key = [*process_key(two), "tid", "syscall_type"]
    spot, counts = [*key, "chunk"], ("in_enters", "in_exits", "out_enters", "out_exits")
    kinds = T.StructType([*[T.StructField(f.name, f.dataType) for f in two.schema], *[T.StructField(n, T.LongType()) for n in ("chunk", "exit_ns", *counts)], T.StructField("pair_status", T.StringType())])
    arrow = to_arrow_schema(kinds)

    def given(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [(rows[f.name] if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type)).cast(f.type) for f in arrow]
        yield from pa.Table.from_arrays(cols, schema=arrow).to_batches()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls, kept = None, None  # kept: rows that wait, and the last row
        for batch in filter(len, batches):
            rows = pa.Table.from_batches([batch])
            rows, past = (rows, 0) if kept is None else (pa.concat_tables([kept, rows]), kept.num_rows)
            first, times, enter, ends = begins(rows, spot).tolist(), rows["timestamp_ns"].to_pylist(), pc.equal(rows["phase"], "enter").to_pylist(), []
            started = [rows[c].to_pylist() for c in ("in_enters", "in_exits")]
            out = []
            if calls is not None:
                calls.out = out
            for i in range(past, len(times)):
                if first[i]:
                    if calls is not None:
                        calls.expire(float("inf"))
                        ends.append((i - 1, calls.lost_enters, calls.lost_exits))
                    calls = rule(timeout_ns, started[0][i], started[1][i])
                    calls.out = out
                calls.push(times[i], enter[i], i)
            yield from given(with_status(rows, out))
            yield from states(rows, ends)
            kept = rows.take(pa.array([*calls.waiting(), len(times) - 1], pa.int64()))
            calls.renumber()
        if calls is not None:
            calls.out = []
            calls.expire(float("inf"))
            yield from given(with_status(kept, calls.out))
            yield from states(kept, [(kept.num_rows - 1, calls.lost_enters, calls.lost_exits)])

    def states(rows: pa.Table, ends: list[tuple]) -> Iterator[pa.RecordBatch]:
        at, enters, exits = (pa.array(x, pa.int64()) for x in (zip(*ends, strict=True) if ends else ((), (), ())))
        got = rows.select([*spot, "in_enters", "in_exits"]).take(at).append_column("out_enters", enters).append_column("out_exits", exits)
        yield from given(got.append_column("pair_status", pa.array(["state"] * len(at), pa.string())))

    with scratch(spark):
        placed = staged(stretches(two, key, timeout_ns, "phases").withColumn("chunk", F.col("chunk").cast("bigint")), "chunks")
        todo, done = placed.withColumns({"in_enters": F.lit(0).cast("bigint"), "in_exits": F.lit(0).cast("bigint")}), None
        while True:
            in_order = todo.repartition(*spot).sortWithinPartitions(*spot, "timestamp_ns", "phase", "syscall_result")
            out = staged(in_order.mapInArrow(fold, kinds), "folded")
            done = out if done is None else done.join(out.filter("pair_status = 'state'").select(*spot), spot, "left_anti").unionByName(out)
            by_chunk = Window.partitionBy(*key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
            added = lambda n: F.greatest(F.coalesce(F.sum(F.col(f"out_{n}") - F.col(f"in_{n}")).over(by_chunk), F.lit(0)), F.lit(0))
            states_now = done.filter("pair_status = 'state'").select(*spot, "in_enters", "in_exits", added("enters").alias("enters"), added("exits").alias("exits"))
            whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in spot])  # other rows keep counts of 0
            wrong = states_now.filter(whole & F.expr("enters <> in_enters or exits <> in_exits")).select(*spot, F.col("enters").alias("in_enters"), F.col("exits").alias("in_exits"))
            wrong = staged(wrong, "wrong")
            if wrong.isEmpty():
                return written(done.filter("pair_status <> 'state'").drop("chunk", *counts), path)
            todo = placed.join(wrong, spot)


def emitted(paired: DataFrame) -> DataFrame:
    """The logical events that go on: one row per call."""
    return paired.filter(F.col("pair_status").isin("paired", "enter_only", "passthrough"))


def pair_report(paired: DataFrame) -> DataFrame:
    """Number of rows by syscall type and pair status."""
    return paired.groupBy("syscall_type", "pair_status").agg(F.count("*").alias("n"))


def assign_event_id(events: DataFrame, dense: bool = False) -> DataFrame:
    """Keeps a given event_id; else ids that rise with the partition and row, or 1, 2, ... by (timestamp_ns, pid).

    Dense ids are counted per range of time and shifted by the counts before it: no single task sees all rows.
    """
    if "event_id" in events.columns:
        return events
    if not dense:
        return events.withColumn("event_id", F.monotonically_increasing_id() + 1)
    return numbered(events, ["timestamp_ns", *process_key(events)], "event_id")


def exclude_pids(events: DataFrame, pids: Iterable[int] | DataFrame) -> DataFrame:
    """Without the collector's own processes: a list of pids, or a table (host_id, pid)."""
    if isinstance(pids, DataFrame):
        return events.join(pids, process_key(pids), "left_anti")
    return events.filter(~F.col("pid").isin(*pids))


def filter_syscalls(events: DataFrame, names: Iterable[str]) -> DataFrame:
    """Only the named syscalls, given in lower case or as in the table."""
    known = {n.lower(): n for n in SYSCALL_TYPES}
    wanted = list(dict.fromkeys(n.lower() for n in names))
    if not wanted:
        raise ValueError("names is empty")
    if bad := [n for n in wanted if n not in known]:
        raise ValueError(f"names: unknown syscall {bad[0]}")
    return events.filter(F.col("syscall_type").isin(*[known[n] for n in wanted]))


def ppid_as_of(events: DataFrame, forks: DataFrame) -> DataFrame:
    """Parent pid of each event: that of the pid's latest fork at or before it, 0 if there is none or it exited since.

    forks: process key, ts_ns, parent_pid (null: exit).
    """
    key = process_key(events)
    marks = forks.select(*key, F.col("ts_ns").alias("at"), "parent_pid")
    last = F.try_element_at("forks", F.lit(-1))
    return as_of(events.drop("ppid"), marks, key, "forks").withColumn("ppid", F.coalesce(last["parent_pid"], F.lit(0))).drop("forks")
