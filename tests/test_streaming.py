"""Streams give what the batch operators give on the same ordered input."""

import os
import random
import tempfile
import time

import pytest

from fleetlens.operators import features, ingest, windows
from fleetlens.schemas import SYSCALL
from fleetlens.storage import shared_dir
from fleetlens.streaming import sinks, stateful

S, MS = 1_000_000_000, 1_000_000
PHASES = "timestamp_ns bigint, pid bigint, tid bigint, ppid bigint, syscall_type string, phase string, filename string, open_flags bigint, ip_address string, port int, child_pid bigint, syscall_result int"


def drained(spark, stream, name):
    """Runs a stream over what is there; its rows as a DataFrame."""
    place = tempfile.mkdtemp(prefix="fleetlens-stream-")
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    return spark.read.parquet(f"{place}/out")


def stored(df, n=3, disorder_ns=0, seed=1):
    """df as n files, read as a stream of one file a batch: in order of time, or with rows late by up to disorder_ns."""
    place, rng = tempfile.mkdtemp(prefix="fleetlens-files-"), random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: r.timestamp_ns + rng.randrange(disorder_ns + 1))
    step = -(-len(rows) // n)
    for k in range(n):
        df.sparkSession.createDataFrame(rows[k * step : (k + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(place)
        time.sleep(0.05)  # files are taken by their time
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place)


def random_events(spark, n=400):
    rng, rows, ts = random.Random(5), [], 1_700_000_000 * S
    for i in range(n):
        ts += rng.randrange(1, 4 * S)
        rows.append((i, ts, rng.randrange(3), 1, 1, rng.choice(["Execve", "Openat", "Connect"]), rng.choice([None, "/etc/a", "/tmp/b"]), None, None, None, 1, 0))
    rows += [(n + p, ts + 3600 * S, p, 1, 1, "Execve", None, None, None, None, None, 0) for p in range(3)]
    return spark.createDataFrame(rows, SYSCALL)


def window_rows(df, last):
    return sorted((r.pid, r.window_start_ns, r.window_end_ns, r.event_id) for r in df.collect() if r.event_id < last)


@pytest.mark.parametrize("disorder_ns", [0, 9 * S])
def test_window_stream_equals_batch(spark, disorder_ns):
    """Also with events out of order within the watermark's delay of 10 s."""
    events, last = random_events(spark), 400
    got = drained(spark, stateful.window_stream(stateful.with_event_time(stored(events, 8, disorder_ns)), 30), "w")
    assert got.filter("late").count() == 0
    assert window_rows(stateful.on_time(got), last) == window_rows(windows.window_anchored(events, 30), last)


def test_event_before_an_open_window(spark):
    """0 and 31 s in one batch, 29 s in the next: 29 s is in [0, 30)."""
    rows = [(k, ts * S, 1, 1, 1, "Execve", None, None, None, None, None, 0) for k, ts in enumerate((1000, 1031, 1029, 1000 + 3600))]
    events = spark.createDataFrame(rows, SYSCALL)
    place = tempfile.mkdtemp(prefix="fleetlens-files-")
    for part in (rows[:2], rows[2:3], rows[3:]):
        spark.createDataFrame(part, SYSCALL).coalesce(1).write.mode("append").parquet(place)
        time.sleep(0.05)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(place)
    got = drained(spark, stateful.window_stream(stateful.with_event_time(stream), 30), "o")
    assert window_rows(got, 3) == [(1, 1000 * S, 1030 * S, 0), (1, 1000 * S, 1030 * S, 2), (1, 1030 * S, 1060 * S, 1)]


def test_late_rows_come_out_marked(spark):
    """Disorder beyond the delay: rows of closed windows and late rows are the input, each once."""
    events, last = random_events(spark), 400
    got = drained(spark, stateful.window_stream(stateful.with_event_time(stored(events, 20, 120 * S)), 30), "l")
    late, closed = stateful.late_events(got), stateful.on_time(got)
    assert late.count() > 10
    ids = [r.event_id for r in late.collect()] + [r.event_id for r in closed.collect()]
    assert sorted(i for i in ids if i < last) == list(range(last))
    kept = events.join(late.select("event_id"), "event_id", "left_anti")
    assert window_rows(closed, last) == window_rows(windows.window_anchored(kept, 30), last)


def test_heartbeats_close_the_windows_of_silent_processes(spark):
    rows = [(k, (1000 + k) * S, 1, 1, 1, "Execve", None, None, None, None, None, 0) for k in range(40)]
    events = spark.createDataFrame(rows, SYSCALL)
    beats = spark.createDataFrame([((1000 + 5 * k) * S,) for k in range(30)], "timestamp_ns bigint")
    silent = drained(spark, stateful.window_stream(stateful.with_event_time(stored(events)), 30), "s")
    assert len(window_rows(silent, 99)) == 0
    both = stateful.with_heartbeats(stored(events), stored(beats, 10))
    got = drained(spark, stateful.window_stream(stateful.with_event_time(both), 30), "b")
    assert window_rows(got, 99) == window_rows(windows.window_anchored(events, 30), 99)
    assert got.filter("pid = -1").count() == 0


def state_rows(query):
    return [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]][-1]


@pytest.mark.parametrize("exits", [True, False])
def test_state_ends(spark, exits):
    """After exits, and after a time of silence, only the processes that still speak have state."""
    rows, n = [], 0
    for p in range(30):
        for t in range(5):
            rows.append((n := n + 1, (1000 + p + 3 * t) * S, p, 1, 1, "Execve", None, None, None, None, None, 0))
        if exits:
            rows.append((n := n + 1, (1000 + p + 14) * S, p, 1, 1, "Exit", None, None, None, None, None, 0))
    rows += [(n := n + 1, (2000 + 500 * k) * S, 99, 1, 1, "Execve", None, None, None, None, None, 0) for k in range(4)]
    place = tempfile.mkdtemp(prefix="fleetlens-stream-")
    stream = stateful.window_stream(stateful.with_event_time(stored(spark.createDataFrame(rows, SYSCALL), 6)), 30, idle_s=300)
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert state_rows(query) <= 6
    got = spark.read.parquet(f"{place}/out")
    assert got.filter("pid < 99").count() == 150 and (not exits or got.filter("short_lived").select("pid").distinct().count() == 30)


def test_settings_of_a_window_hold_from_its_start(spark):
    events, at = random_events(spark), (1_700_000_000 + 200) * S
    settings = spark.createDataFrame([(0, 30, 100.0), (at, 20, 5000.0)], "effective_ns bigint, window_s int, dedup_ms double")
    batch = windows.window_reconfigure(events, settings)
    got = drained(spark, stateful.window_stream(stateful.with_event_time(stored(events, 5, 8 * S)), 30, [(at, 20, 5000.0)]), "r")
    key = lambda r: (r.window_start_ns, r.window_end_ns, r.dedup_ns, r.event_id)
    assert sorted(key(r) for r in got.collect() if r.event_id < 400) == sorted(key(r) for r in batch.collect() if r.event_id < 400)


def slow_pairs(rows, timeout_ns=250 * MS):
    """The rule of pairing on one thread after the other, with plain lists and counters."""
    out, state = [], {}
    for r in sorted(rows, key=ingest.in_time):
        enters, exits, lost = state.setdefault((r["pid"], r["tid"], r["syscall_type"]), ([], [], [0, 0]))

        def passed(now, enters=enters, exits=exits, lost=lost):
            while enters and now > enters[0]["timestamp_ns"] + timeout_ns:
                out.append((enters.pop(0), "enter_only", None))
                lost[0] += 1
            while exits and now > exits[0]["timestamp_ns"] + timeout_ns:
                gone = exits.pop(0)
                out.append((gone, "late_exit", gone["syscall_result"]))
                lost[1] += 1

        passed(r["timestamp_ns"])
        if r["phase"] == "enter":
            if exits:
                out.append((r, "paired", exits.pop(0)["syscall_result"]))
            elif lost[1]:
                lost[1] -= 1
                out.append((r, "enter_only", None))
            else:
                enters.append(r)
        elif enters:
            out.append((enters.pop(0), "paired", r["syscall_result"]))
        elif lost[0]:
            lost[0] -= 1
            out.append((r, "late_exit", r["syscall_result"]))
        else:
            exits.append(r)
    for enters, exits, _ in state.values():
        out += [(r, "enter_only", None) for r in enters] + [(r, "late_exit", r["syscall_result"]) for r in exits]
    return sorted((r["pid"], r["syscall_type"], r["timestamp_ns"], status, -1 if result is None else result) for r, status, result in out)


def paired_rows(df):
    return sorted((r.pid, r.syscall_type, r.timestamp_ns, r.pair_status, -1 if r.syscall_result is None else r.syscall_result) for r in df.collect())


def phase(ts_ms, kind, what, result=None, pid=1):
    return (ts_ms * MS, pid, 1, 0, kind, what, None, None, None, None, None, result)


def random_phases(seed, n=150, pids=2):
    """Calls that overlap, come late, come in either order or lack a phase."""
    rng, rows, ts = random.Random(seed), [], 1_700_000_000_000
    for k in range(n):
        ts += rng.choice([3, 40, 200, 900])
        kind, pid = rng.choice(["Openat", "Connect"]), rng.randrange(pids)
        if rng.random() < 0.9:
            rows.append(phase(ts, kind, "enter", pid=pid))
        if rng.random() < 0.85:
            rows.append(phase(ts + rng.choice([-20, 1, 30, 240, 260, 600]), kind, "exit", k, pid))
    return rows


def test_a_late_result_never_goes_to_a_newer_call(spark):
    rows = [phase(0, "Openat", "enter"), phase(300, "Openat", "exit", 7), phase(400, "Openat", "enter"), phase(410, "Openat", "exit", 9)]
    df = spark.createDataFrame(rows, PHASES)
    want = [(1, "Openat", 0, "enter_only", -1), (1, "Openat", 300 * MS, "late_exit", 7), (1, "Openat", 400 * MS, "paired", 9)]
    assert paired_rows(ingest.pair_enter_exit(df, mode="stateful")) == want
    assert paired_rows(ingest.pair_enter_exit(df)) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_the_sequential_rule(spark, seed):
    """Threads cut into chunks, so that counts go from chunk to chunk."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        df = spark.createDataFrame(random_phases(seed), PHASES)
        assert paired_rows(ingest.pair_enter_exit(df, mode="stateful")) == slow_pairs([r.asDict() for r in df.collect()])
        serial = [phase(1000 * k + d, "Openat", what, k) for k in range(60) for d, what in ((0, "enter"), (30 if k % 5 else 300, "exit")) if k % 7 or what == "enter"]
        df = spark.createDataFrame(serial, PHASES)
        assert paired_rows(ingest.pair_enter_exit(df, mode="stateful")) == paired_rows(ingest.pair_enter_exit(df))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_pair_stream_equals_batch(spark):
    rows = random_phases(9)
    end = max(r[0] for r in rows)
    rows += [phase(end // MS + 3_600_000 * k, kind, "enter", pid=p) for k in (1, 2) for kind in ("Openat", "Connect") for p in (0, 1)]
    phases = spark.createDataFrame(rows, PHASES)
    before = lambda df: [r for r in paired_rows(df) if r[2] <= end]
    want = before(ingest.pair_enter_exit(phases, mode="stateful"))
    for disorder in (0, 9 * S):
        got = drained(spark, stateful.pair_stream(stateful.with_event_time(stored(phases, 5, disorder))), "p")
        assert got.filter("late").count() == 0 and before(got) == want
    got = drained(spark, stateful.pair_stream(stateful.with_event_time(stored(phases, 20, 60 * S))), "q")
    late = stateful.late_events(got)
    assert late.count() > 5
    left = [r.asDict() for r in phases.exceptAll(late.select(*phases.columns)).collect()]
    assert before(stateful.on_time(got)) == [r for r in slow_pairs(left) if r[2] <= end]


def test_writer_is_idempotent(spark):
    from pyspark.sql import functions as F

    place = tempfile.mkdtemp(prefix="fleetlens-sink-")
    nodes = spark.createDataFrame([(0, 0, "LEAF", None, None, None, None, None, 3.0)], "tree_id int, node_id int, mode string, feature_index int, threshold double, true_node int, false_node int, missing_true boolean, weight double")
    batch = windows.window_anchored(random_events(spark, 60), 30).withColumn("short_lived", F.lit(False))
    n = features.f_total(batch).count()
    write = sinks.telemetry_writer(place, lambda: (nodes, "m"))
    kept = lambda: set(os.listdir(shared_dir(spark))) if os.path.isdir(shared_dir(spark)) else set()
    before = kept()
    write(batch, 0)
    write(batch, 0)
    write(batch, 1)
    assert kept() == before  # no batch leaves a staged table
    ids = [r.alert_id for r in spark.read.parquet(f"{place}/alerts").orderBy("alert_id").collect()]
    assert ids == list(range(1, 2 * n + 1)) and spark.read.parquet(f"{place}/inference_log").count() == 2 * n
    sinks.telemetry_writer(place, lambda: None)(batch, 2)
    assert spark.read.parquet(f"{place}/degraded").count() == n


def test_state_follows_groups_not_rows_and_keys(spark):
    """600 processes of 3 rows: a group's rows and what is known of its processes are one entry each."""
    rows = [(3 * p + k, (1000 + k) * S, p, 1, 1, "Execve", None, None, None, None, None, 0) for p in range(600) for k in range(3)]
    place = tempfile.mkdtemp(prefix="fleetlens-stream-")
    stream = stateful.window_stream(stateful.with_event_time(stored(spark.createDataFrame(rows, SYSCALL), 1)), 30)
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    assert 0 < state_rows(query) < 600


def test_every_batch_of_a_disordered_stream_has_as_many_files(spark, monkeypatch):
    from fleetlens.plans import queries

    monkeypatch.setattr(queries, "FILE_ROWS", 20)
    events = random_events(spark, 400)
    stream = queries.in_disorder(events, 9 * S)
    place = tempfile.mkdtemp(prefix="fleetlens-stream-")
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination(240)
    sizes = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert len(sizes) == 4 and min(sizes) > 80
    assert sorted(r.event_id for r in spark.read.parquet(f"{place}/out").collect()) == sorted(r.event_id for r in events.collect())


def test_writer_computes_no_grams(spark, monkeypatch):
    from pyspark.sql import functions as F

    def unwanted(rows):
        raise AssertionError("grams")

    monkeypatch.setattr(features, "f_bigrams", unwanted)
    batch = windows.window_anchored(random_events(spark, 20), 30).withColumn("short_lived", F.lit(False))
    place = tempfile.mkdtemp(prefix="fleetlens-sink-")
    sinks.telemetry_writer(place, lambda: None)(batch, 0)
    assert spark.read.parquet(f"{place}/degraded").count() == features.f_total(batch).count()


def test_stateful_turns_equal_the_serial_rule(spark):
    """Overlapping calls, and phases that the table holds several times."""
    rows = random_phases(4) + [phase(5000 + d, "Openat", what, 7) for d, what in ((0, "enter"), (9, "exit")) for _ in range(3)]
    df = spark.createDataFrame(rows, PHASES)
    known = lambda **how: [r[:4] for r in paired_rows(ingest.pair_enter_exit(df, **how))]
    got = known(mode="stateful", overlapping=False)
    assert got == known() and got != known(mode="stateful")
    assert [r[3] for r in got if r[2] in (5000 * MS, 5009 * MS)] == ["enter_only", "enter_only", "paired", "late_exit", "late_exit"]


def test_times_before_1970_are_not_late(spark):
    """Spark's watermark is 0 until one is known; and a disordered stream holds all rows."""
    from fleetlens.plans import queries

    rows = [phase(-20, "Openat", "exit", 5), phase(-10, "Openat", "enter"), phase(60_000, "Connect", "enter"), phase(120_000, "Connect", "enter")]
    phases = spark.createDataFrame(rows, PHASES)
    stream = queries.in_disorder(phases, 1)
    got = drained(spark, stateful.pair_stream(stateful.with_event_time(stream)), "n")
    assert got.filter("late").count() == 0 and paired_rows(got)[-1] == (1, "Openat", -10 * MS, "paired", 5)
    events = spark.createDataFrame([(k, ts * S, 1, 1, 1, "Execve", None, None, None, None, None, 0) for k, ts in enumerate((-100, -71, -69, 600))], SYSCALL)
    got = drained(spark, stateful.window_stream(stateful.with_event_time(stored(events, 4)), 30), "m")
    assert got.filter("late").count() == 0 and window_rows(got, 3) == [(1, -100 * S, -70 * S, 0), (1, -100 * S, -70 * S, 1), (1, -70 * S, -40 * S, 2)]


@pytest.mark.parametrize("overlapping", [True, False])
def test_a_thread_is_folded_batch_by_batch(spark, overlapping):
    """Batches of 7 rows: what waits goes from one to the next, and a chunk's counts with it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame(random_phases(6), PHASES)
        got = paired_rows(ingest.pair_enter_exit(df, mode="stateful", overlapping=overlapping))
        if overlapping:
            assert got == slow_pairs([r.asDict() for r in df.collect()])
        else:
            assert [r[:4] for r in got] == [r[:4] for r in paired_rows(ingest.pair_enter_exit(df))]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_only_waiting_rows_are_held():
    """A thread of 10,000 calls: rows are known by number, and those that wait are few."""
    calls, most = ingest.Calls(250 * MS), 0
    for k in range(10_000):
        calls.push(k * 100 * MS, True, 2 * k)
        most = max(most, len(calls.waiting()))
        calls.push(k * 100 * MS + 50 * MS, False, 2 * k + 1)
    assert most == 1 and not calls.waiting() and calls.out[-1] == (19_998, ingest.PAIRED, 19_999)


def test_timer_of_a_call_that_was_paired_before(spark):
    """The watermark stands between enter and exit once, so a timer is set for an enter that is then paired."""
    batches = [[phase(1_000_000, "Openat", "enter"), phase(1_010_100, "Openat", "enter", pid=2)], [phase(1_000_200, "Openat", "exit", 7), phase(1_010_220, "Openat", "exit", 8, 2)], [phase(1_100_000, "Openat", "enter", pid=2)], [phase(1_200_000, "Openat", "enter", pid=2)]]
    place = tempfile.mkdtemp(prefix="fleetlens-files-")
    for part in batches:
        spark.createDataFrame(part, PHASES).coalesce(1).write.mode("append").parquet(place)
        time.sleep(0.05)
    stream = spark.readStream.schema(spark.createDataFrame([], PHASES).schema).option("maxFilesPerTrigger", 1).parquet(place)
    got = drained(spark, stateful.pair_stream(stateful.with_event_time(stream)), "t")
    assert paired_rows(got)[:2] == [(1, "Openat", 1_000_000 * MS, "paired", 7), (2, "Openat", 1_010_100 * MS, "paired", 8)]
