"""What small tables hide: many partitions, long spans, several hosts, orders over whole tables."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts, enrich, explore, features, ingest, ordering, reports, training, windows
from fleetlens.operators.ordering import previous, running_sums
from fleetlens.operators.priors import f_prior_event, f_prior_path, f_prior_process, f_priors
from fleetlens.schemas import SYSCALL, window_key
from fleetlens.streaming import stateful
from test_streaming import drained, stored

S = 1_000_000_000


@pytest.fixture
def many_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


def wide(spark, n):
    """n rows in no order, with ties and one wide column."""
    ts = F.pmod(F.xxhash64("id"), F.lit(n // 2)) + 1_700_000_000 * S
    return spark.range(0, n, 1, 16).select(ts.alias("timestamp_ns"), (F.col("id") % 977).alias("pid"), F.repeat(F.lit("x"), 60).alias("filename"), F.col("id").alias("row"))


def test_two_million_ids_are_dense(spark, many_partitions, tmp_path):
    n = 2_000_000
    for name, made in (("event_id", ingest.assign_event_id(wide(spark, n), dense=True)), ("alert_id", alerts.alert_ids(wide(spark, n)))):
        made.write.parquet(str(tmp_path / name))
        got = spark.read.parquet(str(tmp_path / name))
        r = got.agg(F.count("*").alias("n"), F.count_distinct(name).alias("ids"), F.count_distinct("row").alias("rows"), F.min(name).alias("low"), F.max(name).alias("high")).first()
        assert (r.n, r.ids, r.rows, r.low, r.high) == (n, n, n, 1, n)
        ordered = got.select(name, "timestamp_ns", "pid").filter(F.col(name) % 1000 < 2).orderBy(name).collect()
        assert all((a.timestamp_ns, a.pid) <= (b.timestamp_ns, b.pid) for a, b in zip(ordered, ordered[1:]))


def test_windows_of_long_lifetimes(spark):
    """Beyond 2 ** 53 ns from the first event a double would put an event into the window after it."""
    last = 600_000 * 30 * S - 1
    rows = [(k, ts, 1, 1, 1, "Execve", None, None, None, None, None, None) for k, ts in enumerate((0, last, last + 1))]
    got = windows.window_anchored(spark.createDataFrame(rows, SYSCALL), 30).orderBy("timestamp_ns").collect()
    assert [r.window_start_ns for r in got] == [0, last + 1 - 30 * S, last + 1]
    settings = spark.createDataFrame([(0, 30)], "effective_ns bigint, window_s bigint")
    again = windows.window_reconfigure(spark.createDataFrame(rows, SYSCALL), settings).orderBy("timestamp_ns").collect()
    assert [r.window_start_ns for r in again] == [0, last + 1 - 30 * S, last + 1]


def hosted(spark, n=120):
    rng, rows, ts = random.Random(8), [], 1_700_000_000 * S
    for k in range(n):
        ts += rng.randrange(1, 9 * S)
        rows.append((f"h{k % 2}", k, ts, 1 + k % 3 % 2, 1, 1, rng.choice(["Execve", "Openat"]), rng.choice(["/a", None]), None, None, None, 1, 0))
    rows += [(f"h{h}", n + 2 * h + p, ts + 7200 * S, 1 + p, 1, 1, "Execve", None, None, None, None, None, 0) for h in (0, 1) for p in (0, 1)]
    return spark.createDataFrame(rows, "host_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SYSCALL))


def test_hosts_stay_apart_in_batch_and_stream(spark):
    events = hosted(spark)
    key = lambda r: (r.host_id, r.pid, r.window_start_ns, r.event_id)
    want = {key(r) for r in windows.window_anchored(events, 30).collect() if r.event_id < 120}
    apart = {key(r) for h in ("h0", "h1") for r in windows.window_anchored(events.filter(F.col("host_id") == h), 30).collect() if r.event_id < 120}
    got = drained(spark, stateful.window_stream(stateful.with_event_time(stored(events)), 30), "hosts")
    assert want == apart == {key(r) for r in got.collect() if r.event_id < 120}


def test_pairs_of_two_hosts_stay_apart(spark):
    ms, start = 1_000_000, 1_700_000_000 * S
    rows = [("h0", start, "enter"), ("h1", start + ms, "enter"), ("h1", start + 5 * ms, "exit"), ("h0", start + 9_000 * ms, "enter"), ("h1", start + 9_000 * ms, "enter"), ("h0", start + 90_000 * ms, "enter")]
    df = spark.createDataFrame([(h, 1, 1, 0, "Openat", ts, p, None, None, None, None, None, 3) for h, ts, p in rows], "host_id string, pid bigint, tid bigint, ppid bigint, syscall_type string, timestamp_ns bigint, phase string, filename string, open_flags bigint, ip_address string, port int, child_pid bigint, syscall_result int")
    for mode in ("serial", "stateful"):
        got = ingest.pair_enter_exit(df, mode=mode).filter("pair_status = 'paired'").collect()
        assert [(r.host_id, r.timestamp_ns) for r in got] == [("h1", start + ms)]
    streamed = drained(spark, stateful.pair_stream(stateful.with_event_time(stored(df, 2))), "pairs").filter("pair_status = 'paired'").collect()
    assert [(r.host_id, r.timestamp_ns) for r in streamed] == [("h1", start + ms)]


def test_joins_keep_hosts_apart(spark):
    trials = spark.createDataFrame([("t", "a", 1, 100), ("t", "b", 1, 100)], "trial string, host_id string, pid bigint, start_ns bigint")
    found = spark.createDataFrame([("a", 1, 150, 7), ("b", 1, 190, 8)], "host_id string, pid bigint, ts_ns bigint, alert_id bigint")
    assert {(r.host_id, r.latency_ns) for r in reports.alert_latency(trials, found).collect()} == {("a", 50), ("b", 90)}
    events = spark.createDataFrame([("a", 1, "Connect", 4003), ("a", 1, "Connect", 4003), ("b", 1, "Connect", 4003)], "host_id string, pid bigint, syscall_type string, port int")
    assert [r.alert_id for r in explore.correlate_alerts(events, found, 4003).collect()] == [7]


def test_orders_in_two_levels(spark, many_partitions):
    rng = random.Random(31)
    values = [(ts, rng.choice([1, 1, 1, 9]), rng.choice("xyz")) for ts in rng.sample(range(10**6), 3000)]
    df = spark.createDataFrame(values, "ts_ns bigint, value int, state string").repartition(7)
    rows = sorted(values)
    total, want = 0, {}
    for ts, v, _ in rows:
        want[ts] = total = total + v
    assert {r.ts_ns: r.total for r in running_sums(df, ["ts_ns"], "sums", total=F.col("value")).collect()} == want
    changes = [(ts, s) for k, (ts, _, s) in enumerate(rows) if k == 0 or rows[k - 1][2] != s]
    assert sorted((r.ts_ns, r.state) for r in explore.state_history(df).collect()) == changes
    best, run = (0, 0, 0), []
    for ts, v, _ in [*rows, (0, 9, "")]:
        if v <= 1:
            run.append(ts)
            continue
        if len(run) > best[2]:
            best = (run[0], run[-1], len(run))
        run = []
    got = reports.longest_streak(df.withColumn("value", -F.col("value")), -1).first()
    assert (got.start_ns, got.end_ns, got.samples) == best
    counts = {ts: sum(ts - 1000 <= t <= ts for t, _, _ in rows) for ts, _, _ in rows[::50]}
    rate = explore.event_rate(df.select((F.col("ts_ns") * 1_000_000).alias("timestamp_ns")), 1)
    assert {r.timestamp_ns // 1_000_000: r.events_per_second for r in rate.collect() if r.timestamp_ns // 1_000_000 in counts} == counts


def test_threshold_sweep_over_many_scores(spark, many_partitions):
    rng = random.Random(6)
    rows = [(rng.random(), int(rng.random() < 0.3)) for _ in range(4000)]
    rows = [(min(1.0, s + 0.4 * y), y) for s, y in rows]
    got = training.threshold_sweep(spark.createDataFrame(rows, "threat_score double, label int")).first()
    p, n, best = sum(y for _, y in rows), sum(1 - y for _, y in rows), None
    for t in {s for s, _ in rows}:
        tpr, fpr = sum(y for s, y in rows if s >= t) / p, sum(1 - y for s, y in rows if s >= t) / n
        if tpr >= 0.95 and (best is None or (fpr, -t) < best[0]):
            best = (fpr, -t), (t, tpr, fpr)
    assert tuple(got) == pytest.approx(best[1])


def sequential(events, settings):
    """The rule of changing lengths, event by event."""
    out, state = {}, {}
    for i, ts, pid in sorted(events, key=lambda e: (e[1], e[0])):
        start, end = state.get(pid, (None, None))
        if end is None or ts >= end:
            step = [s for at, s in settings if at <= ts or at == settings[0][0]][-1] * S
            start = ts if end is None else end + (ts - end) // step * step
            end = start + step
        state[pid] = out[i] = (start, end)
    return out


def test_reconfigured_windows_equal_the_sequential_rule(spark):
    rng = random.Random(13)
    for settings in ([(0, 30)], [(500 * S, 30), (900 * S, 7), (1200 * S, 100), (1210 * S, 1)], [(0, 30), (10**15, 5)]):
        events = [(i, rng.randrange(2000) * S + rng.randrange(S), rng.randrange(6)) for i in range(500)]
        df = spark.createDataFrame(events, "event_id bigint, timestamp_ns bigint, pid bigint")
        got = windows.window_reconfigure(df, spark.createDataFrame(settings, "effective_ns bigint, window_s bigint")).collect()
        assert {r.event_id: (r.window_start_ns, r.window_end_ns) for r in got} == sequential(events, settings)


def test_one_pass_equals_the_single_operators(spark):
    rng = random.Random(77)
    rows = [(i, rng.randrange(60 * S), rng.randrange(3), 1, 1, rng.choice(["Openat", "Openat", "Connect", "Clone", "Execve"]), rng.choice([None, "/etc/a", "/tmp/b/c/d"]), rng.choice([None, "127.0.0.1", "10.0.0.1"]), rng.choice([None, 80, 443]), None, rng.choice([None, 0, 65]), rng.choice([None, -1, 0])) for i in range(600)]
    events = spark.createDataFrame(rows, SYSCALL).withColumns({"process_name": F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("p"), F.col("pid"))), "binary_path": F.when(F.col("event_id") % 7 == 0, F.lit("/usr/bin/x"))})
    cut = windows.window_anchored(events, 7)
    key = window_key(cut)
    got = {tuple(r[k] for k in key): r for r in features.features_all(cut, 400, maps=False, identity=True).collect()}
    timing = {tuple(r[k] for k in key): r for r in features.f_timing(windows.dedup_openat(cut, 400)).collect()}
    entropy = {tuple(r[k] for k in key): r.path_entropy for r in features.f_path_entropy(cut).collect()}
    plain = {tuple(r[k] for k in key): r for r in features.aggregated(cut).collect()}
    known = {tuple(r[k] for k in key): r for r in alerts.window_identity(cut).collect()}
    assert got.keys() == timing.keys() == plain.keys() == known.keys()
    for k, r in got.items():
        assert r.path_entropy == pytest.approx(entropy.get(k, 0.0), abs=1e-12) and all(r[c] == plain[k][c] for c in features.AGGREGATES)
        assert all(r[c] == pytest.approx(timing[k][c], rel=1e-9) for c in timing[k].asDict() if c.endswith("time_ns"))
        assert (r.process_name, r.binary_path) == (known[k].process_name, known[k].binary_path)
    table = spark.createDataFrame([("global", "", 0.1), ("process", "p1", 0.7), ("event", "openat", 0.4), ("event", "clone", 0.6), ("path", "/etc/a", 0.2), ("path", "/usr/bin", 0.9)], "family string, token string, rate double")
    one = {tuple(r[k] for k in key): (r.process_positive_rate, r.event_positive_rate, r.path_positive_rate) for r in f_priors(cut, table).collect()}
    three = f_prior_process(cut, table).join(f_prior_event(cut, table), key).join(f_prior_path(cut, table), key).collect()
    assert one == {tuple(r[k] for k in key): (r.process_positive_rate, r.event_positive_rate, r.path_positive_rate) for r in three}


def test_first_difference_of_long_lines(spark):
    base = "é" * 50_000
    for a, b, at in ((base, base[:30_000] + "x" + base[30_001:], 60_000), ("abc", "abd", 2), ("abc", "abcd", 3), ("", "x", 0)):
        got = explore.log_diff(*[spark.createDataFrame([(0, "same"), (1, x)], "line_no bigint, line string") for x in (a, b)]).first()
        assert (got.first_difference, got.different_lines) == (5 + at, 1)


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Ranges of few rows, none joined again."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 40)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_within_a_key(spark, small_ranges):
    """One key with most of the rows; the number of ranges follows the rows, and no task has the key whole."""
    rng = random.Random(3)
    rows = [(h, t, rng.randrange(5), rng.choice("xy")) for h, n in (("busy", 900), ("b", 20), (None, 30)) for t in rng.sample(range(10**6), n)]
    df = spark.createDataFrame(rows, "host_id string, ts_ns bigint, value int, state string").repartition(5)
    placed = ordering.ranged(df, ["host_id", "ts_ns"], "t")
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert len(sizes) > 15 and max(sizes) < 200
    want, total, before, last = {}, {}, {}, {}
    for h, t, v, s in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[h, t] = total[h] = total.get(h, 0) + v
        before[h, t] = last.get(h)
        last[h] = s
    assert {(r.host_id, r.ts_ns): r.total for r in running_sums(df, ["ts_ns"], "t", ["host_id"], total=F.col("value")).collect()} == want
    assert {(r.host_id, r.ts_ns): r.before for r in previous(df, "state", ["ts_ns"], "t", ["host_id"]).collect()} == before
    changes = sorted(((h or "", t) for h, t, _, s in rows if before[h, t] != s))
    assert sorted((r.host_id or "", r.ts_ns) for r in explore.state_history(df).collect()) == changes
    numbers = ordering.numbered(df, ["ts_ns", "host_id"], "id").collect()
    assert [r.id for r in sorted(numbers, key=lambda r: (r.ts_ns, r.host_id is not None, r.host_id or ""))] == list(range(1, len(rows) + 1))


def test_partial_warnings_of_a_busy_process(spark, small_ranges):
    rng = random.Random(5)
    rows = [(k, 1000 + k // 3, p, rng.random() < 0.4) for p, n in ((1, 600), (2, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "event_id bigint, timestamp_ns bigint, pid bigint, enrichment_partial boolean").repartition(4)
    want = [(p, k) for p in (1, 2) for k in range(600 if p == 1 else 40) for at in [rows.index((k, 1000 + k // 3, p, True)) if (k, 1000 + k // 3, p, True) in rows else None] if at is not None and not (k and rows[at - 1][3])]
    assert sorted((r.pid, r.event_id) for r in enrich.enrichment_partial(df).collect()) == want


def test_two_million_rows_of_one_key(spark):
    n = 2_000_000
    df = spark.range(n).select(F.lit("h").alias("host_id"), F.pmod(F.col("id") * 7_368_787, F.lit(n)).alias("ts_ns"), F.lit(1).alias("value"))
    got = running_sums(df, ["ts_ns"], "t", ["host_id"], total=F.col("value"))
    assert got.filter("total <> ts_ns + 1").count() == 0


@pytest.mark.parametrize("kind", ["even", "skewed", "few", "tied", "decimal"])
def test_selection_equals_sorting(spark, monkeypatch, kind):
    """Values of every shape: found by narrowing, without an exchange of the values."""
    monkeypatch.setattr(reports, "FEW", 50)
    rng = random.Random(kind)
    make = {"even": lambda: rng.random(), "skewed": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "few": lambda: float(rng.randrange(3)), "tied": lambda: rng.choice([1.0, 2.0]) if rng.random() < 0.999 else rng.random(), "decimal": lambda: rng.randrange(10**6)}[kind]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v bigint" if kind == "decimal" else "v double").repartition(4)
    ps, ordered = [0, 0.1, 12.5, 50, 90, 99.9, 100], sorted(values)
    got = {r.p: r.value for r in reports.nearest_rank(df, "v", ps).collect()}
    assert got == {float(p): ordered[max(math.ceil(p * 3000 / 100) - 1, 0)] for p in ps}
    got = {r.p: r.value for r in reports.rounded_rank(df, "v", ps).collect()}
    assert got == {float(p): ordered[math.floor((2999 * p + 50) / 100)] for p in ps}


def test_latency_report(spark):
    rows = [(k * 1_000_000,) for k in range(1, 1001)] + [(None,)]
    r = reports.latency_report(spark.createDataFrame(rows, "latency_ns bigint")).first()
    assert (r.trials, r.p50, r.p95, r.p99, r.p99_9, r.max, r.mean) == (1000, 500, 950, 990, 999, 1000, 500.5)
    none = reports.latency_report(spark.createDataFrame([], "latency_ns bigint")).first()
    assert none.trials == 0 and none.p50 is None and none.max is None and reports.nearest_rank(spark.createDataFrame([], "v double"), "v", [50]).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_log_diff_descends(spark, seed):
    """Trees of unlike height, changed, missing and added lines, against a comparison byte by byte."""
    rng = random.Random(seed)
    a = ["x" * rng.randrange(6) + rng.choice("pq") for _ in range(rng.choice([0, 3, 17, 40]))]
    b = a[: rng.randrange(len(a) + 1)] if seed % 2 else list(a)
    for _ in range(seed % 3):
        if b:
            at = rng.randrange(len(b))
            b[at] = b[at][:-1] + rng.choice("éz") + b[at][-1:]
    b += ["more"] * (seed % 4 * 5)
    table = lambda lines: spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    whole = lambda lines: "".join(f"{x}\n" for x in lines).encode()
    r = explore.log_diff(table(a), table(b), 20, 3).first()
    x, y = whole(a), whole(b)
    first = None if x == y else next((k for k, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), min(len(x), len(y)))
    assert (r.expected_bytes, r.observed_bytes, r.first_difference) == (len(x), len(y), first)
    assert r.different_lines == sum(p != q for p, q in itertools.zip_longest(a, b)) and (r.expected_digest == r.observed_digest) == (x == y)
    assert r.in_head == (first is not None and first < 20)


def test_log_diff_digest_of_two_levels(spark):
    """40 lines in blocks of 3 make a tree of four levels; the digest of two levels is that of its 14 leaves."""
    import hashlib

    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    table = lambda lines: spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    a = [f"line {k}" for k in range(40)]
    leaves = lambda lines: [sha("".join(map(sha, lines[k : k + 3]))) for k in range(0, len(lines), 3)]
    r = explore.log_diff(table(a), table(a[:2]), 20, 3, two_levels=True).first()
    assert (r.expected_digest, r.observed_digest) == (sha("".join(leaves(a))), leaves(a[:2])[0])
    assert (r.first_difference, r.different_lines) == (14, 38)
    assert explore.log_diff(table(a), table([]), 20, 3, two_levels=True).first().observed_digest is None
