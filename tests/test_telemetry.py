"""Literal cases and seeded properties of the telemetry operators."""

import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.functions import scalars as fn
from fleetlens.operators import alerts, enrich, explore, features, ingest, reports, scoring, training, windows
from fleetlens.schemas import ALERT, MANIFEST, RAW_SYSCALL, SYSCALL

S = 1_000_000_000
MS = 1_000_000


def event(i, ts, kind, pid=4242, filename=None, flags=None, ip=None, port=None, child=None, result=None):
    return (i, ts, pid, pid, 1, kind, filename, ip, port, child, flags, result)


def table(spark, rows):
    return spark.createDataFrame(rows, SYSCALL)


GOLDEN = [
    event(1, 0, "Execve"),
    event(2, S, "Openat", filename="/etc/passwd", flags=65),
    event(3, 2 * S, "Openat", filename="/tmp/readonly", flags=0),
    event(4, 3 * S, "Connect", ip="10.0.0.8", port=443),
    event(5, 4 * S, "Connect", ip="127.0.0.1", port=8080, result=-111),
    event(6, 5 * S, "Clone", child=4243, result=4243),
]


def test_golden_vector(spark):
    got = features.features_all(windows.window_anchored(table(spark, GOLDEN), 10)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.total_syscalls, r.execve_count, r.openat_count, r.connect_count, r.clone_count) == (6, 1, 2, 2, 1)
    assert all(math.isclose(v, 0.2) for v in r.bigrams.values()) and len(r.bigrams) == 5
    assert all(math.isclose(v, 0.25) for v in r.trigrams.values()) and len(r.trigrams) == 4
    assert math.isclose(r.path_entropy, math.log(2))
    assert (r.unique_ips, r.unique_files, r.child_spawn_count, r.distinct_ports) == (2, 2, 1, 2)
    assert (r.avg_inter_syscall_time_ns, r.min_inter_syscall_time_ns, r.max_inter_syscall_time_ns, r.stddev_inter_syscall_time_ns) == (1e9, 1e9, 1e9, 0.0)
    assert (r.wrote_etc, r.wrote_tmp, r.wrote_dev) == (True, False, False)
    assert (r.read_sensitive_file_count, r.write_sensitive_file_count) == (1, 1)
    assert (r.outbound_connection_count, r.loopback_connection_count, r.failed_syscall_count) == (2, 1, 1)
    assert r.window_duration_ns == 10 * S and math.isclose(r.events_per_second, 0.6) and not r.short_lived


def test_entropy_reference(spark):
    rows = [event(i, i * S, "Openat", filename=f) for i, f in enumerate(["/opt/a"] * 3 + ["/opt/b"] * 2 + ["/opt/c"])]
    got = features.f_path_entropy(windows.window_anchored(table(spark, rows), 30)).first()
    assert math.isclose(got.path_entropy, 1.0114042647073518, rel_tol=1e-12)


@pytest.mark.parametrize("ordered", [True, False])
def test_dedup(spark, ordered):
    def repeats(rows, ms=100):
        got = windows.dedup_openat(windows.window_anchored(table(spark, rows), 30), ms, ordered)
        return [r.repeat_count for r in got.orderBy("timestamp_ns", "event_id").collect()]

    opened = lambda i, ts, f: event(i, ts, "Openat", filename=f)
    assert repeats([opened(i, i * 10_000, "/a") for i in range(100)]) == [100]
    assert repeats([opened(i, i * 10_000, "/tmp/ab"[: 6 - i % 2]) for i in range(100)]) == [50, 50]
    assert repeats([opened(1, 0, "/a"), opened(2, 100 * MS, "/a")]) == [1, 1]
    assert repeats([opened(1, 0, "/a"), opened(2, 1_500_000, "/a")], 1) == [1, 1]
    assert repeats([opened(1, 0, "/a"), event(2, 1000, "Execve"), opened(3, 2000, "/a")]) == [1, 1, 1]


def test_dedup_backward_arrivals(spark):
    def repeats(rows):
        got = windows.dedup_openat(table(spark, rows).withColumns({"lifetime": F.lit(0), "window_start_ns": F.lit(0).cast("bigint")}), 100, ordered=False)
        return [r.repeat_count for r in got.orderBy("event_id").collect()]

    opened = lambda i, ts, f: event(i, ts, "Openat", filename=f)
    assert repeats([opened(1, 2_000_000, "/a"), opened(2, 1_500_000, "/a")]) == [1, 1]
    assert repeats([opened(1, 10 * MS, "/a"), opened(2, 20 * MS, "/b"), opened(3, 30 * MS, "/a"), opened(4, 25 * MS, "/b")]) == [2, 1, 1]


def test_windows_boundaries_and_gaps(spark):
    rows = [event(i, ts, "Execve") for i, ts in enumerate([5 * S, 34 * S, 35 * S, 200 * S])]
    got = windows.window_anchored(table(spark, rows), 30).orderBy("event_id").collect()
    assert [r.window_start_ns // S for r in got] == [5, 5, 35, 185]


def test_exit_closes_and_reanchors(spark):
    rows = [event(1, 0, "Execve"), event(2, 10 * S, "Execve"), event(3, 20 * S, "Execve")]
    exits = spark.createDataFrame([(4242, 12 * S)], "pid bigint, exit_ns bigint")
    got = windows.window_short_lived(table(spark, rows), exits, 30).orderBy("event_id").collect()
    assert [(r.lifetime, r.window_start_ns // S, r.window_end_ns // S, r.short_lived) for r in got] == [(0, 0, 12, True), (0, 0, 12, True), (1, 20, 50, False)]


def test_reconfigure_from_next_window(spark):
    rows = [event(i, ts * S, "Execve") for i, ts in enumerate([0, 25, 30, 45, 55])]
    settings = spark.createDataFrame([(0, 30), (10 * S, 10)], "effective_ns bigint, window_s bigint")
    got = windows.window_reconfigure(table(spark, rows), settings).orderBy("event_id").collect()
    assert [(r.window_start_ns // S, r.window_end_ns // S) for r in got] == [(0, 30), (0, 30), (30, 40), (40, 50), (50, 60)]


def test_invariants_on_random_events(spark):
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        kind = rng.choice(["Execve", "Openat", "Connect", "Clone"])
        rows.append(event(i, i * 50 * MS + rng.randrange(1000), kind, pid=rng.randrange(6), filename=rng.choice(["/etc/a", "/tmp/b", "/x", None]) if kind == "Openat" else None, flags=rng.choice([0, 1, 64]), ip=rng.choice(["127.0.0.1", "10.1.1.1"]) if kind == "Connect" else None, result=rng.choice([-1, 0, None])))
    got = features.features_all(windows.window_anchored(table(spark, rows), 7)).collect()
    assert sum(r.total_syscalls for r in got) == 3000
    for r in got:
        assert r.total_syscalls == r.execve_count + r.openat_count + r.connect_count + r.clone_count
        assert math.isclose(r.execve_ratio + r.openat_ratio + r.connect_ratio + r.clone_ratio, 1.0)
        assert not r.bigrams or math.isclose(sum(r.bigrams.values()), 1.0)
        assert not r.trigrams or math.isclose(sum(r.trigrams.values()), 1.0)
        assert r.unique_ips <= r.connect_count


def test_grams_with_repeats_equal_expanded(spark):
    rng = random.Random(3)
    kinds = [rng.choice(["Openat", "Execve"]) for _ in range(40)]
    weights = [rng.randrange(1, 6) for _ in kinds]
    short = [event(i, i * S, k) for i, k in enumerate(kinds)]
    long = [event(i * 10 + j, i * S + j, k) for i, (k, w) in enumerate(zip(kinds, weights, strict=True)) for j in range(w)]
    counted = spark.createDataFrame([(i, w) for i, w in enumerate(weights)], "event_id bigint, repeat_count bigint")
    for n in (2, 3):
        a = features.grams(windows.window_anchored(table(spark, short).join(counted, "event_id"), 1000), n)
        b = features.grams(windows.window_anchored(table(spark, long), 1000), n)
        assert {r.gram: r["count"] for r in a.collect()} == {r.gram: r["count"] for r in b.collect()}


def test_decode(spark):
    raw = lambda kind, name=b"", length=None, result=0: (5, 1, 1, 0, kind, bytes([127, 0, 0, 1]), 80, len(name) if length is None else length, result, 64, name + bytes(4))
    exit_bit = 1 << 31
    rows = [raw(2, b"/etc/x"), raw(2, b"/a\0b"), raw(2, b""), raw(2, b"/a", 257), raw(2, b"\xff\xfe"), raw(9), raw(3), raw(4 + exit_bit, result=77), raw(4 + exit_bit, result=-1)]
    got = ingest.decode_raw(spark.createDataFrame(rows, RAW_SYSCALL)).collect()
    assert [r.filename for r in got[:3]] == ["/etc/x", "/a", None]
    assert [r.reject_kind for r in got] == [None, None, None, "filename_length", "filename_utf8", "unknown_type", None, None, None]
    assert got[6].ip_address == "127.0.0.1" and got[6].port == 80 and got[6].syscall_result is None
    assert (got[7].child_pid, got[8].child_pid) == (77, None)


PHASES = "timestamp_ns bigint, pid bigint, tid bigint, ppid bigint, syscall_type string, phase string, filename string, open_flags bigint, ip_address string, port int, child_pid bigint, syscall_result int"


def phase(ms, kind, which, result=None):
    return (ms * MS, 1, 1, 0, kind, which, None, None, None, None, None, result)


@pytest.mark.parametrize("mode", ["serial", "stateful"])
def test_pairing(spark, mode):
    rows = [phase(0, "Openat", "enter"), phase(1, "Openat", "exit", 3), phase(1000, "Openat", "enter"), phase(1300, "Openat", "exit", 4), phase(5, "Execve", "enter"), phase(6, "Execve", "exit", 0), phase(7, "Clone", "enter"), phase(8, "Clone", "exit", 9)]
    got = ingest.pair_enter_exit(spark.createDataFrame(rows, PHASES), mode=mode)
    assert {(r.syscall_type, r.pair_status): r.n for r in ingest.pair_report(got).collect()} == {("Openat", "paired"): 1, ("Openat", "enter_only"): 1, ("Openat", "late_exit"): 1, ("Execve", "passthrough"): 1, ("Execve", "ignored"): 1, ("Clone", "ignored"): 1, ("Clone", "passthrough"): 1}
    assert sorted((r.timestamp_ns // MS, r.syscall_result) for r in ingest.emitted(got).filter("syscall_type = 'Openat'").collect()) == [(0, 3), (1000, None)]


def test_stateful_pairing_overlaps(spark):
    rows = [phase(0, "Connect", "enter"), phase(10, "Connect", "enter"), phase(20, "Connect", "exit", 1), phase(30, "Connect", "exit", 2)]
    got = ingest.pair_enter_exit(spark.createDataFrame(rows, PHASES), mode="stateful").collect()
    assert sorted((r.timestamp_ns // MS, r.syscall_result) for r in got) == [(0, 1), (10, 2)]


def chain(spark, rows, depth=1024):
    got = enrich.ancestry_chain(spark.createDataFrame(rows, "pid bigint, parent_pid bigint"), depth).collect()
    return {r.pid: ([p.pid for p in r.ancestry_chain], r.ancestry_truncated) for r in got}


def test_ancestry(spark):
    assert chain(spark, [(1, 0), (10, 1), (20, 10), (30, 20)])[30] == ([1, 10, 20, 30], False)
    assert chain(spark, [(5, 6), (6, 7), (7, 5)])[5] == ([7, 6, 5], False)
    assert chain(spark, [(9, 8), (8, 400)])[9] == ([8, 9], False)
    deep = [(1, 0), *[(i, i - 1) for i in range(2, 1200)]]
    got = chain(spark, deep)
    assert len(got[1199][0]) == 1024 and got[1199][1] and got[1024] == (list(range(1, 1025)), False) and got[1025][1]
    assert chain(spark, [(1, 0), (2, 1)], 1)[2] == ([2], True)


def test_validate_ancestry(spark):
    link = lambda p, q, n="x": Row(pid=p, ppid=q, process_name=n, binary_path="/b")
    schema = "pid bigint, ancestry_truncated boolean, enrichment_partial boolean, ancestry_chain array<struct<pid: bigint, ppid: bigint, process_name: string, binary_path: string>>"
    rows = [
        (4101, False, False, [link(4101, 4100), link(4100, 1), link(1, 0)]),
        (5101, False, False, [link(5101, 5100), link(5100, 5000), link(5000, 5101), link(5101, 5100)]),
        (1, False, False, []),
        (7, False, False, [link(8, 1), link(1, 0)]),
        (9, False, False, [link(9, 0), link(1, 0)]),
        (11, False, True, [link(11, 10), link(10, 3)]),
        (12, True, False, [link(12, 10)]),
        (13, False, False, [link(13, 0), link(0, 0, "kthreadd")][:1] + [link(0, 0, "kthreadd")]),
    ]
    got = enrich.validate_ancestry(spark.createDataFrame(rows, schema)).collect()
    assert [r.code for r in got] == [0, 3, 2, 2, 5, 4, 0, 5]
    assert {r.partial_code for r in got} == {6}


def test_proc_snapshots(spark):
    status = "Name:\tmy proc\nTgid:\t7\nPPid:\t3\nUid:\t1000\t1000\t1000\t1000\n"
    stat = "7 (my (odd) proc) S 0 " + " ".join(str(i) for i in range(5, 22)) + " 98765 0"
    rows = [(7, status, stat), (8, "Name:\tx\n", stat)]
    got = enrich.parse_proc_snapshots(spark.createDataFrame(rows, "pid bigint, status_text string, stat_text string")).collect()
    assert (got[0].process_name, got[0].stat_name, got[0].uid, got[0].parent_pid, got[0].start_time_ticks, got[0].reject_kind) == ("my proc", "my (odd) proc", 1000, 3, 98765, None)
    assert got[1].reject_kind == "tgid"


def test_generations_follow_reuse(spark):
    rows = [event(1, 5, "Execve", pid=9), event(2, 25, "Execve", pid=9), event(3, 30, "Clone", pid=2, child=9), event(4, 40, "Execve", pid=9)]
    births = spark.createDataFrame([(9, 0, 100, 1), (9, 20, 200, 7)], "pid bigint, start_ns bigint, start_time_ticks bigint, parent_pid bigint")
    got = {r.event_id: (r.start_time_ticks, r.parent_pid) for r in enrich.pid_generation(table(spark, rows), births).collect()}
    assert got == {1: (100, 1), 2: (200, 7), 3: (None, None), 4: (None, None)}


def nodes(spark):
    return spark.createDataFrame(
        [(0, 0, "LT", 0, 5.0, 1, 2, True, None), (0, 1, "LEAF", None, None, None, None, None, -1.0), (0, 2, "LE", 0, 9.0, 3, 4, False, None), (0, 3, "LEAF", None, None, None, None, None, 0.4), (0, 4, "LEAF", None, None, None, None, None, 2.0)],
        "tree_id int, node_id int, mode string, feature_index int, threshold double, true_node int, false_node int, missing_true boolean, weight double",
    )


def test_scorers_agree_on_borders(spark):
    flat = spark.createDataFrame([(i, [v]) for i, v in enumerate([4.0, 5.0, 9.0, 9.5, float("nan")])], "i int, x array<float>")
    a = {r.i: r.threat_score for r in scoring.score_case(flat, nodes(spark), 0.5).collect()}
    b = {r.i: r.threat_score for r in scoring.score_trees(flat, nodes(spark), 0.5).collect()}
    want = {i: 1 / (1 + math.exp(-(0.5 + w))) for i, w in enumerate([-1.0, 0.4, 0.4, 2.0, -1.0])}
    assert all(math.isclose(a[i], want[i]) and math.isclose(b[i], want[i]) for i in want)
    parts = {r.i: [(c.feature_name, c.contribution_score) for c in r.contributions] for r in scoring.attribute_paths(flat, nodes(spark), ("f",)).collect()}
    assert parts[1] == [("f", 0.4)] and parts[0] == [("f", -1.0)]


def test_node_problems(spark):
    bad = spark.createDataFrame([(0, 0, "LT", 99, 1.0, 1, 7, True, None), (0, 1, "LEAF", None, None, None, None, None, None), (0, 1, "ODD", 1, 1.0, None, None, None, None)], nodes(spark).schema)
    got = {r.problem for r in scoring.model_from_nodes(bad).collect()}
    assert got == {"feature index out of range", "leaf without weight", "unknown mode", "missing child", "repeated node"}
    assert scoring.model_from_nodes(nodes(spark)).isEmpty() and scoring.model_schema_check(nodes(spark)).first().ok


def test_top_features_and_alerts(spark):
    contribs = [Row(feature_name="b", contribution_score=-2.0), Row(feature_name="a", contribution_score=2.0), Row(feature_name="pid", contribution_score=float("nan"))]
    df = spark.createDataFrame([(1, 0, 0, S, 0.7, "m", contribs), (2, 0, 0, S, 0.69, "m", [])], "pid bigint, lifetime bigint, window_start_ns bigint, window_end_ns bigint, threat_score double, model_hash string, contributions array<struct<feature_name: string, contribution_score: double>>")
    known = spark.createDataFrame([(1, 0, 0, "x ffff0123456789ab\n", None)], "pid bigint, lifetime bigint, window_start_ns bigint, process_name string, binary_path string")
    got = alerts.build_alerts(df, known, 0.7, 41).collect()
    assert [r.alert_id for r in got] == [42]
    r = got[0]
    assert [c.feature_name for c in r.top_features] == ["a", "b", "pid", MANIFEST[1], MANIFEST[2]] and r.top_features[2].contribution_score == 0.0
    assert r.process_name == "x [redacted-kernel-pointer] " and r.binary_path == "/proc/1/exe"
    assert r.summary.startswith("x [redacted-kernel-pointer]  (pid 1) scored 0.7000 against threshold 0.7000; top contributors: a=2.000, b=-2.000")
    assert [c.pid for c in r.ancestry_chain] == [1]
    with pytest.raises(ValueError, match="threshold"):
        alerts.alert_filter(df, 1.5)


def test_alert_ids_are_dense_over_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5000).alias("timestamp_ns"), F.col("id").alias("pid"))
    got = alerts.alert_ids(df, 10).orderBy("alert_id").collect()
    assert [r.alert_id for r in got] == list(range(11, 5011)) and [r.timestamp_ns for r in got] == sorted(r.timestamp_ns for r in got)


def test_timeline(spark):
    import datetime as dt

    minutes, scores = [10, 15, 8, 25, 5, 20, 45, 70, 90, 120], [0.75, 0.76, 0.85, 0.86, 0.95, 0.96, 0.84, 0.88, 0.93, 0.97]
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(i, now - dt.timedelta(minutes=m), 1, None, None, None, s, None, None, None) for i, (m, s) in enumerate(zip(minutes, scores, strict=True))]
    df = spark.createDataFrame(rows, ALERT)
    assert explore.alert_timeline(df, "medium+", "30m", now).count() == 4
    assert explore.alert_timeline(df, "high", "all").count() == 4
    assert explore.latest_alerts(df, 3).first().alert_id == 4


def test_scalars(spark):
    df = spark.createDataFrame([("/usr/lib/x", 2048.0, 0.3, 3661), ("", 12.0, float("nan"), 0), (None, 3.5 * 1024**3, None, 59)], "p string, n double, s double, d int")
    got = df.select(fn.path_prefix(F.col("p")).alias("a"), fn.fmt_bytes(F.col("n")).alias("b"), fn.threat_band(F.col("s")).alias("c"), fn.fmt_duration(F.col("d")).alias("d"), fn.shorten_path(F.col("p"), 6).alias("e"), fn.clamp01(F.col("s")).alias("f")).collect()
    assert [tuple(r) for r in got] == [("/usr/lib", "2.0 KiB", "medium", "01:01:01", ".../lib/x", 0.3), ("", "12 B", "unscored", "00:00:00", "unknown path", 0.0), ("", "3.5 GiB", "unscored", "00:00:59", "unknown path", 0.0)]
    text = spark.createDataFrame([("a\x00b\x85", "[{'name': 'pathname', 'type': 'x', 'value': '/p'}, {'name': 'flags', 'value': 'O_CREAT'}]")], "t string, a string")
    r = text.select(fn.clean_control(F.col("t")).alias("t"), fn.args_path(F.col("a")).alias("p"), fn.args_flags(F.col("a")).alias("f"), fn.args_literal(F.col("a")).alias("l")).first()
    assert (r.t, r.p, r.f, r.l.path, r.l.flags) == ("a�b�", "/p", "O_CREAT", "/p", "O_CREAT")


def test_filters_reject_bad_names(spark):
    df = table(spark, GOLDEN)
    assert ingest.filter_syscalls(df, ["openat", "openat"]).count() == 2
    with pytest.raises(ValueError, match="empty"):
        ingest.filter_syscalls(df, [])
    with pytest.raises(ValueError, match="unknown syscall fork"):
        ingest.filter_syscalls(df, ["fork"])


def test_reports(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    assert {r.p: r.value for r in reports.nearest_rank(df, "v", [50, 99, 100]).collect()} == {50.0: 50.0, 99.0: 99.0, 100.0: 100.0}
    flat = spark.createDataFrame([(0.0, 5.0), (1.0, 5.0)], "elapsed_seconds double, rss_bytes double")
    assert reports.leak_slope(flat, 100).first().mib_per_hour == 0.0
    hits = spark.createDataFrame([(0,), (1,), (6,)], "ts_ns bigint")
    assert [(r.hits, r.all_hit) for r in reports.bucketed_hits(hits, 0, 8).orderBy("bucket").collect()] == [(2, False), (0, False), (0, False), (1, False)]


def test_log_diff_offsets(spark):
    a = spark.createDataFrame([(0, "abc"), (1, "defg"), (2, "h")], "line_no bigint, line string")
    b = spark.createDataFrame([(0, "abc"), (1, "deXg")], "line_no bigint, line string")
    r = explore.log_diff(a, b).first()
    assert (r.expected_bytes, r.observed_bytes, r.first_difference, r.different_lines, r.in_head) == (11, 9, 6, 2, True)
    assert explore.log_diff(a, a).first().first_difference is None


def test_split_roles_and_ranking(spark):
    from fleetlens.operators import priors

    good = spark.createDataFrame([("train", "validation", "train+validation", "test")], "priors string, grid_search string, final_model string, evaluation string")
    assert priors.split_roles_check(good).first().ok
    m = spark.createDataFrame([(50, 3, 0.1, 0.90, 0.99, 0.1), (100, 3, 0.1, 0.96, 0.95, 0.2), (50, 3, 0.1, 0.96, 0.95, 0.2)], "estimators int, depth int, rate double, tpr double, f1 double, fpr double")
    assert [r.estimators for r in training.rank_candidates(m).collect()] == [50, 100, 50]


NODE = "tree_id int, node_id int, mode string, feature_index int, threshold double, true_node int, false_node int, missing_true boolean, weight double"


def branch(tree, node, yes, no):
    return (tree, node, "LT", 0, 0.5, yes, no, False, None)


def leaf(tree, node):
    return (tree, node, "LEAF", None, None, None, None, None, 0.1)


@pytest.mark.parametrize(
    ("rows", "problems"),
    [
        ([branch(0, 0, 1, 2), leaf(0, 1), leaf(0, 2)], set()),
        ([branch(0, 0, 1, 2), branch(0, 1, 3, 2), branch(0, 3, 1, 4), leaf(0, 2), leaf(0, 4)], {(1, "several parents"), (2, "several parents")}),
        ([branch(0, 0, 4, 2), branch(0, 1, 3, 5), branch(0, 3, 1, 6), *[leaf(0, k) for k in (2, 4, 5, 6)]], {(1, "circle"), (3, "circle"), (5, "circle"), (6, "circle")}),
        ([branch(0, 0, 1, 2), leaf(0, 1), leaf(0, 2), branch(0, 3, 4, 5), leaf(0, 4), leaf(0, 5)], {(3, "second root"), (4, "not reached"), (5, "not reached")}),
        ([branch(0, 0, 0, 1), leaf(0, 1)], {(0, "circle"), (1, "circle")}),
    ],
)
def test_shapes_of_a_model(spark, rows, problems):
    nodes = spark.createDataFrame(rows, NODE)
    assert {(r.node_id, r.problem) for r in scoring.model_from_nodes(nodes).collect()} == problems
    flat = spark.createDataFrame([(1, [0.0])], "pid int, x array<float>")
    for score in (scoring.score_trees, scoring.score_case):
        if problems:
            with pytest.raises(ValueError, match="nodes:"):
                score(flat, nodes)
        else:
            assert score(flat, nodes).count() == 1


def test_a_deep_tree(spark):
    """300 levels: places by doubling, attribution to the last level."""
    n = 300
    nodes = spark.createDataFrame([branch(0, 2 * k, 2 * k + 1, 2 * k + 2) for k in range(n)] + [leaf(0, 2 * k + 1) for k in range(n)] + [leaf(0, 2 * n)], NODE)
    places = {r.node_id: (r.depth, r.top, r.circle) for r in scoring.node_places(nodes).collect()}
    assert places[2 * n] == (n, 0, False) and places[1] == (1, 0, False)
    flat = spark.createDataFrame([(1, [9.0])], "pid int, x array<float>")
    assert scoring.score_trees(flat, nodes, transform="NONE").first().threat_score == pytest.approx(0.1)
    few = spark.createDataFrame([branch(0, 2 * k, 2 * k + 1, 2 * k + 2) for k in range(40)] + [leaf(0, 2 * k + 1) for k in range(40)] + [leaf(0, 80)], NODE)
    got = scoring.attribution_table(flat, few, ["pid"]).collect()
    assert [round(r.contribution_score, 9) for r in got] == [0.1]


def test_args_of_every_shape(spark):
    plain = "[{'name': 'dirfd', 'type': 'int', 'value': -100}, {'name': 'pathname', 'type': 'const char*', 'value': '/etc/x'}, {'name': 'flags', 'type': 'int', 'value': 'O_RDWR'}]"
    cases = [
        (plain, "/etc/x", "O_RDWR"),
        (plain[:-1], None, ""),  # broken
        (plain + "]", None, ""),
        ("""[{"name": "pathname", "value": "it's"}]""", "it's", ""),
        ("[{'value': '/late', 'name': 'path'}]", "/late", ""),
        ("[{'name': 'pathname', 'value': 3}, {'name': 'path', 'value': '/b'}]", "/b", ""),
        ("[{'name': 'pathname', 'value': 'a{b}'}]", "a{b}", ""),
        ("[]", None, ""),
        (None, None, ""),
        ("[" + "{'name': 'x', 'value': 1}, " * 20_000 + "{'name': 'path', 'value': '/end'}]", "/end", ""),
    ]
    df = spark.createDataFrame([(k, a) for k, (a, _, _) in enumerate(cases)], "k int, a string")
    got = {r.k: (r.p, r.f) for r in df.select("k", fn.args_path(F.col("a")).alias("p"), fn.args_flags(F.col("a")).alias("f")).collect()}
    assert got == {k: (p, f) for k, (_, p, f) in enumerate(cases)}


def slow_dedup(rows, width):
    """The rule of arrival order on one window, record by record."""
    records, newest = [], None
    for event, ts, kind, name, n in sorted(rows):
        hit = None
        if kind == "Openat" and name is not None and (newest is None or ts >= newest):
            for r in reversed(records):
                if r["kind"] != "Openat":
                    break
                if r["name"] == name:
                    hit = r if ts - r["last"] < width else None
                    break
        newest = ts if newest is None else max(newest, ts)
        if hit is None:
            records.append({"event": event, "kind": kind, "name": name, "last": ts, "n": n})
        else:
            hit["last"], hit["n"] = ts, hit["n"] + n
    return sorted((r["event"], r["n"]) for r in records)


def test_dedup_in_arrival_order(spark):
    """Rows out of order, runs of opens broken by other calls, repeats that count more than once."""
    rng, rows = random.Random(12), []
    for w in range(6):
        for k in range(120):
            kind = "Openat" if rng.random() < 0.9 else "Execve"
            rows.append((w * 1000 + k, w, (k * 20 + rng.randrange(-60, 60)) * 1_000_000, kind, rng.choice(["a", "b", "c", None]), rng.choice([1, 1, 3])))
    df = spark.createDataFrame(rows, "event_id bigint, window_start_ns bigint, timestamp_ns bigint, syscall_type string, filename string, repeat_count bigint").withColumns({"pid": F.lit(1), "lifetime": F.lit(0)})
    got = windows.dedup_openat(df, 100, ordered=False).collect()
    want = [x for w in range(6) for x in slow_dedup([(e, ts, kind, name, n) for e, v, ts, kind, name, n in rows if v == w], 100_000_000)]
    assert sorted((r.event_id, r.repeat_count) for r in got) == sorted(want)
