"""Further registered queries: sources and sinks there and back, parsing, checks of models and records, odd texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions import scalars as fn
from fleetlens.operators import alerts, enrich, explore, features, priors, scoring, training, windows
from fleetlens.plans.queries import ALERTS, DEDUP_MS, IDENTITY, KEY, LABELLED, SCORED, THRESHOLD, TRIALS, W, WHOLE_CHAINS, WINDOW_S, catalogue, corpus, duck, metrics, registered, scored, scored_alerts, trials, vectors, windowed
from fleetlens.plans.views import view
from fleetlens.schemas import CORPUS, SYSCALL
from fleetlens.sources import readers, writers
from fleetlens.storage import new_path

NANO = windows.NS

# --- sources and sinks, there and back ------------------------------------------------------------------------------


@registered("csv_corpus", duck("corpus", f"{LABELLED} select processId as pid, eventName as event, processName as name, returnValue as result, label, path, path_prefix, count(*)::bigint as n from lp group by all"))
def csv_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_path(spark, "corpus-csv")
    view(spark, sf_dir, "corpus").select(*CORPUS.fieldNames()).write.option("header", True).option("quote", '"').option("escape", '"').csv(place)
    got = readers.src_labelled_csv(spark, place)
    return got.groupBy(F.col("processId").alias("pid"), F.col("eventName").alias("event"), F.col("processName").alias("name"), F.col("returnValue").alias("result"), "label", "path", "path_prefix").agg(F.count("*").alias("n"))


@registered("alert_log_rows", duck("syscalls names", f"{ALERTS} select alert_id::bigint as alert_id, pid, process_name, binary_path, round(threat_score, 9) as threat_score, window_end_ns // 1000 as ts_us, 5 as n_features from al"))
def alert_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts appended in two goes and read again."""
    place, rows = new_path(spark, "alert-log"), scored_alerts(spark, sf_dir)
    for part in (0, 1):
        writers.sink_alert_log(rows.filter(F.col("alert_id") % 2 == part), place)
    got = readers.src_alert_log(spark, place)
    return got.select("alert_id", "pid", "process_name", "binary_path", F.round("threat_score", 9).alias("threat_score"), F.unix_micros("timestamp").alias("ts_us"), F.size("top_features").alias("n_features"))


@registered("inference_log_rows", duck("syscalls", f"{SCORED} select pid, window_end_ns as timestamp_ns, round(threat_score, 9) as threat_score, 'm1' as model_hash, 5 as n_features from sc"))
def inference_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_path(spark, "inference-log")
    full = scoring.attribute_paths(scored(spark, sf_dir), view(spark, sf_dir, "model_nodes")).withColumn("model_hash", F.lit("m1"))
    log = alerts.inference_log(full)
    writers.sink_inference_log(log, place)
    return spark.read.schema(log.schema).json(place).select("pid", "timestamp_ns", F.round("threat_score", 9).alias("threat_score"), "model_hash", F.size("top_features").alias("n_features"))


@registered("record_log_rows", duck("processes", f"""{WHOLE_CHAINS}, x as (select pid, case when pid % 13 = 0 then -1 else pid end as shown, case when pid % 13 = 0 then null else depth end as links, pid % 13 = 0 as rejected from ch where pid % 13 = 0 or pid % 10 <> 0)
select shown as pid, links::bigint as links, rejected, count(*)::bigint as n from x group by all"""))
def record_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains as mixed JSON lines: some of another type, some cut off in the middle."""
    chains, place = enrich.ancestry_chain(view(spark, sf_dir, "processes")), new_path(spark, "record-log")
    links = F.transform("ancestry_chain", lambda p: F.struct(p["pid"].alias("pid"), p["process_name"].alias("process_name")))
    record = F.to_json(F.struct(F.when((F.col("pid") % 10 == 0), "other").otherwise("ancestry").alias("record_type"), "pid", links.alias("ancestry_chain")))
    chains.select(F.when(F.col("pid") % 13 == 0, F.substring(record, 1, 20)).otherwise(record).alias("value")).write.text(place)
    got = readers.src_record_log(spark, place, "ancestry")
    bad = F.col("reject_line").isNotNull()
    return got.select(F.when(bad, -1).otherwise(F.col("pid")).alias("pid"), F.when(~bad, F.size("ancestry_chain")).cast("bigint").alias("links"), bad.alias("rejected")).groupBy("pid", "links", "rejected").agg(F.count("*").alias("n"))


@registered("feature_json_rows", duck("syscalls", f"""{W}, t as (select pid, window_start_ns, syscall_type, lead(syscall_type) over (partition by pid, window_start_ns order by timestamp_ns, event_id) as following from w)
select pid, window_start_ns, count(*)::bigint as total_syscalls, (count(distinct syscall_type || following))::int as n_bigrams from t group by pid, window_start_ns"""))
def feature_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as one JSON document for each process, and read again."""
    place, rows = new_path(spark, "feature-json"), vectors(spark, sf_dir, maps=True)
    document = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*[c for c in rows.columns if c != "lifetime"]))), ","), F.lit("]"))
    rows.groupBy("pid").agg(document.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(place)
    got = readers.src_feature_json(spark, place)
    return got.select("pid", "window_start_ns", "total_syscalls", F.size("bigrams").alias("n_bigrams"))


@registered("prior_catalog_rows", duck("corpus", f"{LABELLED} select family, token, round(rate, 9) as rate from pr"))
def prior_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = new_path(spark, "prior-catalog")
    writers.sink_prior_catalog(catalogue(spark, sf_dir), place, {"source": "train"})
    return readers.src_prior_catalog(spark, place).select("family", "token", F.round("rate", 9).alias("rate"))


METRICS = """m as (select count(*) filter (s >= 0.5 and label = 1) as tp, count(*) filter (s < 0.5 and label = 0) as tn, count(*) filter (s >= 0.5 and label = 0) as fp, count(*) filter (s < 0.5 and label = 1) as fn from tl)"""


@registered("metrics_file", duck("e", f"{TRIALS}, {METRICS} select tp::bigint as tp, tn::bigint as tn, round(2 * tp / (2 * tp + fp + fn), 9) as f1, round(fp / (fp + tn), 9) as fpr from m"))
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    place, made = new_path(spark, "metrics"), metrics(spark, sf_dir)
    writers.sink_metrics(made, place)
    return spark.read.schema(made.schema).json(place).select("tp", "tn", "f1", "fpr")


@registered("manifest_row", duck("e", "x as (select 1) select 1337::bigint as seed, 'train' as priors, sha256('events ' || count(*) || chr(10)) as artifact from e"))
def manifest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest about one artifact, whose text tells the number of events."""
    artifact, place = new_path(spark, "artifact"), new_path(spark, "manifest")
    view(spark, sf_dir, "e").agg(F.concat(F.lit("events "), F.count("*")).alias("value")).coalesce(1).write.text(artifact)
    writers.sink_manifest(spark, place, 1337, {"priors": "train", "evaluation": "test"}, {"depth": [3]}, [artifact])
    got = spark.read.schema("seed bigint, split_roles struct<priors: string>, artifacts array<struct<sha256: string>>").json(place)
    return got.select("seed", "split_roles.priors", F.get("artifacts.sha256", F.lit(0)).alias("artifact"))


@registered("stream_files", duck("syscalls", "x as (select 1) select pid, syscall_type, count(*)::bigint as n, max(timestamp_ns) as last_ns from syscalls group by all"))
def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as files, read as a stream and drained to a table."""
    place = new_path(spark, "stream-files")
    view(spark, sf_dir, "syscalls").write.parquet(f"{place}/in")
    stream = readers.src_stream(spark, "parquet", {"path": f"{place}/in"}, SYSCALL)
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(SYSCALL).parquet(f"{place}/out").groupBy("pid", "syscall_type").agg(F.count("*").alias("n"), F.max("timestamp_ns").alias("last_ns"))


# --- processes ------------------------------------------------------------------------------------------------------


@registered("snapshots_parsed", duck("e", """u as (select distinct u from e), p as (select 1000 + u as pid, u from u)
select pid, 'proc_' || u as process_name, case when u % 17 <> 3 then u end as uid, case when u % 5 = 0 then 77 + u else 1 + u end as parent_pid, 'x) (' || u as stat_name, case when u % 19 <> 4 then 100 * u end as start_time_ticks,
    case when u % 17 = 3 then 'uid' when u % 19 = 4 then 'start_time_ticks' end as reject_kind from p"""))
def snapshots_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured texts with brackets in the name, a parent only one file knows, and lines cut short."""
    u = view(spark, sf_dir, "e").select("u").distinct()
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    n = F.col("u")
    uid = F.when(n % 17 != 3, text("Uid:\t", n, "\t0\t0\t0\n")).otherwise("")
    status = F.concat(text("Name:\tproc_", n, "\nTgid:\t", 1000 + n, "\nPPid:\t", 77 + n, "\n"), uid)
    rest = F.concat(F.lit(" S "), F.when(n % 5 == 0, 0).otherwise(1 + n).cast("string"), F.repeat(F.lit(" 7"), 17), F.when(n % 19 != 4, text(" ", 100 * n, " 5")).otherwise(""))
    captures = u.select((1000 + n).alias("pid"), status.alias("status_text"), F.concat(text(1000 + n, " (x) (", n, ")"), rest).alias("stat_text"))
    return enrich.parse_proc_snapshots(captures).select("pid", "process_name", "uid", "parent_pid", "stat_name", "start_time_ticks", "reject_kind")


@registered("pid_generations", duck("syscalls", """ev as (select event_id, pid, timestamp_ns, case when syscall_type = 'Clone' then 1000 + (pid - 999) % 40 end as child_pid from syscalls),
born as (select pid, min(timestamp_ns) + 1 as timestamp_ns, 1 as ticks, 7 as parent from ev group by pid union all select pid, 1705000000000000000 + pid, 2, 8 from ev group by pid),
un as (select pid, timestamp_ns, 0 as ord, null::bigint as event_id, {'t': null::bigint, 'p': null::bigint} as life from (select child_pid as pid, timestamp_ns from ev where child_pid is not null) c
    union all select pid, timestamp_ns, 1, null, {'t': ticks::bigint, 'p': parent::bigint} from born union all select pid, timestamp_ns, 2, event_id, null from ev),
la as (select *, last_value(life ignore nulls) over (partition by pid order by timestamp_ns, ord rows unbounded preceding) as l from un) select event_id, pid, l.t as start_time_ticks, l.p as parent_pid from la where ord = 2"""))
def pid_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two known starts for each pid, and clones that take pids in use."""
    events = view(spark, sf_dir, "syscalls").withColumn("child_pid", F.when(F.col("syscall_type") == "Clone", 1000 + (F.col("pid") - 999) % 40))
    row = lambda ns, ticks, parent: F.struct(ns.alias("start_ns"), F.lit(ticks).cast("bigint").alias("start_time_ticks"), F.lit(parent).cast("bigint").alias("parent_pid"))
    starts = events.groupBy("pid").agg(F.min("timestamp_ns").alias("first")).select("pid", F.inline(F.array(row(F.col("first") + 1, 1, 7), row(F.col("pid") + 1_705_000_000_000_000_000, 2, 8))))
    return enrich.pid_generation(events, starts).select("event_id", "pid", "start_time_ticks", "parent_pid")


@registered("ancestry_check_codes", duck("processes", f"""{WHOLE_CHAINS} select pid, case when pid % 6 = 0 then 2 when pid % 6 = 1 then 3 when pid % 6 = 2 and depth > 1 then 5 when pid % 6 = 3 then 2 when top = 1 then 0 else 4 end as code,
    case when (select avg(case when pid % 3 = 0 then 1 else 0 end) from ch) > 0.05 then 6 else 0 end as partial_code from ch"""))
def ancestry_check_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains spoilt in each way that the check knows: empty, a pid twice, parent 0 in the middle, another leaf, no root."""
    chains, way = enrich.ancestry_chain(view(spark, sf_dir, "processes")), F.col("pid") % 6
    entry = lambda p, i: F.struct(p["pid"].alias("pid"), F.when((way == 2) & (i == 0), 0).otherwise(1).cast("bigint").alias("ppid"), p["process_name"].alias("process_name"), p["binary_path"].alias("binary_path"))
    leaf_first = F.transform(F.reverse("ancestry_chain"), entry)
    spoilt = F.when(way == 0, F.slice(leaf_first, 1, 0)).when(way == 1, F.concat(leaf_first, leaf_first)).when(way == 3, F.slice(leaf_first, F.lit(2), F.greatest(F.size(leaf_first) - 1, F.lit(0)))).otherwise(leaf_first)
    records = chains.select("pid", "ancestry_truncated", (F.col("pid") % 3 == 0).alias("enrichment_partial"), spoilt.alias("ancestry_chain"))
    return enrich.validate_ancestry(records).select("pid", "code", "partial_code")


# --- windows, alerts, texts -----------------------------------------------------------------------------------------

CHANGE, LONGER = 1_705_000_000_000_000_000, 2 * WINDOW_S * NANO
SHORTER, THIRD = WINDOW_S * NANO // 3, 1_705_900_000_000_000_000


def _settings_sql() -> str:
    """Two changes of length, window ends carried from one to the next."""
    size = WINDOW_S * NANO
    return f"""s as (select pid, min(timestamp_ns) as f1, max(timestamp_ns) filter (timestamp_ns < {CHANGE}) as l1, min(timestamp_ns) filter (timestamp_ns >= {CHANGE} and timestamp_ns < {THIRD}) as f2, max(timestamp_ns) filter (timestamp_ns >= {CHANGE} and timestamp_ns < {THIRD}) as l2,
    min(timestamp_ns) filter (timestamp_ns >= {THIRD}) as f3 from syscalls group by pid),
a1 as (select *, case when l1 is not null then f1 + (l1 - f1) // {size} * {size} end as s1, case when l1 is not null then f1 + ((l1 - f1) // {size} + 1) * {size} end as e1 from s),
a2 as (select *, coalesce(e1, f2) as b2 from a1),
a3 as (select *, case when l2 >= b2 then b2 + (l2 - b2) // {LONGER} * {LONGER} else s1 end as s2, case when l2 >= b2 then b2 + ((l2 - b2) // {LONGER} + 1) * {LONGER} else e1 end as e2 from a2),
a as (select *, coalesce(e2, f3) as b3 from a3),
r as (select y.event_id, y.pid, case when timestamp_ns < {CHANGE} then f1 + (timestamp_ns - f1) // {size} * {size}
    when timestamp_ns < {THIRD} then case when timestamp_ns >= b2 then b2 + (timestamp_ns - b2) // {LONGER} * {LONGER} else s1 end
    when timestamp_ns >= b3 then b3 + (timestamp_ns - b3) // {SHORTER} * {SHORTER} else s2 end as window_start_ns,
    case when timestamp_ns < {CHANGE} then f1 + ((timestamp_ns - f1) // {size} + 1) * {size}
    when timestamp_ns < {THIRD} then case when timestamp_ns >= b2 then b2 + ((timestamp_ns - b2) // {LONGER} + 1) * {LONGER} else e1 end
    when timestamp_ns >= b3 then b3 + ((timestamp_ns - b3) // {SHORTER} + 1) * {SHORTER} else e2 end as window_end_ns from syscalls y join a on y.pid = a.pid)
select pid, window_start_ns, window_end_ns, count(*)::bigint as n from r group by all"""


#: The widths of the three settings; a window has that of the setting at the event that opened it.
WIDTHS_MS = (DEDUP_MS, DEDUP_MS // 50, 6 * DEDUP_MS)
WIDTH_SQL = _settings_sql().rsplit("select pid", 1)[0] + f""", born as (select pid, window_start_ns, window_end_ns, min(timestamp_ns) as opened from r join syscalls using (pid, event_id) group by all),
rw as (select y.*, window_start_ns, case when opened < {CHANGE} then {WIDTHS_MS[0]} when opened < {THIRD} then {WIDTHS_MS[1]} else {WIDTHS_MS[2]} end * 1000000::bigint as width
    from r join born using (pid, window_start_ns, window_end_ns) join syscalls y using (pid, event_id)),
k1 as (select *, sum(case when syscall_type = 'Openat' then 0 else 1 end) over (partition by pid, window_start_ns order by timestamp_ns, event_id rows unbounded preceding) as run, case when syscall_type = 'Openat' then -1 else event_id end as alone from rw),
k2 as (select *, case when timestamp_ns - lag(timestamp_ns) over (partition by pid, window_start_ns, run, alone, {IDENTITY} order by timestamp_ns, event_id) < width then 0 else 1 end as fresh from k1)
select pid, window_start_ns, width as dedup_ns, sum(fresh)::bigint as records, count(*)::bigint as events from k2 group by all"""


@registered("windows_of_changed_width", duck("syscalls", WIDTH_SQL))
def windows_of_changed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of length and de-duplication width that change twice: records left of each window's events."""
    rows = [(at, size, float(width)) for at, size, width in zip((0, CHANGE, THIRD), (WINDOW_S, 2 * WINDOW_S, WINDOW_S // 3), WIDTHS_MS, strict=True)]
    settings = spark.createDataFrame(rows, "effective_ns bigint, window_s bigint, dedup_ms double")
    records = windows.dedup_openat(windows.window_reconfigure(view(spark, sf_dir, "syscalls"), settings))
    return records.groupBy("pid", "window_start_ns", "dedup_ns").agg(F.count("*").alias("records"), F.sum("repeat_count").alias("events"))


@registered("windows_of_changed_length", duck("syscalls", _settings_sql()))
def windows_of_changed_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = spark.createDataFrame([(0, WINDOW_S), (CHANGE, 2 * WINDOW_S), (THIRD, WINDOW_S // 3)], "effective_ns bigint, window_s bigint")
    return windows.window_reconfigure(view(spark, sf_dir, "syscalls"), settings).groupBy("pid", "window_start_ns", "window_end_ns").agg(F.count("*").alias("n"))


@registered("alert_chains", duck("syscalls names processes", f"""{ALERTS}, {WHOLE_CHAINS},
an as (select al.*, seen, case when al.pid % 4 = 0 then 'at [redacted-kernel-pointer] line' when process_name = 'unknown-process' and seen is not null then 'proc_' || (al.pid - 1000) % 20 else process_name end as shown from al left join ch on ch.pid = al.pid)
select alert_id::bigint as alert_id, pid, case when seen is null then '' || pid else array_to_string(list_reverse(seen), '/') end as chain, shown as process_name, printf('%s (pid %d) scored %.4f', shown, pid, threat_score) as says from an"""))
def alert_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with whole chains; some process names hold a kernel pointer and a line break."""
    names = view(spark, sf_dir, "names").withColumns({"process_name": F.when(F.col("pid") % 4 == 0, "at 0xFFFF888012345678\nline").otherwise(F.col("process_name"))})
    names = names.withColumns({"binary_path": F.when(F.col("pid") % 4 == 0, F.coalesce("binary_path", F.lit("/x"))).otherwise(F.col("binary_path"))})
    rows = windows.window_anchored(enrich.enrich_process(view(spark, sf_dir, "syscalls"), names), WINDOW_S)
    chains = enrich.ancestry_chain(view(spark, sf_dir, "processes")).select("pid", "ancestry_chain")
    known = alerts.window_identity(rows.drop("ancestry_chain")).join(chains, "pid", "left")
    full = scoring.attribute_paths(scored(spark, sf_dir), view(spark, sf_dir, "model_nodes")).withColumn("model_hash", F.lit("m1"))
    got = alerts.build_alerts(full, known, THRESHOLD, 1000)
    return got.select("alert_id", "pid", F.array_join(F.transform("ancestry_chain", lambda p: p["pid"]), "/").alias("chain"), "process_name", F.substring_index("summary", " against", 1).alias("says"))


@registered("latest_alert_rows", duck("syscalls names", f"{ALERTS} select alert_id::bigint as alert_id, pid from al order by window_end_ns // 1000 desc, alert_id desc limit 64"))
def latest_alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.latest_alerts(scored_alerts(spark, sf_dir)).select("alert_id", "pid")


@registered("degraded_rows", duck("syscalls", f"{W} select distinct pid, window_start_ns, null::double as threat_score, 'degraded' as model_hash, 'no valid model' as degraded_reason from w"))
def degraded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.degraded_scores(features.f_total(windowed(spark, sf_dir)), "no valid model").select(*KEY, "threat_score", "model_hash", "degraded_reason")


@registered("text_functions", duck("syscalls e", """x as (select s.event_id, case when e.k % 7 = 0 then null when e.k % 7 = 1 then '/usr/' || repeat('d', (e.k % 30)::int) || '/lib' || filename else filename end as path, case when e.k % 5 = 0 then 'nan'::double when e.k % 5 = 1 then 'inf'::double else e.value end as odd,
    e.k, e.event_id % 6 as p from syscalls s join e on s.event_id = e.event_id where filename is not null),
y as (select *, list_filter(string_split(path, '/'), lambda z: z <> '') as parts from x)
select event_id, case when path is null then 'unknown path' when length(path) <= 20 then path else '.../' || parts[-2] || '/' || parts[-1] end as short, case when p = 0 then k || ' B' else printf('%.1f', case when p = 5 then k * 1024.0 else k end) || ' ' || ['KiB', 'MiB', 'GiB', 'TiB', 'TiB'][p] end as size,
    'a' || chr(65533) || 'b' || chr(65533) || k as clean, case when k % 5 in (0, 1) then 0 else odd end as finite, 'x [redacted-kernel-pointer] y' || k as redacted from y where k > 0"""))
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = view(spark, sf_dir, "syscalls").join(view(spark, sf_dir, "e").select("event_id", "k", "value"), "event_id").filter("filename is not null and k > 0")
    k, text = F.col("k"), F.col("k").cast("string")
    path = F.when(k % 7 == 0, None).when(k % 7 == 1, F.concat(F.lit("/usr/"), F.repeat(F.lit("d"), (k % 30).cast("int")), F.lit("/lib"), F.col("filename"))).otherwise(F.col("filename"))
    odd = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("inf")).otherwise(F.col("value"))
    return s.select(
        "event_id", fn.shorten_path(path, 20).alias("short"), fn.fmt_bytes((k * F.pow(F.lit(1024), F.col("event_id") % 6)).cast("bigint")).alias("size"), fn.clean_control(F.concat(F.lit("a\x07b\x9b"), text)).alias("clean"),
        fn.finite_or_zero(odd).alias("finite"), fn.redact_pointers(F.concat(F.lit("x ffff8880abcdef01\ny"), text)).alias("redacted"),
    )


# --- models and splits ----------------------------------------------------------------------------------------------


@registered("split_roles", duck("corpus", """g as (select processName as name, case when count(*) filter (split = 'train') > 0 then 'train' else 'none' end as priors, case when count(*) filter (split = 'validation') > 0 then 'validation' else 'none' end as grid_search,
    array_to_string(list_sort(list(distinct split) filter (split <> 'test')), '+') as final_model, case when count(*) filter (split = 'test') > 0 then 'test' else 'none' end as evaluation from corpus group by processName)
select name, priors = 'train' and grid_search = 'validation' and coalesce(final_model, '') = 'train+validation' and evaluation = 'test' as ok from g"""))
def split_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which splits each process name occurs in, as a manifest of roles."""
    has = lambda s: F.when(F.count_if(F.col("split") == s) > 0, s).otherwise("none")
    roles = view(spark, sf_dir, "corpus").groupBy(F.col("processName").alias("name")).agg(
        has("train").alias("priors"), has("validation").alias("grid_search"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("split") != "test", F.col("split")))), "+").alias("final_model"), has("test").alias("evaluation")
    )
    return priors.split_roles_check(roles).select("name", "ok")


MADE_NODES = """nd as (select u as tree_id, k as node_id, case k % 6 when 0 then 'LT' when 1 then 'LE' when 2 then 'LEAF' when 3 then 'LT' when 4 then 'GT' else 'LEAF' end as mode, cast(round(value) as int) - 5 as feature_index, case when k % 9 <> 0 then value end as threshold,
    k + 1 as true_node, case when k % 11 <> 0 then k + 2 end as false_node, case when k % 12 <> 2 then value end as weight from e)"""


def made_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node table from the events, full of faults."""
    e, k = view(spark, sf_dir, "e"), F.col("k")
    mode = F.get(F.array(*map(F.lit, ("LT", "LE", "LEAF", "LT", "GT", "LEAF"))), (k % 6).cast("int"))
    return e.select(F.col("u").alias("tree_id"), k.alias("node_id"), mode.alias("mode"), (F.round("value").cast("int") - 5).alias("feature_index"), F.when(k % 9 != 0, F.col("value")).alias("threshold"), (k + 1).alias("true_node"), F.when(k % 11 != 0, k + 2).alias("false_node"), F.when(k % 12 != 2, F.col("value")).alias("weight"))


@registered("model_problems", duck("e", f"""{MADE_NODES}, ow as (select tree_id, node_id, case when mode not in ('LT', 'LE', 'LEAF') then 'unknown mode' when mode = 'LEAF' and weight is null then 'leaf without weight'
    when mode in ('LT', 'LE') and (feature_index < 0 or feature_index >= {len(scoring.MANIFEST)}) then 'feature index out of range' when mode in ('LT', 'LE') and (threshold is null or false_node is null) then 'branch without threshold or children' end as problem from nd),
kids as (select tree_id, node_id as parent, unnest([true_node, false_node]) as node_id from nd where mode in ('LT', 'LE')), al1 as (select tree_id, node_id, problem from ow where problem is not null
    union all select tree_id, parent, 'missing child' from kids where node_id is not null and (tree_id, node_id) not in (select (tree_id, node_id) from nd) union all select tree_id, node_id, 'repeated node' from nd group by tree_id, node_id having count(*) > 1)
select tree_id, problem, count(*)::bigint as n from al1 group by all"""))
def model_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_shape = ("several parents", "circle", "second root", "not reached")  # in model_shapes
    return scoring.model_from_nodes(made_nodes(spark, sf_dir)).filter(~F.col("problem").isin(*of_shape)).groupBy("tree_id", "problem").agg(F.count("*").alias("n"))


@registered("model_schema", duck("e", f"{MADE_NODES} select count(distinct tree_id)::bigint as trees, count(*)::bigint as nodes, {len(scoring.MANIFEST)}::int as width, count(*) > 0 as ok from nd"))
def model_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.model_schema_check(made_nodes(spark, sf_dir)).select("trees", "nodes", "width", "ok")


SMALL_TREES = {"estimators": 3, "depth": 2, "rate": 0.3}


def flat_split(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    return scoring.flatten_vector(priors.corpus_features(corpus(spark, sf_dir, split), catalogue(spark, sf_dir)))


@registered("tree_probabilities", duck("corpus", f"{LABELLED} select count(*)::bigint as rows, 0::double as difference from lp where split = 'test'"))
def tree_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark ML's probabilities of fitted trees against the scores of their node table: rows and the largest difference."""
    model, test = training.train_trees(flat_split(spark, sf_dir, "train"), SMALL_TREES), flat_split(spark, sf_dir, "test")
    nodes = training.nodes_from_trees(spark, model)
    both = scoring.score(test, model).withColumnRenamed("threat_score", "own")
    got = scoring.score_trees(both, nodes)
    return got.agg(F.count("*").alias("rows"), F.round(F.max(F.abs(F.col("own") - F.col("threat_score"))), 6).alias("difference"))


@registered("grid_rows", duck("corpus", f"{LABELLED} select x.estimators::int as estimators, 2::int as depth, round(0.3::double, 6) as rate, (count(*) filter (label = 1))::bigint as positives, (count(*) filter (label = 0))::bigint as negatives from lp, (select unnest([1, 2]) as estimators) x where split = 'validation' group by x.estimators"))
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate judged on the whole validation split; its hits follow from fitted trees, the totals from the split."""
    got = training.grid_search(flat_split(spark, sf_dir, "train"), flat_split(spark, sf_dir, "validation"), {"estimators": [1, 2], "depth": [2], "rate": [0.3]})
    return got.select("estimators", "depth", F.round("rate", 6).alias("rate"), (F.col("tp") + F.col("fn")).alias("positives"), (F.col("tn") + F.col("fp")).alias("negatives"))


#: A heap of nodes for each user. In every third tree the last node takes node 1 from the first, in every third node 1
#: has one child twice; trees of an even number of nodes have one node too many.
SHAPES = """sh as (select u as tree_id, row_number() over (partition by u order by event_id) - 1 as node_id, count(*) over (partition by u) as n from e),
nd as (select tree_id, node_id, n, 2 * node_id + 2 < n or (tree_id % 3 = 1 and node_id = n - 1) as inner_node, case when tree_id % 3 = 1 and node_id = 0 then 2 when tree_id % 3 = 1 and node_id = n - 1 then 1 when tree_id % 3 = 2 and node_id = 1 then 4 else 2 * node_id + 1 end as true_node,
    case when tree_id % 3 = 1 and node_id = n - 1 then 1 else 2 * node_id + 2 end as false_node from sh)"""
SHAPES_SQL = f"""{SHAPES}, kd as (select tree_id, node_id as parent, unnest([true_node, false_node]) as node_id from nd where inner_node), pa as (select tree_id, node_id, min(parent) as parent, count(*) as parents from kd group by all),
up as (select tree_id, node_id, n, node_id as top, 0 as steps from nd union all select up.tree_id, up.node_id, n, pa.parent, steps + 1 from up join pa on pa.tree_id = up.tree_id and pa.node_id = up.top where steps <= n),
pl as (select tree_id, node_id, max(steps) > any_value(n) as circle, arg_max(top, steps) as top from up group by all)
select tree_id, node_id, case when circle then 'circle' when top = node_id then 'second root' else 'not reached' end as problem from pl where circle or top <> 0
union all select tree_id, node_id, 'several parents' from pa where parents > 1 and (tree_id, node_id) in (select (tree_id, node_id) from nd)
union all select tree_id, parent, 'missing child' from kd where (tree_id, node_id) not in (select (tree_id, node_id) from nd)"""


@registered("model_shapes", duck("e", SHAPES_SQL))
def model_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tables with circles, second roots, nodes under these, and nodes of several parents."""
    by_user = Window.partitionBy("u")
    heap = view(spark, sf_dir, "e").select(F.col("u").alias("tree_id"), (F.row_number().over(by_user.orderBy("event_id")) - 1).cast("bigint").alias("node_id"), F.count("*").over(by_user).alias("n"))
    node, kind, last = F.col("node_id"), F.col("tree_id") % 3, F.col("node_id") == F.col("n") - 1
    inner = (2 * node + 2 < F.col("n")) | ((kind == 1) & last)
    true_node = F.when((kind == 1) & (node == 0), 2).when((kind == 1) & last, 1).when((kind == 2) & (node == 1), 4).otherwise(2 * node + 1)
    false_node = F.when((kind == 1) & last, 1).otherwise(2 * node + 2)
    only = lambda c: F.when(inner, c)
    nodes = heap.select(
        "tree_id", "node_id", F.when(inner, "LT").otherwise("LEAF").alias("mode"), only(F.lit(1)).alias("feature_index"), only(F.lit(0.5)).alias("threshold"), only(true_node).alias("true_node"),
        only(false_node).alias("false_node"), F.when(~inner, 0.1).alias("weight"),
    )
    return scoring.model_from_nodes(nodes)


SPOILT = ("sound", "rate", "test_token", "metric", "split")
PROVENANCE = f"""{LABELLED}, sp as (select unnest({list(SPOILT)!r}) as spoilt),
own as (select spoilt, family, token, rate + case when spoilt = 'rate' and family = 'event' then 1e-9 else 0 end as rate from pr, sp union all select 'test_token', 'process', 'late_proc', 0.5),
lost as (select spoilt, count(*) as n from own join pr using (family, token) where abs(own.rate - pr.rate) > 1e-12 group by spoilt),
more as (select spoilt, count(*) as n from own where (family, token) not in (select (family, token) from pr) group by spoilt),
leak as (select spoilt, count(*) as n from own where family = 'process' and token in (select processName from lp where split = 'test') and token not in (select processName from tr) group by spoilt),
mt as (select spoilt, count(*) filter (s >= 0.7 and label = 1) + case when spoilt = 'metric' then 1 else 0 end as told, count(*) filter (s >= 0.7 and label = 1) as found from (select case when value > 250 then 1 else 0 end as label, k / 100 as s from e) x, sp group by spoilt),
rows_of as (select spoilt, (select count(*) from tr) + case when spoilt = 'split' then (select count(*) from lp where split = 'test') else 0 end as n from sp)
select sp.spoilt, coalesce(lost.n, 0) + coalesce(more.n, 0) = 0 as priors_reproduced, coalesce(leak.n, 0) = 0 as no_leak, mt.told = mt.found as metrics_reproduced, rows_of.n = (select count(*) from tr) as splits_recorded,
    coalesce(lost.n, 0) + coalesce(more.n, 0) = 0 and coalesce(leak.n, 0) = 0 and mt.told = mt.found and rows_of.n = (select count(*) from tr) as passed
from sp left join lost using (spoilt) left join more using (spoilt) left join leak using (spoilt) join mt using (spoilt) join rows_of using (spoilt)"""


@registered("provenance_checks", duck("corpus", PROVENANCE))
def provenance_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sound training run and four spoilt ones: a changed rate, a token of the test split, a changed metric, a train
    split that also holds the test split. Each against what its manifest recorded and what a second computation gives."""
    train, test, rows = corpus(spark, sf_dir, "train"), corpus(spark, sf_dir, "test"), trials(spark, sf_dir)
    sound = catalogue(spark, sf_dir)
    kinds = ["family string", "token string", "rate double"]
    extra = spark.createDataFrame([("process", "late_proc", 0.5)], ", ".join(kinds)).select(*[c for c in sound.columns if c in ("family", "token", "rate")])
    out = []
    for name in SPOILT:
        given = sound.select(*extra.columns)
        given = given.withColumn("rate", F.when(F.col("family") == "event", F.col("rate") + 1e-9).otherwise(F.col("rate"))) if name == "rate" else given.unionByName(extra) if name == "test_token" else given
        metrics = training.binary_metrics(rows)
        told = metrics.withColumn("tp", F.col("tp") + 1) if name == "metric" else metrics
        manifest = priors.provenance(given, train, told)
        seen = train.unionByName(test) if name == "split" else train
        checks = priors.provenance_check(manifest, given, seen, test, training.binary_metrics(rows), reproduced=sound)
        out.append(checks.select(F.lit(name).alias("spoilt"), "priors_reproduced", "no_leak", "metrics_reproduced", "splits_recorded", "passed"))
    return reduce(DataFrame.unionByName, out)


VALUES = "unnest([struct_pack(f := 'p', v := pr1), struct_pack(f := 'e', v := ev1), struct_pack(f := 'a', v := pa1), struct_pack(f := 'x', v := failed), struct_pack(f := 'n', v := named)]) as z"
RATES = f"""{LABELLED}, fx as (select label, coalesce(p.rate, g) as pr1, coalesce(q.rate, g) as ev1, coalesce(t.rate, g) as pa1, (returnValue < 0)::double as failed, (path is not null)::double as named
    from tr cross join gl left join pr p on p.family = 'process' and p.token = processName left join pr q on q.family = 'event' and q.token = eventName left join pr t on t.family = 'path' and t.token = path_prefix),
wt as (select greatest((count(*) filter (label = 0)) / greatest(count(*) filter (label = 1), 1), 1) as weight from fx),
lf as (select {VALUES}, 2 * label - 1 as y, case when label = 1 then weight else 1 end as w from fx, wt),
by_value as (select z.f, z.v, sum(w) as w, sum(w * y) as wy from lf group by all), cuts as (select f, v, sum(w) over o as lw, sum(wy) over o as ly, sum(w) over (partition by f) as tw, sum(wy) over (partition by f) as ty from by_value window o as (partition by f order by v)),
gains as (select f, v, lead(v) over (partition by f order by v) as next_v, ly / lw as at_most, (ty - ly) / nullif(tw - lw, 0) as above,
    (ly * ly / lw + (ty - ly) * (ty - ly) / nullif(tw - lw, 0)) / tw - pow(ty / tw, 2) as gain from cuts)"""


@registered("first_cut", duck("corpus", f"{RATES} select round(max(gain) filter (next_v is not null), 9) as gain from gains"))
def first_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gain of the cut that a boosted model's first tree has at its root; in SQL, the largest gain of all cuts."""
    rows = scoring.flatten_vector(priors.corpus_features(corpus(spark, sf_dir, "train"), catalogue(spark, sf_dir))).select("x", "label")
    model = training.train_trees(rows, {"estimators": 1, "depth": 2, "rate": 0.3})
    return training.cut_gain(rows, *training.root_cut(model)).select(F.round("gain", 9).alias("gain"))


STUMP = f"""{RATES}, best as (select * from gains where next_v is not null order by gain desc limit 1),
vx as (select row_no, label, coalesce(p.rate, g) as pr1, coalesce(q.rate, g) as ev1, coalesce(t.rate, g) as pa1, (returnValue < 0)::double as failed, (path is not null)::double as named
    from (select *, row_number() over () as row_no from lp where split = 'validation') e2 cross join gl left join pr p on p.family = 'process' and p.token = processName left join pr q on q.family = 'event' and q.token = eventName left join pr t on t.family = 'path' and t.token = path_prefix),
vv as (select row_no, label, {VALUES} from vx), pd as (select label, case when z.v <= (best.v + next_v) / 2 then at_most else above end >= 0 as hit from vv join best on z.f = best.f)
select (count(*) filter (hit and label = 1))::bigint as tp, (count(*) filter (not hit and label = 0))::bigint as tn, (count(*) filter (hit and label = 0))::bigint as fp, (count(*) filter (not hit and label = 1))::bigint as fn from pd"""


@registered("stump_metrics", duck("corpus", STUMP))
def stump_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of one candidate, a single tree of one cut: its validation metrics follow from the best cut."""
    table = catalogue(spark, sf_dir)
    flat = lambda split: scoring.flatten_vector(priors.corpus_features(corpus(spark, sf_dir, split), table)).select("x", "label")
    got = training.grid_search(flat("train"), flat("validation"), {"estimators": (1,), "depth": (1,), "rate": (0.3,)})
    return got.select("tp", "tn", "fp", "fn")


@registered("final_run", duck("corpus", f"""{LABELLED} select (count(*) filter (split <> 'test'))::bigint as fitted_rows, (count(*) filter (split = 'test' and label = 1))::bigint as positives, (count(*) filter (split = 'test' and label = 0))::bigint as negatives from lp"""))
def final_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole training run: how many rows the last model was fitted on, and tested on."""
    train, valid, test = (corpus(spark, sf_dir, s) for s in ("train", "validation", "test"))
    _, metrics, manifest = training.train_final(train, valid, test, {"estimators": (2,), "depth": (2,), "rate": (0.3,)})
    told = metrics.select((F.col("tp") + F.col("fn")).alias("positives"), (F.col("fp") + F.col("tn")).alias("negatives"))
    return manifest.select("fitted_rows").join(F.broadcast(told))
