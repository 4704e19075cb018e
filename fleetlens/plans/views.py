"""Adapter views: the `events` table read as telemetry. One SQL text serves Spark and DuckDB.

Only the few functions that differ are filled in by dialect. Each view names the views it reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {
    "us": "unix_micros(cast(ts as timestamp))",
    "k": "cast(get_json_object(props, '$.k') as bigint)",
    "q": "chr(39)",
}
DUCKDB = {"us": "epoch_us(ts)", "k": "cast(json_extract_string(props, '$.k') as bigint)", "q": "chr(39)"}

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "e": (
        (),
        """select event_id, user_id as u, event_type, value, @us as us, @k as k from events""",
    ),
    "syscalls": (
        ("e",),
        """select event_id, us * 1000 as timestamp_ns, 1000 + u as pid, 1000 + u as tid,
    case when u = 0 then 1 else 1000 + cast(floor(u / 2) as bigint) end as ppid, syscall_type,
    case when syscall_type = 'Openat' then
        case k % 5 when 0 then '/etc' when 1 then '/tmp' when 2 then '/dev' when 3 then '/home/u' else '/usr/lib' end
        || '/f' || cast(k % 3 as varchar(9)) end as filename,
    case when syscall_type = 'Connect' then case when k % 3 = 0 then '127' else '10' end || '.0.0.' || cast(k % 7 as varchar(9)) end as ip_address,
    case when syscall_type = 'Connect' then cast(4000 + k % 16 as int) end as port,
    case when syscall_type = 'Clone' then 11000 + u end as child_pid,
    case when syscall_type = 'Openat' then cast(case k % 4 when 0 then 0 when 1 then 1 when 2 then 2 else 64 end as bigint) end as open_flags,
    cast(case when value < 5 then -1 when syscall_type = 'Clone' then 11000 + u else 0 end as int) as syscall_result
from (select *, case event_type when 'error' then 'Execve' when 'purchase' then 'Connect' when 'signup' then 'Clone' else 'Openat' end as syscall_type from e) t""",
    ),
    "names": (
        ("e",),
        """select distinct 1000 + u as pid, case when u % 11 <> 7 then 'proc_' || cast(u % 20 as varchar(9)) end as process_name,
    case when u % 11 <> 7 then '/usr/bin/proc_' || cast(u % 20 as varchar(9)) end as binary_path, u as uid from e""",
    ),
    "raw_phases": (
        ("e", "syscalls"),
        """select s.pid, s.tid, s.ppid, s.timestamp_ns, s.syscall_type, 'enter' as phase, s.filename, s.open_flags, s.ip_address, s.port,
    cast(null as bigint) as child_pid, cast(null as int) as syscall_result from syscalls s where s.syscall_type in ('Openat', 'Connect')
union all
select s.pid, s.tid, s.ppid, s.timestamp_ns + case when e.k % 10 = 1 then 300 else e.k end * 1000000, s.syscall_type, 'exit',
    cast(null as varchar(9)), cast(null as bigint), cast(null as varchar(9)), cast(null as int), cast(null as bigint), s.syscall_result
from syscalls s join e on s.event_id = e.event_id where s.syscall_type in ('Openat', 'Connect') and e.k % 10 <> 0""",
    ),
    "busy_phases": (
        ("e", "syscalls"),
        """select cast(1 + u % 5 as bigint) as pid, cast(1 + u % 5 as bigint) as tid, cast(0 as bigint) as ppid, (us % 60000000) * 1000 as timestamp_ns, s.syscall_type, 'enter' as phase,
    s.filename, s.open_flags, s.ip_address, s.port, cast(null as bigint) as child_pid, cast(null as int) as syscall_result
from syscalls s join e on s.event_id = e.event_id where s.syscall_type in ('Openat', 'Connect') and e.k % 10 <> 2
union all
select cast(1 + u % 5 as bigint), cast(1 + u % 5 as bigint), cast(0 as bigint), (us % 60000000) * 1000 + case e.k % 10 when 1 then 300 when 3 then -20 else e.k end * 1000000, s.syscall_type, 'exit',
    cast(null as varchar(9)), cast(null as bigint), cast(null as varchar(9)), cast(null as int), cast(null as bigint), cast(e.event_id % 1000 as int)
from syscalls s join e on s.event_id = e.event_id where s.syscall_type in ('Openat', 'Connect') and e.k % 10 <> 0""",
    ),
    "processes": (
        ("e",),
        """select distinct 1000 + u as pid, case when u = 0 then 1 when u = 5 then 1011 else 1000 + cast(floor(u / 2) as bigint) end as parent_pid,
    'proc_' || cast(u % 20 as varchar(9)) as process_name from e where u % 37 <> 36
union all select cast(1 as bigint), cast(0 as bigint), 'init'""",
    ),
    "exits": (
        ("syscalls",),
        """select pid, max(timestamp_ns) + 1000000000 as exit_ns from syscalls where (pid - 1000) % 4 = 1 group by pid""",
    ),
    "forks": (
        ("e",),
        """select 1000 + u as pid, us * 1000 - 500 as ts_ns, case when k % 4 = 0 then null else 1000 + k end as parent_pid from e where event_type = 'signup'""",
    ),
    "corpus": (
        ("e", "syscalls"),
        """select s.event_id, cast(s.timestamp_ns as double) / 1000000000 as timestamp, s.pid as processId,
    case when e.event_id % 10 >= 8 and e.k > 90 then 'late_proc' else 'proc_' || cast(e.u % 20 as varchar(9)) end as processName,
    lower(s.syscall_type) as eventName, cast(s.syscall_result as bigint) as returnValue,
    case when s.filename is null then '[]' else '[{' || @q || 'name' || @q || ': ' || @q || 'pathname' || @q || ', ' || @q || 'value' || @q || ': ' || @q || s.filename || @q
        || '}, {' || @q || 'name' || @q || ': ' || @q || 'flags' || @q || ', ' || @q || 'value' || @q || ': ' || @q || case when e.k % 4 in (1, 2) then 'O_RDWR' else 'O_RDONLY' end || @q || '}]' end as args,
    case when e.value > 250 then 1 else 0 end as sus, case when e.k >= 97 then 1 else 0 end as evil,
    case when e.event_id % 10 <= 5 then 'train' when e.event_id % 10 <= 7 then 'validation' else 'test' end as split
from syscalls s join e on s.event_id = e.event_id""",
    ),
    "health_samples": (
        ("e",),
        """select ts_ns, ts_ns / 1000000000 as elapsed_seconds, received, dropped, 0 as evicted, 100000000 + 1000 * received as rss_bytes,
    case when 100000000 + 1000 * received < 101000000 then 'Initializing' else 'Running' end as state,
    case when cast(floor(ts_ns / 86400000000000) as bigint) % 2 = 0 then 'idle' else 'load' end as phase
from (select cast(hour_no as bigint) * 3600000000000 as ts_ns, cast(sum(n) over (order by hour_no) as bigint) as received, cast(sum(bad) over (order by hour_no) as bigint) as dropped
    from (select floor(us / 3600000000) as hour_no, count(*) as n, sum(case when event_type = 'error' then 1 else 0 end) as bad from e group by floor(us / 3600000000)) h) r""",
    ),
    "model_nodes": (
        (),
        """select * from (values
    (0, 0, 'LT', 3, cast(8.0 as double), 1, 2, false, cast(null as double)), (0, 1, 'LT', 12, 1.0, 3, 4, false, null), (0, 2, 'LEAF', null, null, null, null, null, 0.7),
    (0, 3, 'LEAF', null, null, null, null, null, -0.6), (0, 4, 'LEAF', null, null, null, null, null, 0.2),
    (1, 0, 'LT', 28, 1.0, 1, 2, false, null), (1, 1, 'LEAF', null, null, null, null, null, -0.3), (1, 2, 'LEAF', null, null, null, null, null, 0.5),
    (2, 0, 'LT', 27, 2.0, 1, 2, false, null), (2, 1, 'LEAF', null, null, null, null, null, -0.2), (2, 2, 'LEAF', null, null, null, null, null, 0.4))
    as t(tree_id, node_id, mode, feature_index, threshold, true_node, false_node, missing_true, weight)""",
    ),
}
MODEL_BASE = -0.7


def filled(text: str, dialect: dict[str, str]) -> str:
    for name, value in dialect.items():
        text = text.replace(f"@{name}", value)
    return text


def needed(name: str) -> list[str]:
    """The view and what it reads, in order of definition."""
    out: list[str] = []
    for other in VIEWS[name][0]:
        out += [x for x in needed(other) if x not in out]
    return [*out, name]


def ctes(dialect: dict[str, str], *names: str) -> str:
    """The views as common table expressions."""
    order = list(dict.fromkeys(x for n in names for x in needed(n)))
    return ",\n".join(f"{n} as ({filled(VIEWS[n][1], dialect)})" for n in order)


def view(spark: SparkSession, sf_dir: str, name: str, events: DataFrame | None = None) -> DataFrame:
    """An adapter view as a DataFrame; over another events table, or a stream of one, if given."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events
    text = f"with {ctes(SPARK, name)} select * from {name}"
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace("from events", "from {source}"), source=events)
