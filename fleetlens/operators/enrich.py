"""Process metadata and ancestry: snapshots, joins, chains and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.ordering import as_of, previous
from fleetlens.schemas import process_key
from fleetlens.storage import shared_dir

# Names of the kernel's own root.
ROOT_NAMES = ("kthreadd", "[kthreadd]")


def parse_proc_snapshots(captures: DataFrame) -> DataFrame:
    """Snapshot columns from captured text. captures: process key, status_text, stat_text (and what else: kept).

    status: Name, Tgid, PPid, first Uid. stat: name between the first ( and the last ), then state, parent, and start
    ticks 18 fields after the parent. reject_kind names what is missing.
    """
    field = lambda name: F.nullif(F.regexp_extract("status_text", rf"(?m)^{name}:[ \t]*([^\t\n]+)", 1), F.lit(""))
    rest = F.split(F.trim(F.regexp_extract("stat_text", r"(?s)^[^(]*\(.*\)(.*)$", 1)), r"\s+")
    long = lambda c: c.try_cast("bigint")
    out = captures.withColumns(
        {
            "process_name": F.trim(field("Name")),
            "tgid": long(field("Tgid")),
            "status_ppid": long(field("PPid")),
            "uid": long(F.regexp_extract("status_text", r"(?m)^Uid:\s*(\d+)", 1)),
            "stat_name": F.regexp_extract("stat_text", r"(?s)^[^(]*\((.*)\)", 1),
            "state": F.get(rest, F.lit(0)),
            "stat_ppid": long(F.get(rest, F.lit(1))),
            "start_time_ticks": long(F.get(rest, F.lit(19))),
        }
    )
    reject = F.lit(None).cast("string")
    for name in ("start_time_ticks", "stat_ppid", "uid", "status_ppid", "tgid", "process_name"):
        reject = F.when(F.col(name).isNull(), F.lit(name)).otherwise(reject)
    return out.withColumns({"parent_pid": effective_parent(F.col("stat_ppid"), F.col("status_ppid"), F.col("pid")), "reject_kind": reject})


def effective_parent(stat_ppid: Column, status_ppid: Column, pid: Column) -> Column:
    """The parent from stat; where that is 0 though the process isn't pid 1, the one from status."""
    return F.when((stat_ppid == 0) & (pid != 1), status_ppid).otherwise(stat_ppid)


def enrich_process(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds process_name, binary_path, uid (together or not at all), cgroup and enrichment_partial; keeps every event.

    snapshots: process key, process_name, binary_path, uid, cgroup; one row per process. Spark broadcasts them if they
    are small enough, otherwise it joins by shuffle.
    """
    key = process_key(events)
    whole = F.col("process_name").isNotNull() & F.col("binary_path").isNotNull() & F.col("uid").isNotNull()
    columns = {c: (F.when(whole, F.col(c)) if c != "cgroup" else F.col(c)) for c in ("process_name", "binary_path", "uid", "cgroup")}
    side = snapshots.withColumns({c: F.col(c) if c in snapshots.columns else F.lit(None) for c in columns}).select(*key, *[v.alias(c) for c, v in columns.items()])
    joined = events.join(side, key, "left")
    return joined.withColumn("enrichment_partial", F.col("process_name").isNull())


def pid_generation(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds start_time_ticks and parent_pid of the generation of the pid that lives at the event's time.

    snapshots: process key, start_ns, start_time_ticks, parent_pid. A clone event of the pid as a child opens a new,
    still unknown generation. An event before the first known start has none.
    """
    key = process_key(events)
    at = lambda ts, order: F.struct(F.col(ts).alias("at"), F.lit(order).alias("order")).alias("at")
    born = snapshots.select(*key, at("start_ns", 1), "start_time_ticks", "parent_pid")
    host, unknown = [c for c in key if c != "pid"], F.lit(None).cast("bigint")
    clones = events.filter("child_pid is not null").select(*host, F.col("child_pid").alias("pid"), at("timestamp_ns", 0), unknown.alias("start_time_ticks"), unknown.alias("parent_pid"))
    last = F.try_element_at("lives", F.lit(-1))
    known = as_of(events, born.unionByName(clones), key, "lives")
    return known.withColumns({"start_time_ticks": last["start_time_ticks"], "parent_pid": last["parent_pid"]}).drop("lives")


def _checkpointed(df: DataFrame) -> DataFrame:
    """df without its lineage, in the folder that the executors share."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def ancestry_chain(snapshots: DataFrame, max_depth: int = 1024) -> DataFrame:
    """process key, ancestry_chain (root first, the process last) and ancestry_truncated.

    Pointer doubling: a round appends to each unfinished path the path of the process it ends before, so 1024 levels
    take 10 rounds of one join each; the rounds end early when no path goes on. A round is checkpointed (in
    spark.checkpoint.dir), as a plan of k rounds would hold the input 2 ** k times. A path stops at pid 1 or parent 0 (included), before a repeated pid, at an
    unknown parent, and at max_depth; only the last makes it truncated, unless its last process is a root.
    """
    max_depth = max(1, max_depth)
    key = process_key(snapshots)
    host = [c for c in key if c != "pid"]
    name = [F.col(c) if c in snapshots.columns else F.lit(None).cast("string").alias(c) for c in ("process_name", "binary_path")]
    node = F.struct("pid", *name, F.col("parent_pid").alias("parent"))
    goes_on = (F.col("pid") != 1) & (F.col("parent_pid") > 0)
    paths = snapshots.dropDuplicates(key).select(*key, F.array(node).alias("path"), F.when(goes_on, F.col("parent_pid")).alias("next"))
    for _ in range(max(1, (max_depth - 1).bit_length())):
        further = paths.select(*host, F.col("pid").alias("next"), F.col("path").alias("more"), F.col("next").alias("after"))
        joined = paths.join(further, [*host, "next"], "left")
        whole = F.when(F.col("more").isNull(), F.col("path")).otherwise(F.concat("path", "more"))
        walked = F.array_distinct(whole)
        circle = F.size(walked) < F.size(whole)
        paths = joined.select(*key, F.slice(walked, 1, max_depth).alias("path"), F.when(F.col("more").isNotNull() & ~circle & (F.size(walked) < max_depth), F.col("after")).alias("next"))
        paths = _checkpointed(paths)
        if paths.filter("next is not null").isEmpty():
            break
    last = F.element_at("path", F.lit(-1))
    cut = (F.size("path") >= max_depth) & (last["pid"] != 1) & (last["parent"] > 0)
    chain = F.reverse(F.transform("path", lambda p: F.struct(p["pid"].alias("pid"), p["process_name"].alias("process_name"), p["binary_path"].alias("binary_path"))))
    return paths.select(*key, chain.alias("ancestry_chain"), F.coalesce(cut, F.lit(False)).alias("ancestry_truncated"))


def ancestry_recursive(snapshots: DataFrame, max_depth: int = 16) -> DataFrame:
    """ancestry_chain for shallow trees by a recursive query: process key, depth, ancestor (1 = itself)."""
    key = process_key(snapshots)
    host = [c for c in key if c != "pid"]
    on = " and ".join(["p.pid = w.parent", *[f"p.{h} = w.{h}" for h in host]])
    cols = ", ".join(f"w.{c}" for c in key)
    query = f"""
    with recursive walk as (
        select {", ".join(key)}, 1 as depth, pid as ancestor, parent_pid as parent, array(pid) as seen from {{snapshots}}
        union all
        select {cols}, w.depth + 1, p.pid, p.parent_pid, array_append(w.seen, p.pid)
        from walk w join {{snapshots}} p on {on}
        where w.depth < {int(max_depth)} and w.ancestor <> 1 and w.parent > 0 and not array_contains(w.seen, p.pid))
    select {", ".join(key)}, depth, ancestor from walk
    """
    return snapshots.sparkSession.sql(query, snapshots=snapshots)


def process_depth(chain: Column) -> Column:
    return F.least(F.size(chain) - 1, F.lit(65535))


def enrichment_partial(enriched: DataFrame) -> DataFrame:
    """Events at which a process's enrichment turns partial: one warning per process until it succeeds again. A busy
    process is spread over ranges of time, which carry their last state on."""
    known = enriched.withColumn("enrichment_partial", F.coalesce("enrichment_partial", F.lit(False)))
    told = previous(known, "enrichment_partial", ["timestamp_ns", "event_id"], "partial", process_key(enriched))
    return told.filter(F.col("enrichment_partial") & ~F.coalesce("before", F.lit(False))).drop("before")


def exited_pids(windows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Processes with windows that the live snapshot lacks; a snapshot row of any status, unknown too, is no exit."""
    key = process_key(windows)
    return windows.select(*key).distinct().join(snapshots, key, "left_anti")


def validate_ancestry(records: DataFrame, max_partial: float = 0.05) -> DataFrame:
    """code of each leaf-first record: 0 fine, 2 empty or another leaf, 3 a pid twice, 5 parent 0 before the end, 4 an
    untruncated chain that ends at no root; partial_code 6 on all if the share of partial ones exceeds max_partial."""
    chain = F.coalesce("ancestry_chain", F.array().cast(records.schema["ancestry_chain"].dataType))
    pids = F.transform(chain, lambda p: p["pid"])
    first, last = F.get(pids, F.lit(0)), F.try_element_at(chain, F.lit(-1))
    middle = F.exists(F.slice(chain, F.lit(1), F.greatest(F.size(chain) - 1, F.lit(0))), lambda p: p["ppid"] == 0)
    root = (last["pid"] == 1) | ((last["pid"] == 0) & last["process_name"].isin(*ROOT_NAMES))
    whole = ~F.coalesce("ancestry_truncated", F.lit(False))
    code = (
        F.when(F.size(chain) == 0, 2)
        .when(F.size(F.array_distinct(pids)) < F.size(pids), 3)
        .when(middle, 5)
        .when(F.coalesce(first != F.col("pid"), F.lit(True)), 2)
        .when(whole & ~F.coalesce(root, F.lit(False)), 4)
        .otherwise(0)
    )
    share = records.agg(F.avg(F.coalesce("enrichment_partial", F.lit(False)).cast("int")).alias("share"))
    over = F.when(F.coalesce("share", F.lit(0.0)) > max_partial, 6).otherwise(0)
    return records.withColumn("code", code).join(F.broadcast(share)).withColumn("partial_code", over).drop("share")
