"""Label-rate priors: learning them on a labelled corpus, checking for leaks, looking them up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.scalars import args_flags, args_path, event_class, path_prefix, sensitive_dir, write_intent_text
from fleetlens.schemas import window_key

FAMILIES = {"process": "processName", "event": "eventName", "path": "path_prefix"}


def label_corpus(rows: DataFrame) -> DataFrame:
    """label = evil or sus, path and path_prefix from args."""
    label = F.when((F.col("evil") == 1) | (F.col("sus") == 1), 1).otherwise(0)
    return rows.withColumns({"label": label, "path": args_path(F.col("args"))}).withColumn("path_prefix", path_prefix(F.col("path")))


def smoothed_rate(corpus: DataFrame, key: str, weight: float = 5.0) -> DataFrame:
    """token, rate: (positives + weight * global mean) / (rows + weight); null tokens are no tokens."""
    if weight <= 0:
        raise ValueError("weight must be positive")
    overall = corpus.agg(F.avg("label").alias("g"))
    counts = corpus.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("token")).agg(F.sum("label").alias("s"), F.count("*").alias("n"))
    return counts.join(F.broadcast(overall)).select("token", ((F.col("s") + F.col("g") * weight) / (F.col("n") + weight)).alias("rate"))


def prior_catalogue(corpus: DataFrame, weight: float = 5.0) -> DataFrame:
    """family, token, rate for process, event and path, and the family `global` with an empty token."""
    out = corpus.agg(F.avg("label").alias("rate")).select(F.lit("global").alias("family"), F.lit("").alias("token"), F.coalesce("rate", F.lit(0.0)).alias("rate"))
    for family, column in FAMILIES.items():
        out = out.unionByName(smoothed_rate(corpus, column, weight).select(F.lit(family).alias("family"), "token", "rate"))
    return out


def split_tokens(corpus: DataFrame) -> DataFrame:
    """split, family, token: distinct tokens (corpus has a column split)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), F.col(c).alias("token")) for f, c in FAMILIES.items()]))
    return corpus.select("split", pairs.alias("p")).select("split", "p.*").filter("token is not null").distinct()


def leakage_check(priors: DataFrame, train: DataFrame, test: DataFrame) -> DataFrame:
    """One row: unknown (catalogue tokens that train lacks), leaked (catalogue tokens that only test has), ok."""
    tokens = lambda df: split_tokens(df.withColumn("split", F.lit(""))).drop("split")
    held = priors.filter("family <> 'global'").select("family", "token")
    both = ["family", "token"]
    unknown = held.join(tokens(train), both, "left_anti").agg(F.count("*").alias("unknown"))
    leaked = held.join(tokens(test).join(tokens(train), both, "left_anti"), both).agg(F.count("*").alias("leaked"))
    return unknown.join(F.broadcast(leaked)).withColumn("ok", (F.col("unknown") == 0) & (F.col("leaked") == 0))


#: Largest difference between a recorded figure and a second computation of it.
EXACT = 1e-12


def table_digest(df: DataFrame) -> DataFrame:
    """One row, one column digest: a table's rows whatever their order and files, as their number and the sums of two
    hashes of each row. Columns go by name."""
    names = sorted(df.columns)
    hashes = [F.coalesce(F.sum(F.xxhash64(F.lit(salt), *names).cast("decimal(38, 0)")), F.lit(0)) for salt in (1, 2)]
    return df.agg(F.concat_ws(":", F.count("*").cast("string"), *[h.cast("string") for h in hashes]).alias("digest"))


def provenance(catalogue: DataFrame, train: DataFrame, metrics: DataFrame) -> DataFrame:
    """The part of a run's manifest that says what it was made from, one row: digests of the train split and of the
    catalogue, and the metrics (one row of figures) as recorded_<name>."""
    parts = [table_digest(train).withColumnRenamed("digest", "train_digest"), table_digest(catalogue).withColumnRenamed("digest", "catalogue_digest")]
    recorded = metrics.select(*[F.col(c).alias(f"recorded_{c}") for c in metrics.columns])
    return reduce(lambda a, b: a.join(F.broadcast(b)), parts, recorded)  # one row each


def provenance_check(manifest: DataFrame, catalogue: DataFrame, train: DataFrame, test: DataFrame, metrics: DataFrame, reproduced: DataFrame | None = None) -> DataFrame:
    """One row of checks on a run: splits_recorded and catalogue_recorded (the tables are those of the manifest),
    priors_reproduced (a second computation from train, made here if not given, has the same tokens, and rates within
    EXACT), no_leak (`leakage_check`), metrics_reproduced (the recorded figures are within EXACT of metrics), passed."""
    again = (prior_catalogue(train) if reproduced is None else reproduced).select("family", "token", F.col("rate").alias("again"))
    both = catalogue.select("family", "token", "rate").join(again, ["family", "token"], "full_outer")
    off = both.agg(F.count_if(F.coalesce(F.abs(F.col("rate") - F.col("again")) > EXACT, F.lit(True))).alias("off"))
    leaks = leakage_check(catalogue, train, test).select(F.col("ok").alias("no_leak"))
    made = [table_digest(train).withColumnRenamed("digest", "train_now"), table_digest(catalogue).withColumnRenamed("digest", "catalogue_now"), metrics, off, leaks]
    row = reduce(lambda a, b: a.join(F.broadcast(b)), made, manifest)  # one row each
    same = [F.coalesce(F.abs(F.col(c) - F.col(f"recorded_{c}")) <= EXACT, F.col(c).isNull() & F.col(f"recorded_{c}").isNull()) for c in metrics.columns]
    out = row.select(
        (F.col("train_digest") == F.col("train_now")).alias("splits_recorded"), (F.col("catalogue_digest") == F.col("catalogue_now")).alias("catalogue_recorded"), (F.col("off") == 0).alias("priors_reproduced"),
        "no_leak", reduce(lambda a, b: a & b, same).alias("metrics_reproduced"),
    )
    return out.withColumn("passed", reduce(lambda a, b: a & b, [F.col(c) for c in out.columns]))


def split_roles_check(manifest: DataFrame) -> DataFrame:
    """ok: priors from train, grid on validation, final model on both, test used once."""
    want = {"priors": "train", "grid_search": "validation", "final_model": "train+validation", "evaluation": "test"}
    ok = F.lit(True)
    for name, value in want.items():
        ok = ok & F.coalesce(F.col(name) == value, F.lit(False))
    return manifest.withColumn("ok", ok)


def _rates(priors: DataFrame, family: str) -> DataFrame:
    return priors.filter(F.col("family") == family).select(F.col("token").alias(f"{family}_token"), F.col("rate").alias(f"{family}_rate"))


def _overall(priors: DataFrame) -> DataFrame:
    return priors.filter("family = 'global'").agg(F.max("rate").alias("global_rate"))


def feature_priors_join(corpus: DataFrame, priors: DataFrame) -> DataFrame:
    """Adds process_rate, event_rate and path_rate to corpus rows; unknown tokens get the global rate."""
    out = corpus.join(F.broadcast(_overall(priors)))
    for family, column in FAMILIES.items():
        out = out.join(_rates(priors, family), F.col(column) == F.col(f"{family}_token"), "left").drop(f"{family}_token")
        out = out.withColumn(f"{family}_rate", F.coalesce(f"{family}_rate", "global_rate"))
    return out.drop("global_rate")


def _first_or_global(rates: DataFrame, windowed: DataFrame, priors: DataFrame, name: str) -> DataFrame:
    key = window_key(windowed)
    every = windowed.select(*key).distinct().join(rates, key, "left").join(F.broadcast(_overall(priors)))
    return every.select(*key, F.coalesce("rate", "global_rate").alias(name))


def f_prior_process(windowed: DataFrame, priors: DataFrame) -> DataFrame:
    """Rate of the window's latest non-null process name."""
    key = window_key(windowed)
    latest = windowed.filter("process_name is not null").groupBy(*key).agg(F.max_by("process_name", F.struct("timestamp_ns", "event_id")).alias("process_token"))
    rates = latest.join(_rates(priors, "process"), "process_token").select(*key, F.col("process_rate").alias("rate"))
    return _first_or_global(rates, windowed, priors, "process_positive_rate")


def f_prior_event(windowed: DataFrame, priors: DataFrame) -> DataFrame:
    """Largest rate of the event types seen."""
    key = window_key(windowed)
    seen = windowed.select(*key, F.lower("syscall_type").alias("event_token")).distinct()
    rates = seen.join(_rates(priors, "event"), "event_token").groupBy(*key).agg(F.max("event_rate").alias("rate"))
    return _first_or_global(rates, windowed, priors, "event_positive_rate")


def f_prior_path(windowed: DataFrame, priors: DataFrame) -> DataFrame:
    """Largest rate of the prefixes of file names and binary paths."""
    key = window_key(windowed)
    paths = F.array_compact(F.array(*[F.col(c) for c in ("filename", "binary_path") if c in windowed.columns]))
    seen = windowed.select(*key, F.explode(paths).alias("path")).select(*key, path_prefix(F.col("path")).alias("path_token")).distinct()
    rates = seen.join(_rates(priors, "path"), "path_token").groupBy(*key).agg(F.max("path_rate").alias("rate"))
    return _first_or_global(rates, windowed, priors, "path_positive_rate")


def f_priors(windowed: DataFrame, priors: DataFrame) -> DataFrame:
    """f_prior_process, f_prior_event and f_prior_path in one pass: the tokens of a window as sets of one aggregate, one
    join with the catalogue, the largest rate of each family."""
    key = window_key(windowed)
    name = F.max_by("process_name", F.when(F.col("process_name").isNotNull(), F.struct("timestamp_ns", "event_id"))) if "process_name" in windowed.columns else F.lit(None).cast("string")
    prefix = lambda c: F.when(F.col(c).isNotNull(), path_prefix(F.col(c)))
    paths = [F.collect_set(prefix(c)) for c in ("filename", "binary_path") if c in windowed.columns]
    sets = windowed.groupBy(*key).agg(name.alias("name"), F.collect_set(F.lower("syscall_type")).alias("events"), *[p.alias(f"paths_{k}") for k, p in enumerate(paths)])
    as_tokens = lambda c, family: F.transform(c, lambda t: F.struct(F.lit(family).alias("family"), t.alias("token")))
    tokens = F.concat(as_tokens(F.array("name"), "process"), as_tokens("events", "event"), *[as_tokens(f"paths_{k}", "path") for k in range(len(paths))])
    spread = sets.select(*key, F.explode(tokens).alias("t")).select(*key, "t.*")
    found = spread.join(priors.filter("family <> 'global'").select("family", "token", "rate"), ["family", "token"], "left")
    rates = found.groupBy(*key).agg(*[F.max(F.when(F.col("family") == f, F.col("rate"))).alias(f) for f in ("process", "event", "path")]).join(F.broadcast(_overall(priors)))
    return rates.select(*key, *[F.coalesce(f, "global_rate").alias(f"{f}_positive_rate") for f in ("process", "event", "path")])


def corpus_features(corpus: DataFrame, priors: DataFrame) -> DataFrame:
    """One vector per labelled corpus row: a window of 1 ns with one event."""
    rows = feature_priors_join(corpus, priors)
    kind, flags = event_class(F.col("eventName")), args_flags(F.col("args"))
    is_kind = {k: kind == k for k in ("execve", "openat", "connect", "clone")}
    one = lambda c: F.when(c, 1).otherwise(0).cast("bigint")
    place, writes = sensitive_dir(F.col("path")), write_intent_text(flags)
    zero = F.lit(0.0)
    start = (F.col("timestamp") * 1e9).cast("bigint")
    wrote: dict[str, Column] = {f"wrote_{d}": F.coalesce(writes & (place == d), F.lit(False)) for d in ("etc", "tmp", "dev")}
    return rows.select(
        F.col("processId").alias("pid"),
        start.alias("window_start_ns"),
        (start + 1).alias("window_end_ns"),
        F.lit(1).cast("bigint").alias("total_syscalls"),
        *[one(c).alias(f"{k}_count") for k, c in is_kind.items()],
        *[one(c).cast("double").alias(f"{k}_ratio") for k, c in is_kind.items()],
        zero.alias("path_entropy"),
        one(is_kind["connect"]).alias("unique_ips"),
        one(F.col("path") != "").alias("unique_files"),
        one(is_kind["clone"]).alias("child_spawn_count"),
        *[zero.alias(f"{x}_inter_syscall_time_ns") for x in ("avg", "min", "max", "stddev")],
        *[c.alias(n) for n, c in wrote.items()],
        one(place.isNotNull() & ~writes).alias("read_sensitive_file_count"),
        one(place.isNotNull() & writes).alias("write_sensitive_file_count"),
        one(is_kind["connect"]).alias("outbound_connection_count"),
        one(is_kind["connect"] & (F.col("path") == "127.0.0.1")).alias("loopback_connection_count"),
        F.lit(0).cast("bigint").alias("distinct_ports"),
        one(F.col("returnValue") < 0).alias("failed_syscall_count"),
        F.lit(True).alias("short_lived"),
        F.lit(1).cast("bigint").alias("window_duration_ns"),
        F.lit(1.0).alias("events_per_second"),
        *[F.col(f"{f}_rate").alias(f"{f}_positive_rate") for f in FAMILIES],
        "label",
    )
