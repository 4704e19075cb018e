"""Measurement reports: percentiles by rank, latencies, slopes, rates, streaks, buckets, gaps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions.scalars import is_finite
from fleetlens.operators.ordering import running_sums
from fleetlens.schemas import process_key


#: Values that are read whole to end a selection; relative error of the sketches that narrow it is 1 / ACCURACY.
FEW, ACCURACY = 10_000, 10_000


def selected(values: DataFrame, ranks: dict[float, int]) -> dict:
    """The values of column v with the wanted ranks (from 0), without a sort or an exchange of the values.

    Each rank has an open interval that holds its value. A turn takes sketches of all intervals in one pass, and two
    values near the rank from each; a second pass counts exactly what lies below, at and between them, which gives the
    value or a narrower interval. An interval of few values is read as its distinct values with their numbers. A turn
    leaves about 1 in ACCURACY / 2 of the values, and at least two distinct values fewer.
    """
    v, found = F.col("v"), {}
    todo = {p: (None, None, 0, None, rank) for p, rank in ranks.items()}  # low, high (not inside), values below, inside, rank

    def inside(low, high) -> Column:
        return (F.lit(True) if low is None else v > F.lit(low)) & (F.lit(True) if high is None else v < F.lit(high))

    total = values.count()
    todo = {p: (low, high, below, total, rank) for p, (low, high, below, _, rank) in todo.items()}
    while todo:
        for p in [p for p, x in todo.items() if x[3] <= FEW]:
            low, high, below, _, rank = todo.pop(p)
            for r in values.filter(inside(low, high)).groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect():  # FEW at most
                if below <= rank < below + r["n"]:
                    found[p] = r["v"]
                below += r["n"]
        if not todo:
            break
        spots, asked = list(todo), []
        for k, p in enumerate(spots):
            low, high, below, n, rank = todo[p]
            at, near = (rank - below + 0.5) / n, 2 / ACCURACY
            shares = F.array(F.lit(max(0.0, at - near)), F.lit(min(1.0, at + near)))
            asked.append(F.percentile_approx(F.when(inside(low, high), v), shares, F.lit(ACCURACY)).alias(f"c{k}"))
        cuts = values.agg(*asked).first()
        counts = []
        for k, p in enumerate(spots):
            low, high = todo[p][:2]
            a, b = (F.lit(x) for x in cuts[k])
            here = inside(low, high)
            counts += [F.count_if(here & c).alias(f"n{k}_{j}") for j, c in enumerate((v < a, v == a, (v > a) & (v < b), (v == b) & (a < b), v > b))]
        seen = values.agg(*counts).first()
        for k, p in enumerate(spots):
            low, high, below, _, rank = todo[p]
            a, b = cuts[k]
            for j, (new_low, new_high) in enumerate(((low, a), (a, a), (a, b), (b, b), (b, high))):
                n = seen[f"n{k}_{j}"]
                if rank < below + n:
                    if new_low is not None and new_low == new_high:
                        found[p] = new_low
                        del todo[p]
                    else:
                        todo[p] = (new_low, new_high, below, n, rank)
                    break
                below += n
    return found


def _at_ranks(df: DataFrame, col: str, ps: list[float], rank) -> DataFrame:
    """p, value: the values of the wanted ranks, found by `selected`. Null and NaN are no values."""
    if any(not 0 <= p <= 100 for p in ps):
        raise ValueError("ps must lie between 0 and 100")
    values = df.select(F.col(col).alias("v")).filter(F.col("v").isNotNull())
    if values.schema["v"].dataType.typeName() in ("double", "float"):
        values = values.filter(~F.isnan("v"))
    n = values.count()
    got = selected(values, {float(p): rank(float(p), n) for p in ps}) if n else {}
    rows = [(p, got[p]) for p in map(float, ps) if p in got]
    return df.sparkSession.createDataFrame(rows, T.StructType([T.StructField("p", T.DoubleType()), T.StructField("value", values.schema["v"].dataType)]))


def nearest_rank(df: DataFrame, col: str, ps: list[float]) -> DataFrame:
    """p, value: the value of rank ceil(p / 100 * n) - 1 (from 0)."""
    return _at_ranks(df, col, ps, lambda p, n: max(math.ceil(p * n / 100) - 1, 0))


def rounded_rank(df: DataFrame, col: str, ps: list[float]) -> DataFrame:
    """p, value: the value of rank ((n - 1) * p + 50) div 100 (from 0)."""
    return _at_ranks(df, col, ps, lambda p, n: math.floor(((n - 1) * p + 50) / 100))


def alert_latency(trials: DataFrame, alerts: DataFrame) -> DataFrame:
    """trial, process key, latency_ns: from each trial's start to its first alert. trials: trial, process key, start_ns;
    alerts: process key, ts_ns."""
    key = process_key(trials)
    joined = trials.join(alerts, key).filter(F.col("ts_ns") >= F.col("start_ns"))
    return joined.groupBy("trial", *key, "start_ns").agg(F.min("ts_ns").alias("ts")).select("trial", *key, (F.col("ts") - F.col("start_ns")).alias("latency_ns"))


def latency_report(latencies: DataFrame, col: str = "latency_ns", scale: float = 1e-6) -> DataFrame:
    """One row on the latencies of trials, by default nanoseconds told in milliseconds: trials, p50, p95, p99 and p99_9
    by nearest rank, max and mean. Without trials the figures are null."""
    rows = latencies.filter(F.col(col).isNotNull())
    ps = {"p50": 50.0, "p95": 95.0, "p99": 99.0, "p99_9": 99.9}
    ranks = {r["p"]: r["value"] for r in nearest_rank(rows, col, list(ps.values())).collect()}  # a row for each p
    at = [(F.lit(ranks.get(p)).cast("double") * scale).alias(name) for name, p in ps.items()]
    return rows.agg(F.count("*").alias("trials"), *at, (F.max(col) * scale).alias("max"), (F.avg(col) * scale).alias("mean"))


def leak_slope(samples: DataFrame, warmup_s: float = 0.0) -> DataFrame:
    """One row: MiB an hour by least squares after the warm-up (over all samples if fewer than two are left), peak, mean."""
    late = F.col("elapsed_seconds") >= warmup_s
    n, slope = F.count_if(late), lambda c: F.regr_slope(F.when(c, F.col("rss_bytes")), F.when(c, F.col("elapsed_seconds")))
    per_second = F.when(n >= 2, slope(late)).otherwise(slope(F.lit(True)))
    steady = F.when(is_finite(per_second), per_second).otherwise(0.0)
    return samples.agg((steady * 3600 / 1048576).alias("mib_per_hour"), F.max("rss_bytes").alias("peak"), F.avg("rss_bytes").alias("mean"))


def counter_rate(samples: DataFrame, phase: str, baseline: str | None = None) -> DataFrame:
    """One row: rate of `received` in a phase less that of the baseline phase (0 at least), drop and eviction deltas, states.

    samples: phase, elapsed_seconds, received, dropped, evicted, state.
    """
    first = lambda c: F.min_by(c, "elapsed_seconds")
    last = lambda c: F.max_by(c, "elapsed_seconds")
    span = F.max("elapsed_seconds") - F.min("elapsed_seconds")
    per = samples.groupBy("phase").agg(
        F.when(span > 0, (last("received") - first("received")) / span).otherwise(0.0).alias("rate"), (last("dropped") - first("dropped")).alias("dropped"), (last("evicted") - first("evicted")).alias("evicted"),
        F.array_join(F.array_sort(F.collect_set("state")), ",").alias("states"),
    )
    idle = per.filter(F.col("phase") == (baseline or "")).agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("idle"))
    return per.filter(F.col("phase") == phase).join(F.broadcast(idle)).select(F.greatest(F.col("rate") - F.col("idle"), F.lit(0.0)).alias("rate"), "dropped", "evicted", "states")


def longest_streak(samples: DataFrame, level: float) -> DataFrame:
    """The longest run of samples at or above a level: start, end, samples (the first of equal ones). samples: ts_ns, value.
    A run is known by the number of lower samples before it, running sums in two levels (of each host, where there are some)."""
    key, lower = [c for c in ("host_id",) if c in samples.columns], F.when(F.col("value") >= level, 0).otherwise(1)
    placed = running_sums(samples, ["ts_ns"], "streaks", key, total=lower)
    runs = placed.filter(F.col("value") >= level).groupBy(*key, "total").agg(F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), F.count("*").alias("samples"))
    if not key:
        return runs.drop("total").orderBy(F.desc("samples"), "start_ns").limit(1)
    return runs.groupBy(*key).agg(F.max_by(F.struct("start_ns", "end_ns", "samples"), F.struct("samples", -F.col("start_ns"))).alias("s")).select(*key, "s.*")


def bucketed_hits(hits: DataFrame, start: int, end: int, n: int = 4) -> DataFrame:
    """bucket, hits and all_hit: hits (ts_ns) in n equal parts of [start, end)."""
    if n < 1 or end <= start:
        raise ValueError("n must be 1 at least and end after start")
    spark = hits.sparkSession
    at = F.expr(f"cast(ts_ns - {start}L as decimal(38, 0)) * {n} div {end - start}L")
    counts = hits.filter((F.col("ts_ns") >= start) & (F.col("ts_ns") < end)).groupBy(at.alias("bucket")).agg(F.count("*").alias("hits"))
    every = spark.range(n).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("hits", F.lit(0)).alias("hits"))
    return every.join(F.broadcast(every.agg(F.bool_and(F.col("hits") > 0).alias("all_hit"))))


def reload_gap(attempts: DataFrame, stop_ns: int, start_ns: int) -> DataFrame:
    """One row about a stop and start: last attempt before, first after, the gap in seconds, attempts within (lost)."""
    before, after = F.col("ts_ns") < stop_ns, F.col("ts_ns") > start_ns
    out = attempts.agg(F.max(F.when(before, F.col("ts_ns"))).alias("last_before"), F.min(F.when(after, F.col("ts_ns"))).alias("first_after"), F.count_if(~before & ~after).alias("lost"))
    return out.withColumn("gap_seconds", (F.col("first_after") - F.col("last_before")) / 1e9)
