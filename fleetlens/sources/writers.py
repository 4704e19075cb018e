"""Sinks: logs as JSON lines, catalogues, metrics and manifests as one JSON object."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.sources.readers import PRIOR_MAPS


def sink_alert_log(df: DataFrame, path: str) -> None:
    """Appends one JSON line per alert; times keep their microseconds."""
    df.write.mode("append").option("ignoreNullFields", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def sink_inference_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def sink_metrics(df: DataFrame, path: str) -> None:
    """A one-row table as a JSON object."""
    df.coalesce(1).write.mode("overwrite").json(path)


def sink_prior_catalog(df: DataFrame, path: str, provenance: dict[str, str] | None = None) -> None:
    """family, token, rate as one JSON object of maps, with provenance fields."""
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("family") == f, F.struct("token", "rate"))))).alias(c) for f, c in PRIOR_MAPS.items()]
    more = [F.lit(v).alias(k) for k, v in (provenance or {}).items()]
    df.agg(F.max(F.when(F.col("family") == "global", F.col("rate"))).alias("global_positive_rate"), *maps).select("*", *more).coalesce(1).write.mode("overwrite").json(path)


def sink_manifest(spark: SparkSession, path: str, seed: int, split_roles: dict[str, str], grid: dict, artifacts: list[str]) -> None:
    """Seed, split roles, grid and the SHA-256 of each artifact (files or folders), as one JSON object."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(artifacts)
    hashes = files.select(F.struct("path", F.sha2("content", 256).alias("sha256")).alias("a")).agg(F.array_sort(F.collect_list("a")).alias("artifacts"))
    roles = [F.lit(v).alias(k) for k, v in split_roles.items()]
    hashes.select(F.lit(seed).alias("seed"), F.struct(*roles).alias("split_roles"), F.lit(json.dumps(grid, sort_keys=True)).alias("grid"), "artifacts").coalesce(1).write.mode("overwrite").json(path)
