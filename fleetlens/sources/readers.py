"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.priors import label_corpus
from fleetlens.schemas import ALERT, CORPUS, ENRICHMENT_RECORD, FEATURE_VECTOR, SYSCALL

PRIOR_MAPS = {"process": "process_positive_rate", "event": "event_positive_rate", "path": "path_positive_rate"}


def src_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """A labelled corpus split (header, doubled quotes) with label, path and path_prefix; columns are taken by name."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", False).csv(path)
    rows = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in CORPUS])
    return label_corpus(rows)


def src_alert_log(spark: SparkSession, path: str) -> DataFrame:
    """Alert history from JSON lines; blank lines are passed over, a bad line fails the query."""
    return spark.read.schema(ALERT).option("mode", "FAILFAST").json(path)


def src_record_log(spark: SparkSession, path: str, record_type: str, schema: T.StructType = ENRICHMENT_RECORD) -> DataFrame:
    """Records of one type from mixed JSON lines; lines that are no JSON object stay as rows with reject_line."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    bad = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select("value", F.from_json("value", bad, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    reject = F.when(F.col("r._corrupt").isNotNull() | F.col("r").isNull(), F.col("value"))
    rows = parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], reject.alias("reject_line"))
    return rows.filter((F.col("record_type") == record_type) | F.col("reject_line").isNotNull())


def src_feature_json(spark: SparkSession, path: str) -> DataFrame:
    """Feature vectors, one JSON document a file."""
    return spark.read.schema(FEATURE_VECTOR).option("multiLine", True).json(path)


def src_prior_catalog(spark: SparkSession, path: str) -> DataFrame:
    """family, token, rate from a catalogue of one JSON object."""
    maps = [T.StructField(c, T.MapType(T.StringType(), T.DoubleType())) for c in PRIOR_MAPS.values()]
    raw = spark.read.schema(T.StructType([T.StructField("global_positive_rate", T.DoubleType()), *maps])).option("multiLine", True).json(path)
    out = raw.select(F.lit("global").alias("family"), F.lit("").alias("token"), F.col("global_positive_rate").alias("rate"))
    for family, column in PRIOR_MAPS.items():
        out = out.unionByName(raw.select(F.lit(family).alias("family"), F.explode(column).alias("token", "rate")))
    return out


def generated_columns(i, base_ns: int, eps: float, pids: int) -> list:
    """Event i as columns: times, process, type, paths and ports follow from i alone."""
    kind = i % 4
    pid = (F.lit(4000) + i % pids).cast("bigint")
    pick = lambda n, c: F.when(kind == n, c)
    return [
        i.alias("event_id"),
        (F.lit(base_ns) + F.floor(i * (1e9 / eps)).cast("bigint")).alias("timestamp_ns"),
        pid.alias("pid"),
        pid.alias("tid"),
        F.lit(1).cast("bigint").alias("ppid"),
        F.element_at(F.array(*map(F.lit, ("Execve", "Openat", "Connect", "Clone"))), (kind + 1).cast("int")).alias("syscall_type"),
        pick(1, F.concat(F.lit("/tmp/load-"), (i % 32).cast("string"))).alias("filename"),
        pick(2, F.lit("127.0.0.1")).alias("ip_address"),
        pick(2, (F.lit(4000) + i % 128).cast("int")).alias("port"),
        pick(3, pid + 10_000).alias("child_pid"),
        pick(1, F.lit(65).cast("bigint")).alias("open_flags"),
        F.lit(0).alias("syscall_result"),
    ]


def src_events_generated(spark: SparkSession, n: int, eps: float, pids: int = 256, base_ns: int = 0) -> DataFrame:
    """n deterministic events at eps a second."""
    if eps <= 0 or pids < 1:
        raise ValueError("eps and pids must be positive")
    return spark.range(n).select(*generated_columns(F.col("id"), base_ns, eps, pids))


def src_stream_generated(spark: SparkSession, rows_per_second: int, eps: float, pids: int = 256, base_ns: int = 0) -> DataFrame:
    """The same events as a stream from the rate source."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(*generated_columns(F.col("value"), base_ns, eps, pids))


def src_stream(spark: SparkSession, fmt: str, options: dict[str, str], schema: T.StructType = SYSCALL) -> DataFrame:
    """A stream of events: files with the schema, or Kafka values in JSON."""
    if fmt == "kafka":
        raw = spark.readStream.format("kafka").options(**options).load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("e")).select("e.*")
    return spark.readStream.format(fmt).schema(schema).options(**options).load()
