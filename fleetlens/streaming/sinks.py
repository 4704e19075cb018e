"""One foreachBatch for all outputs of a window stream: inference log, alerts, process state.

A batch that Spark repeats writes nothing twice: each output is partitioned by batch_id and the batch's own partition
is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.alerts import build_alerts, inference_log, window_identity
from fleetlens.operators.features import features_all
from fleetlens.operators.scoring import attribute_paths, degraded_scores, flatten_vector, score_trees
from fleetlens.schemas import process_key
from fleetlens.storage import scratch, staged
from fleetlens.streaming.stateful import late_events, on_time


def replaced(df: DataFrame, path: str, batch_id: int) -> None:
    """Writes a batch's rows as its partition of the table at path."""
    df.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def last_alert_id(spark, path: str, batch_id: int) -> int:
    """The largest alert id of earlier batches, from the table of one row for each batch at path; 0 if none."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(conf).exists(place):
        return 0
    return spark.read.parquet(path).filter(F.col("batch_id") < batch_id).agg(F.max("last_id")).first()[0] or 0


def telemetry_writer(place: str, model: Callable[[], tuple[DataFrame, str] | None], threshold: float = 0.7, base: float = 0.0, dedup_ms: float = 100) -> Callable[[DataFrame, int], None]:
    """The function for foreachBatch over `window_stream`. model(): the node table and hash that hold now, read anew for
    each batch; None scores as degraded. Rows marked late go to the table late_events, as they came."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = held = batch.persist()
        try:
            if "late" in batch.columns:
                replaced(late_events(batch), f"{place}/late_events", batch_id)
                batch = on_time(batch)
            flat = flatten_vector(features_all(batch, dedup_ms, maps=False))  # no grams: vectors hold none
            now = model()
            if now is None:
                replaced(degraded_scores(flat, "no valid model").select(*process_key(flat), "window_start_ns", "window_end_ns", "threat_score", "model_hash", "degraded_reason"), f"{place}/degraded", batch_id)
                return
            nodes, model_hash = now
            scored = attribute_paths(score_trees(flat, nodes, base), nodes).withColumn("model_hash", F.lit(model_hash)).persist()
            replaced(inference_log(scored), f"{place}/inference_log", batch_id)
            last = last_alert_id(spark, f"{place}/alert_ids", batch_id)
            with scratch(spark):  # the staged alerts go once they are written
                alerts = staged(build_alerts(scored, window_identity(batch), threshold, last), "alerts")
                replaced(alerts, f"{place}/alerts", batch_id)
                replaced(alerts.agg(F.coalesce(F.max("alert_id"), F.lit(last)).alias("last_id")), f"{place}/alert_ids", batch_id)
            states = scored.select(*process_key(scored), F.col("window_end_ns").alias("updated_ns"), "threat_score")
            replaced(states.groupBy(*process_key(states)).agg(F.max("updated_ns").alias("updated_ns"), F.max_by("threat_score", "updated_ns").alias("threat_score")), f"{place}/process_state", batch_id)
            scored.unpersist()
        finally:
            held.unpersist()

    return write
