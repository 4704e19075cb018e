"""Tables that a plan writes and reads again, in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A temporary folder of this machine stands in for it only where all of Spark runs in one
    process, as in tests."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        place = got.get() if got.isDefined() else None
    if not place:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = tempfile.mkdtemp(prefix="fleetlens-")
        spark.sparkContext.setCheckpointDir(place)
    return place


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What this thread stages inside goes at the end, so write results that read it before, to a path named outside."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield
    finally:
        _scope.reset(token)
        dropped(spark, *paths)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (paths := _scope.get()) is not None:
        paths.append(path)
    return path


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df and reads it again: what it holds no longer changes, and its plan is not run twice."""
    return written(df, new_path(df.sparkSession, name))


def dropped(spark: SparkSession, *paths: str) -> None:
    """Deletes staged tables that no later plan reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
