"""Shared helpers of the corpus operators: input tables, shared scratch space, heavy keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.storage import dropped, new_path, scratch, shared_dir

__all__ = ["dropped", "new_path", "scratch", "shared_dir"]

#: Bytes of text that Python works on at once; bounds memory, not results.
CHUNK_BYTES = 1_000_000
#: Row groups of staged tables; small ones keep the writers' buffers small.
ROW_GROUP_BYTES = 16 << 20
#: Bytes of rows that Spark puts into one Arrow batch for Python, where the session has no setting of its own.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder and reads it again: lineage is cut, executors may be lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    return written(df, path), path


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_BYTES. By default they hold 10,000 rows, tens of MB of texts that each
    task keeps in the JVM's buffers and in Python. Bounds memory, not results."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def free_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that a text operator reads, as (doc_id, text); null text becomes empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of text (second column) each; no text is cut.

    So only a slice at a time need become Python objects; unused Arrow memory goes back after each batch.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else np.zeros(0, np.int64)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = min(int(np.searchsorted(ends, before + most)) + 1, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
    pa.default_memory_pool().release_unused()


def chunks(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[tuple[list, list]]:
    """Ids and texts (the first two columns) of each slice, as Python objects."""
    for part in slices(batch, most):
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def ascii_lower(text: str) -> str:
    """A-Z to a-z, nothing else (bytes.lower touches ASCII only)."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def ascii_lower_col(c: Column) -> Column:
    """A-Z to a-z natively; the fast path is for pure ASCII."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def looked_up(rows: DataFrame, counted: DataFrame, keys: list[str], total: int, heavy: int = 1000) -> DataFrame:
    """Inner join of rows with counted on keys, safe against hot keys.

    `counted` has one row per key and a column n, the number of rows with the key; `total` is the sum of n.
    A key with more than total/heavy rows is heavy. There can be fewer than `heavy` of those, whatever the
    input, so they are broadcast; all other keys meet in an ordinary shuffle join.
    """
    limit = max(total // heavy, 1)
    hot = counted.filter(F.col("n") > limit).drop("n")
    rest = counted.filter(F.col("n") <= limit).drop("n")
    by_hand = rows.join(F.broadcast(hot), keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest, keys)
    return by_hand.unionByName(cold)
