"""Orders over whole tables and within keys of any size, in two levels: ranges of one sort, then rows within a range.

A table is staged once in its order, with the number of each row's range (`ranged`); tasks that run again read the same
table, so they agree on it. What a range needs to know of those before it is one row for each key and range (`carried`).
The number of ranges follows the table's size, so no task sees more than a range, unless one value fills more than that.
Staged tables go with the caller's `storage.scratch`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.storage import dropped, new_path, staged, written

#: Rows of a range at most, on average.
RANGE_ROWS = 4_000_000


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds name: 1, 2, ... in the given order."""
    placed = ranged(df, order, name)
    shift = carried(placed.groupBy("part").agg(F.count("*").alias("n")), [], shift=F.sum("n"))
    at = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return joined_by_part(placed.withColumn(name, at), shift, []).withColumn(name, F.col(name) + F.coalesce("shift", F.lit(0))).drop("part", "shift")


def running_sums(df: DataFrame, order: list[str], name: str, key: list[str] | None = None, **values: Column) -> DataFrame:
    """Adds for each name the sum of a value over the rows up to each (of its key), in the given order."""
    key = key or []
    placed = ranged(df.withColumns(values), [*key, *order], name)
    parts = placed.groupBy(*key, "part").agg(*[F.sum(n).alias(n) for n in values])
    earlier = carried(parts, key, **{f"{n}_before": F.sum(n) for n in values})
    w = Window.partitionBy(*key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = joined_by_part(placed.withColumns({n: F.sum(n).over(w) for n in values}), earlier, key)
    return both.withColumns({n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in values}).drop("part", *[f"{n}_before" for n in values])


def previous(df: DataFrame, col: str, order: list[str], name: str, key: list[str] | None = None) -> DataFrame:
    """Adds before: col in the row before (of the same key), null in the first. col is never null."""
    key = key or []
    placed = ranged(df, [*key, *order], name)
    ends = placed.groupBy(*key, "part").agg(F.max_by(col, F.struct(*order)).alias("end"))
    earlier = carried(ends, key, carried=F.last("end"))
    own = F.lag(col).over(Window.partitionBy(*key, "part").orderBy(*order))
    return joined_by_part(placed.withColumn("before", own), earlier, key).withColumn("before", F.coalesce("before", "carried")).drop("part", "carried")


def as_of(events: DataFrame, marks: DataFrame, key: list[str], name: str, strict: bool = False) -> DataFrame:
    """Adds name: the marks of the event's key at or before its timestamp_ns (strict: before it), in order.

    marks: key, at (bigint, or a struct that starts with it) and what else. Marks of a key are few (starts, ends and
    forks of one process) and become an array that is joined to the events, so events of a busy process are never
    sorted, and Spark may split them over tasks.
    """
    first = F.col("at.at") if marks.schema["at"].dataType.typeName() == "struct" else F.col("at")
    lists = marks.withColumn("ns", first).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", *[c for c in marks.columns if c not in (*key, "at")], "ns"))).alias(name))
    ts = F.col("timestamp_ns")
    return events.join(lists, key, "left").withColumn(name, F.filter(name, lambda m: m["ns"] < ts if strict else m["ns"] <= ts))


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df staged in the given order, with part: the number of a row's range, which rises with the order.

    A key of any size is spread over ranges; as the table is written once, tasks that run again agree on part. df is
    written as it comes first, so that it is computed once for its size, its bounds and its rows; this copy goes again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    whole = written(df, path)
    usual, wanted = int(spark.conf.get("spark.sql.shuffle.partitions")), -(-whole.count() // RANGE_ROWS)
    dealt = whole.repartitionByRange(wanted, *order) if wanted > usual else whole.repartitionByRange(*order)
    placed = staged(dealt.withColumn("part", F.spark_partition_id()), name)
    dropped(spark, path)
    return placed


def carried(parts: DataFrame, key: list[str], **values: Column) -> DataFrame:
    """key, part and for each name a value over all earlier ranges of the key. parts: one row for each key and range, so
    a key has as many rows here as it fills ranges."""
    w = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*key, "part", *[v.over(w).alias(n) for n, v in values.items()])


def joined_by_part(placed: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """placed with the columns of parts; null keys meet, too."""
    same = [placed[c].eqNullSafe(parts[c]) for c in (*key, "part")]
    return placed.join(parts, reduce(lambda a, b: a & b, same), "left").select(placed["*"], *[parts[c] for c in parts.columns if c not in (*key, "part")])


def stretches(df: DataFrame, key: list[str], pause_ns: int, name: str) -> DataFrame:
    """df staged, with chunk: rows of a key between two pauses longer than pause_ns are in one chunk, and a chunk goes on
    over as many of these as begin in the same range. Two levels: within a range, and from one range of a key to the next."""
    placed = ranged(df, [*key, "timestamp_ns"], name)
    by_time = Window.partitionBy(*key, "part").orderBy("timestamp_ns")
    ends = placed.groupBy(*key, "part").agg(F.max("timestamp_ns").alias("end_ns"))
    earlier = carried(ends, key, end_before=F.max("end_ns"))
    before = F.coalesce(F.lag("timestamp_ns").over(by_time), "end_before")
    gaps = joined_by_part(placed, earlier, key).withColumn("gap", F.coalesce(F.col("timestamp_ns") - before > pause_ns, F.lit(True))).drop("end_before")
    begun = gaps.groupBy(*key, "part").agg(F.max(F.when(F.col("gap"), F.col("part"))).alias("last"))
    chunks = joined_by_part(gaps, carried(begun, key, chunk_before=F.max("last")), key)
    own = F.max(F.when(F.col("gap"), F.col("part"))).over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("chunk", F.coalesce(own, "chunk_before")).drop("part", "gap", "chunk_before")
