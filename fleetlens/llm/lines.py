"""Line dedup over levelled sorted runs of line hashes. DataFrame operations only.

Batches of documents arrive in ascending doc_id. The keys of a batch are reduced to (hash, smallest doc_id),
merge-joined with the sorted runs of earlier batches (tables bucketed and sorted by hash, so only the batch is
shuffled), and what no run knows is added as a new run. When a level holds `fanout` runs, they are compacted into one
run of the next level before the next batch comes. A line goes if its key's owner, the first document holding it, is
another.

`dedup_lines` deals one table in `batches`, a fixed number, so that the runs are read a fixed number of times whatever
the table's size; by default the first three runs are compacted, and the last two batches read the compacted run.
`LineRuns` takes batches as they arrive.

Null or empty text: one empty line, kept. Rows with a null doc_id are returned as they are and own nothing.
Rows that repeat a doc_id are one document. Lines with keys under `min_chars` always stay. Ties can't occur:
the owner is the smallest doc_id. Empty tables give empty results; further columns of the input are ignored, unless
`also` names them, which may be any names but those of the result.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import ascii_lower_col, dropped, looked_up, new_path, staged

HASH = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z lower-cased."""
    return ascii_lower_col(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def line_hashes(docs: DataFrame, min_chars: int = 10, whole: bool = False) -> DataFrame:
    """doc_id, doc_hash, pos, h1, h2: one row per line with a key of min_chars or more; 128 bits stand for the key.
    whole: one more row for the text as a whole, at pos -1."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("doc_hash"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keyed = lines.select("doc_id", "doc_hash", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    out = keyed.select("doc_id", "doc_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    if not whole:
        return out
    texts = docs.filter(F.length("text") >= min_chars).select("doc_id", F.xxhash64("text").alias("doc_hash"), F.lit(-1).alias("pos"), F.xxhash64(F.lit(2), "text").alias("h1"), F.xxhash64(F.lit(3), "text").alias("h2"))
    return out.unionByName(texts)


class LineRuns:
    """The runs, level by level. Each is a table in the shared folder, bucketed and sorted by hash."""

    def __init__(self, spark: SparkSession, fanout: int = 4, buckets: int | None = None) -> None:
        if fanout < 2:
            raise ValueError("fanout must be 2 at least")
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = new_path(self.spark, name)
        (df.write.format("parquet").option("path", self.paths[name]).option("compression", "zstd").bucketBy(self.buckets, *HASH).sortBy(*HASH).saveAsTable(name))
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).filter("is_new").select(*HASH, "owner")

    def add(self, lines: DataFrame) -> DataFrame:
        """Merges a batch of line_hashes; returns its keys: h1, h2, n (lines in the batch), owner, is_new."""
        keys = lines.groupBy(*HASH).agg(F.min("doc_id").alias("own"), F.count("*").alias("n"))
        names = [n for level in self.levels for n in level]
        for k, name in enumerate(names):
            keys = keys.join(self._run(name).withColumnRenamed("owner", f"owner_{k}"), HASH, "left")
        earlier = F.coalesce(*[F.col(f"owner_{k}") for k in range(len(names))], F.lit(None).cast("long"))
        name = self._write(keys.select(*HASH, "n", F.coalesce(earlier, "own").alias("owner"), earlier.isNull().alias("is_new")))
        self.levels[0].append(name)
        return self.spark.table(name)

    def compact(self) -> None:
        """Merges each full level into one run of the next."""
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                if k + 1 == len(self.levels):
                    self.levels.append([])
                old, self.levels[k] = self.levels[k], []
                union = reduce(DataFrame.unionByName, [self._run(n) for n in old])
                self.levels[k + 1].append(self._write(union.repartition(self.buckets, *HASH).withColumns({"n": F.lit(1).cast("long"), "is_new": F.lit(True)})))
                self.forget(old)

    def forget(self, names: list[str] | None = None) -> None:
        for name in names if names is not None else [n for level in self.levels for n in level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            dropped(self.spark, self.paths.pop(name))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 5, fanout: int = 3, also: list[str] | None = None, copies: bool = False) -> DataFrame:
    """doc_id, text (without dropped lines), n_lines, n_dropped and the columns `also`; one row per input row.
    copies: also copy_of, an earlier document that holds every dropped line or the whole text, where there is one."""
    spark, also = df.sparkSession, also or []
    if taken := {"doc_id", "text", "n_lines", "n_dropped", "copy_of"} & set(also):
        raise ValueError(f"columns of the result can't be asked for besides: {sorted(taken)}")
    more = [F.struct(*also).alias("more")] if also else []
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    texts = docs.select("doc_id", "text").filter("doc_id is not null")
    cuts = texts.approxQuantile("doc_id", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    runs, drops = LineRuns(spark, fanout), []
    one_owner = F.when(F.min("owner") == F.max("owner"), F.min("owner"))
    try:
        for low, high in zip(bounds, bounds[1:], strict=False):
            batch = texts if low is None else texts.filter(F.col("doc_id") > low)
            batch = batch if high is None else batch.filter(F.col("doc_id") <= high)
            lines, path = staged(line_hashes(batch, min_chars, copies), "line_hashes")
            runs.compact()
            keys = runs.add(lines)
            total = keys.agg(F.sum("n")).first()[0] or 0
            shared = keys.filter(~F.col("is_new") | (F.col("n") > 1)).select(*HASH, "n", "owner")
            gone = looked_up(lines, shared, HASH, total).filter(F.col("doc_id") > F.col("owner"))
            whole = F.max(F.when(F.col("pos") < 0, F.col("owner")))
            drop = gone.groupBy("doc_id", "doc_hash").agg(F.array_remove(F.collect_set("pos"), -1).alias("gone"), *([F.coalesce(whole, one_owner).alias("copy_of")] if copies else []))
            drops.append(staged(drop, "line_drops")[0])
            dropped(spark, path)
    finally:
        runs.forget()
    whole = docs.withColumn("doc_hash", F.xxhash64("text")).join(reduce(DataFrame.unionByName, drops), ["doc_id", "doc_hash"], "left")
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n"))
    return whole.select("doc_id", kept.alias("text"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), *(["copy_of"] if copies else []), *(["more.*"] if also else []))
