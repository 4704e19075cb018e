"""SimHash near-duplicate groups by covering locality-sensitive hashing.

1. One pass fingerprints every text: a bit is set if it is set in over half the hashes of the text's shingles.
2. Texts with equal fingerprints become one node, so groups of copies cost one row each.
3. Covering masks: bit i has a vector of radius + 1 bits; the mask of table v holds the bits whose vector has an odd
   product with v. The vectors of `radius` differing bits leave some v orthogonal to them all, so every pair within
   the radius agrees on the mask of that table: 7 tables of about 37 bits find all pairs, none by chance.
4. Nodes that meet in a bucket are compared. A bucket of up to SMALL nodes compares its pairs and gives those within
   the radius. In a larger one every node names the points one bit away from it outside the mask: two nodes of the
   bucket differ in two bits or fewer exactly if they name the same point. So work is linear in a bucket's size.
5. Components: the smallest doc_id reachable.

Null, empty and wordless texts have fingerprint zero and are linked like any other. Repeated rows have the same
fingerprint and one node. A null doc_id gets its text's fingerprint and group, and stands for no group: component_id is
null only where no row of the group has a doc_id. Texts of any length are read whole. Empty tables give empty results;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, looked_up, new_path, scratch, slices, staged, written
from fleetlens.llm.minhash import components

BITS, RADIUS, SEED = 64, 2, 42
#: Nodes of a bucket up to which its pairs are compared; larger buckets go by shared points.
SMALL = 32
#: Shingle hashes whose bits are counted at once; bounds memory.
BLOCK = 1 << 14


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    """One mask for each of the 2^(radius + 1) - 1 tables; any `radius` bits are outside of at least one of them."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]


def fingerprint(text: bytes, k: int = 3) -> int:
    """The fingerprint of a text in UTF-8 as an unsigned integer."""
    words = text.lower().split()  # on bytes both know ASCII only
    if not words:
        return 0
    k, joined = min(k, len(words)), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: len(words) - k + 1]
    stops, counts, digest = ends[k - 1 :], np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), BLOCK):
        part = zip(starts[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long): one row per input row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch):
                fps = [signed(fingerprint(text, k)) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fp long")


def in_tables(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """t, key, fp: the bucket of each node in each table."""
    spots = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)]
    return nodes.select("fp", F.explode(F.array(*spots)).alias("s")).select("s.t", "s.key", "fp")


def near_pairs(shared: DataFrame) -> DataFrame:
    """Links (a, b) within buckets of up to SMALL nodes: pairs that differ in up to RADIUS bits."""
    buckets = shared.groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))

    def partners(x: Column) -> Column:
        close = F.filter("fps", lambda y: (y > x) & (F.bit_count(x.bitwiseXOR(y)) <= RADIUS))
        return F.transform(close, lambda y: F.struct(x.alias("a"), y.alias("b")))

    return buckets.select(F.explode(F.flatten(F.transform("fps", partners))).alias("p")).select("p.a", "p.b").distinct()


def by_points(shared: DataFrame, masks: list[int]) -> DataFrame:
    """Links (a, b) within buckets of any size: nodes that name the same point, each with the smallest of them.

    A point has at most BITS + 1 neighbours, so its group is small whatever the bucket holds."""
    free = F.array(*[F.array(F.lit(0), *[F.lit(signed(1 << i)) for i in range(BITS) if not m >> i & 1]) for m in masks])
    points = shared.withColumn("flip", F.explode(F.element_at(free, F.col("t") + 1))).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    met = points.groupBy("point").agg(F.array_sort(F.collect_set("fp")).alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.col("fps")[0].alias("a"), F.explode(F.slice("fps", 2, BITS)).alias("b")).distinct()


def bucket_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b), staged, that connect all fingerprints within the radius of each other. nodes: fp, distinct."""
    masks = covering_masks()
    rows = in_tables(nodes, masks)
    buckets, b_path = staged(rows.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").withColumn("size", F.col("n")), "buckets")
    total = buckets.agg(F.sum("n")).first()[0] or 0
    shared, s_path = staged(looked_up(rows, buckets, ["t", "key"], total), "shared")
    pairs, points = near_pairs(shared.filter(F.col("size") <= SMALL)), by_points(shared.filter(F.col("size") > SMALL), masks)
    links, _ = staged(pairs.unionByName(points), "links")
    dropped(nodes.sparkSession, b_path, s_path)
    return links


def near_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: one row per input row."""
    path = new_path(df.sparkSession, "near_fingerprints")
    with scratch(df.sparkSession):
        fps, _ = staged(fingerprints(df, id_col, text_col, words), "fingerprints")
        nodes, _ = staged(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")), "nodes")
        comp, _ = components(bucket_links(nodes))
        placed = nodes.join(comp.select(F.col("doc_id").alias("fp"), "component"), "fp", "left")
        placed, _ = staged(placed.select("fp", "first_id", F.col("n").alias("copies"), F.coalesce("component", "fp").alias("component")), "placed")
        groups = placed.groupBy("component").agg(F.count("*").alias("n"), F.min("first_id").alias("component_id"))
        named, _ = staged(looked_up(placed, groups, ["component"], nodes.count()).select("fp", F.col("copies").alias("n"), "component_id"), "named")
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
        return written(looked_up(fps, named, ["fp"], fps.count()).select("doc_id", hexed, "component_id"), path)
