"""MinHash near-duplicate groups with sequential Bayesian verification.

1. One pass sketches every text: number of distinct shingles, digest of the shingle set, band keys of its MinHash
   signature. Signatures are made again with the full sets, of the texts that share a band with another.
2. Texts with equal sets become one node (the smallest doc_id), so groups of copies cost one row each.
3. Nodes that share a band are candidates. Within a bucket no all-pairs step:
   every node is compared with the bucket's first node, the links found are joined to components, then in `rounds`
   turns the nodes outside a bucket's main component are compared with one member of it each (all linear). Pairs
   within one component can't change the result, so no link that matters is left out, whatever `rounds` is.
   What is still apart is then joined by its differences to a centre (`difference_keys`), which needs no pairs of
   what is alike only in what all of a group share.
4. A candidate pair's signatures are compared batch by batch; as soon as the posterior probability of a
   similarity at or above the threshold falls below `miss`, the pair is pruned. Survivors are verified exactly
   on their full shingle sets.
5. Components: smallest reachable doc_id by label propagation with pointer jumping, staged in the shared folder.

Bands: a pair at exactly 0.8 shares none of 42 bands of 6 rows with probability 3e-6, far less above it.

Null, empty or wordless texts have no shingles and are linked with nothing. Repeated rows are one node; of a doc_id
with several texts, each row joins the group of its own text's copies, and where the id stands for such a group, the
text of smallest hash is compared. A null doc_id gives component null and kept true. Ties can't occur (ids are
compared). Texts of any length are read whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, looked_up, slices, staged, texts_of
from fleetlens.llm.shingles import WordHashes, sequence_hashes, white_words

BANDS, ROWS, BATCH = 42, 6, 42
#: Columns of a shingle set that are hashed at once; bounds memory.
BLOCK = 2048


@lru_cache(maxsize=1)
def _seeds() -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**32, (3, BANDS * ROWS, 1), np.uint32) | np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """16 bits (8 to 23) of each of the BANDS * ROWS smallest hashes."""
    a, b, c = _seeds()
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for k in range(0, len(x), BLOCK):
        y = x[None, k : k + BLOCK] ^ a
        y *= b
        y ^= y >> np.uint32(15)
        y *= c
        np.minimum(least, y.min(axis=1), out=least)
    return (least >> np.uint32(8)).astype("<u2")


@lru_cache(maxsize=1)
def _factors() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, (BANDS, ROWS), np.uint64) | np.uint64(1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """BANDS keys of a signature: one hash for each band, unlike for the same rows in another band."""
    rows, mul, key = sig.reshape(BANDS, ROWS).astype(np.uint64), _factors(), np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = (key ^ rows[:, r]) * mul[:, r]
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def hashed_texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest, bands (keys of the signature's bands) of (doc_id, text); digest is null and
    bands empty for texts without words."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in it:
            for part in slices(batch):
                n, digests, keys = [], [], []
                for text in part.column(1).to_pylist():
                    s = np.unique(sequence_hashes(white_words(text), k, known))
                    n.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), bands], ["doc_id", "text_hash", "n_shingles", "digest", "bands"])

    return hashed_texts(docs).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>")


def least_matches(percent: int, miss: float, batch: int = BATCH, hashes: int = BANDS * ROWS) -> dict[int, int]:
    """For each number of compared hashes: the fewest matches with posterior P(similarity >= percent) >= miss.

    With a uniform prior the posterior after m matches of n is Beta(m + 1, n - m + 1), whose upper tail at t is
    P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, {}
    for n in range(batch, hashes + 1, batch):
        tail, m = 0.0, 0
        while True:
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if tail >= miss:
                break
            m += 1
        out[n] = m
    return out


def survivors(pairs: DataFrame, sigs: DataFrame, percent: int, miss: float) -> DataFrame:
    """Pairs (a, b) that sequential comparison of signature batches doesn't prune."""
    least = least_matches(percent, miss)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            a, b = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, BANDS * ROWS) for k in (2, 3))
            alive, matches, start = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, m in least.items():
                matches = matches + (left[alive, start:n] == right[alive, start:n]).sum(axis=1)
                keep = matches >= m
                alive, matches, start = alive[keep], matches[keep], n
            yield pa.RecordBatch.from_arrays([pa.array(a[alive]), pa.array(b[alive])], ["a", "b"])

    sig = sigs.select("doc_id", "sig")
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles, sig: the whole set of each text, packed, and its signature."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in it:
            for part in slices(batch):
                sets, sigs = [], []
                for text in part.column(1).to_pylist():
                    s = np.unique(sequence_hashes(white_words(text), k, known))
                    sets.append(s.tobytes())
                    sigs.append(signature(s).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "shingles", "sig"])

    return docs.mapInArrow(run, "doc_id long, shingles binary, sig binary")


def mains(placed: DataFrame) -> DataFrame:
    """key, main: the largest component of each bucket that more than one component meets in. placed: key, comp."""
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("size"))
    return sizes.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1").select("key", "main")


def sized(placed: DataFrame, percent: int) -> DataFrame:
    """Buckets split by size: every node stands in its class of size and the next, so two that are near enough in size
    to be linked meet in one of them. placed: key, n_shingles and others."""
    ratio = float(np.log(100 / percent * 1.0001))  # over the largest ratio of linked sizes, so classes differ by 1 at most
    at = F.floor(F.log("n_shingles") / ratio)
    return placed.withColumn("at", F.explode(F.array(at, at + 1))).withColumn("key", F.xxhash64("key", "at")).drop("at")


def differences(spots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each node and the centre of a group it stands in: main, doc_id, comp, n (its shingles), n_center, inside
    (in the centre's component), linked (similar enough to the centre), d (shingles that one of the two lacks)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, center_sizes, lists = [], [], []
                for x, y in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True):
                    x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)
                    lists.append(np.setxor1d(x, y, assume_unique=True))
                    sizes.append(len(x))
                    center_sizes.append(len(y))
                size, n, n_center = np.array([len(x) for x in lists]), np.array(sizes), np.array(center_sizes)
                linked = (100 + percent) * size <= (100 - percent) * (n + n_center)
                d = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.concatenate(lists)))
                inside = pa.array(part.column(0).to_numpy() == part.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n), pa.array(n_center), inside, pa.array(linked), d], ["main", "doc_id", "comp", "n", "n_center", "inside", "linked", "d"])

    own = sets.select("doc_id", F.col("shingles").alias("own"))
    center = sets.join(spots.select(F.col("main").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("main"), F.col("shingles").alias("center"))
    both = spots.join(own, "doc_id").join(center, "main").select("main", "doc_id", "comp", "own", "center")
    return both.mapInArrow(run, "main long, doc_id long, comp long, n long, n_center long, inside boolean, linked boolean, d array<long>")


def difference_keys(found: DataFrame, percent: int, classes: int = 24) -> DataFrame:
    """key, doc_id, comp, apart, size, excess: two nodes of a group that are linked, one of them not linked to the
    centre, share a key (one as `apart`, the other not).

    With X and Y the differences of two sets to any third set, the sets are linked exactly if
    2 (100 + p) |X and Y| >= excess(X) + excess(Y), where excess(X) = (100 + p) |X| - (100 - p) n. So what nearly all
    have in common drops out, and the sets to be joined are small. This sum is positive wherever one of the two isn't
    linked to the centre, so they must share some difference. Prefix filter: with elements in a common order, rare
    ones first, two sets with T common elements share one among the first |X| - T + 1 and |Y| - T + 1. T depends on
    the partner's excess, so a node has keys for each class of it (`classes` steps within the centre's size).
    Elements that no other node of the group has can't be shared and are left out first.
    found: the columns of `differences`.
    """
    most, less = 100 + percent, 100 - percent

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out: list[list] = [[] for _ in range(6)]
            names = ["main", "doc_id", "comp", "n", "n_center", "apart", "size", "rare"]
            for main, doc, comp, n, n_center, apart, size, rare in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                excess, step, d = most * size - less * n, most * max(1, n_center // classes), len(rare)
                mine = excess // step
                e = np.array([x["h"] for x in rare], np.int64).view(np.uint64)
                low = -(less * n_center) // step if apart else less * n_center // step
                for other in range(low, (2 * most * d - excess) // step + 1):
                    need = max(1, -(-(excess + other * step) // (2 * most)))
                    largest = ((other + 1) * step + less * n_center) // (2 * percent)
                    if need > d or need > largest:
                        continue
                    first = e[: d - need + 1]
                    for side in (True, False):
                        if side and not apart:
                            continue
                        pair = (mine, other) if side else (other, mine)
                        key = (first ^ np.uint64(hash((main, *pair)) % 2**64)) * np.uint64(0x9E3779B97F4A7C15)
                        for col, x in zip(out, (key.view(np.int64).tolist(), [doc] * len(first), [comp] * len(first), [side] * len(first), [d] * len(first), [excess] * len(first)), strict=True):
                            col += x
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], ["key", "doc_id", "comp", "apart", "size", "excess"])

    rows = found.select("main", "doc_id", F.explode("d").alias("h"))
    counted = rows.groupBy("main", "h").agg(F.count("*").alias("n")).filter("n > 1").withColumn("df", F.col("n"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    shared = looked_up(rows, counted, ["main", "h"], total).groupBy("main", "doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("rare"))
    facts = found.select("main", "doc_id", "comp", "n", "n_center", (~F.col("inside") & ~F.col("linked")).alias("apart"), F.size("d").cast("long").alias("size"))
    return facts.join(shared, ["main", "doc_id"]).mapInArrow(run, "key long, doc_id long, comp long, apart boolean, size long, excess long")


def met_across(keys: DataFrame) -> DataFrame:
    """Pairs (x as `apart`, doc_id not) of unlike components that share a key, with sizes and excesses; pairs within one
    component never meet. keys: the columns of `difference_keys`.

    Keys that one component holds alone drop out before the join. In another the components are numbered, and for each
    bit those whose numbers agree above it and differ in it meet: so two unlike numbers meet once, at their highest
    unlike bit, and like ones never.
    """
    mixed = keys.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or("apart").alias("any"), F.bool_and("apart").alias("all"))
    held = keys.join(mixed.filter("low <> high and any and not all").select("key"), "key")
    comps = held.select("key", "comp").distinct()
    by_key = Window.partitionBy("key")
    numbers = comps.select("key", "comp", (F.dense_rank().over(by_key.orderBy("comp")) - 1).alias("number"), F.count("*").over(by_key).alias("comps"))
    bits = F.sequence(F.lit(0), F.ceil(F.log2(F.col("comps").cast("double"))).cast("int") - 1)
    placed = held.join(numbers, ["key", "comp"]).withColumn("bit", F.explode(bits)).withColumns({"above": F.expr("shiftright(number, bit + 1)"), "side": F.expr("shiftright(number, bit) & 1")})
    x = placed.filter("apart").select("key", "bit", "above", "side", F.col("doc_id").alias("x"), F.col("size").alias("size_x"), F.col("excess").alias("excess_x"))
    y = placed.filter("not apart").select("key", "bit", "above", (1 - F.col("side")).alias("side"), "doc_id", "size", "excess")
    return x.join(y, ["key", "bit", "above", "side"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on full sets. Only sets of texts in a pair are dealt out."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for at in range(0, batch.num_rows, 500):
                for a, b, x, y in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns), strict=True):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate([x, y])
                    both.sort()
                    inter = int((both[1:] == both[:-1]).sum())
                    if 100 * inter >= percent * (len(both) - inter):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    held = sets.select("doc_id", "shingles").join(ends, "doc_id", "left_semi")
    one = pairs.join(held.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a")), "a")
    return one.join(held.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b")), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> tuple[DataFrame, str]:
    """doc_id, component (smallest reachable doc_id) for every end of a link (a, b); and the table's path."""
    spark = links.sparkSession
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels, path = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).select(F.col("a").alias("doc_id"), "component"), "labels")
    while True:
        near = both.join(labels, both.b == labels.doc_id).groupBy(F.col("a").alias("doc_id")).agg(F.min("component").alias("near"))
        met = labels.join(near, "doc_id").select("doc_id", F.col("component").alias("was"), F.least("component", "near").alias("met"))
        jump = labels.select(F.col("doc_id").alias("met"), F.col("component").alias("further"))
        now, new_path = staged(met.join(jump, "met").select("doc_id", F.least("met", "further").alias("component"), (F.least("met", "further") < F.col("was")).alias("moved")), "labels")
        moved = not now.filter("moved").isEmpty()
        dropped(spark, path)
        labels, path = now.drop("moved"), new_path
        if not moved:
            return labels, path


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, miss: float = 1e-6, rounds: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    spark = df.sparkSession
    docs = texts_of(df, id_col, text_col)
    sk, sk_path = staged(sketches(docs, words), "sketches")
    counted, c_path = staged(sk.filter("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "digests")
    total = counted.agg(F.sum("n")).first()[0] or 0
    own = looked_up(sk.filter("doc_id is not null and digest is not null").select("doc_id", "n_shingles", "digest"), counted, ["digest"], total).select("doc_id", "n_shingles", "node")
    members, m_path = staged(own, "members")
    alone, a_path = staged(sk.filter("doc_id is null or digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")), "alone")
    # the bands of a text travel once: what stands for a node is chosen without them
    worded = sk.filter("doc_id is not null and digest is not null")
    of_node = worded.select("doc_id", "text_hash", "digest").join(counted.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).groupBy("doc_id").agg(F.min("text_hash").alias("text_hash"))
    nodes, n_path = staged(worded.select("doc_id", "text_hash", "n_shingles", "bands").dropDuplicates(["doc_id", "text_hash"]).join(of_node, ["doc_id", "text_hash"]), "nodes")
    dropped(spark, sk_path, c_path)

    rows = nodes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    buckets, b_path = staged(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).filter("n > 1"), "buckets")
    in_buckets = buckets.agg(F.sum("n")).first()[0] or 0
    shared, s_path = staged(looked_up(rows, buckets, ["key"], in_buckets), "shared")
    wanted = nodes.join(shared.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text_hash")
    sets, t_path = staged(full_sets(hashed_texts(docs).join(wanted, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text"), words), "sets")
    dropped(spark, n_path, b_path)

    def ordered(x: str, y: str) -> list:
        return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]

    def linked(pairs: DataFrame) -> DataFrame:
        alive, alive_path = staged(survivors(pairs, sets, percent, miss), "alive")  # so its size is known before sets are dealt out
        spent.append(alive_path)
        return verified(alive, sets, percent)

    spent = [s_path, t_path]
    tried, path = staged(shared.filter("doc_id <> first").select(*ordered("doc_id", "first")).distinct(), "tried")
    links, l_path = staged(linked(tried), "links")
    spent += [path, l_path]
    for turn in range(rounds + 1):
        comp, comp_path = components(links)
        placed = shared.select("key", "doc_id", "n_shingles").join(comp, "doc_id", "left").select("key", "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("comp"))
        mixed_rows, q_path = staged(placed.join(mains(placed), "key"), "mixed")
        spent += [comp_path, q_path]
        if mixed_rows.isEmpty():
            break
        if turn < rounds:  # each one outside against one member of the main component, another in each bucket and turn
            apart = mixed_rows.filter("comp <> main").select("key", F.col("doc_id").alias("x"), F.col("comp").alias("comp_x"), F.col("n_shingles").alias("n_x"))
            draw = F.xxhash64("doc_id", "key", F.lit(turn))
            others = mixed_rows.filter("comp = main").groupBy("key").agg(F.min_by(F.struct("doc_id", "n_shingles", "comp"), draw).alias("o")).select("key", "o.*")
            most = F.least("n_shingles", "n_x")  # no intersection is larger
            close = (F.col("comp") != F.col("comp_x")) & (100 * most >= percent * (F.col("n_shingles") + F.col("n_x") - most))
            fresh = apart.join(others, "key").filter(close).select(*ordered("x", "doc_id"))
        else:
            by_size = sized(mixed_rows.drop("main"), percent)
            spots, p_path = staged(by_size.join(mains(by_size), "key").select("main", "doc_id", "comp").distinct(), "spots")
            found, f_path = staged(differences(spots, sets, percent), "differences")
            links = links.unionByName(found.filter("linked and not inside").select(*ordered("main", "doc_id")))
            groups = found.groupBy("main").agg(F.count("*").alias("n"), F.count_if(~F.col("inside") & ~F.col("linked")).alias("open"))
            open_groups = groups.filter("open > 0").drop("open")  # a group may hold a third of all nodes
            total = open_groups.agg(F.sum("n")).first()[0] or 0
            keys, k_path = staged(difference_keys(looked_up(found, open_groups, ["main"], total), percent), "keys")
            spent += [p_path, f_path, k_path]
            close = 2 * (100 + percent) * F.least("size", "size_x") >= F.col("excess") + F.col("excess_x")
            fresh = met_across(keys).filter(close).select(*ordered("x", "doc_id"))
        new, path = staged(fresh.distinct().join(tried, ["a", "b"], "left_anti"), "tried")
        more, l_path = staged(linked(new), "links")
        spent += [path, l_path]
        tried, links = tried.unionByName(new), links.unionByName(more)
    final, final_path = components(links)
    out = members.join(final.withColumnRenamed("doc_id", "node"), "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    result, _ = staged(out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "near_duplicates")
    dropped(spark, *spent, a_path, m_path, final_path)
    return result
