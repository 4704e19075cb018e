"""Prefix trie of conversations: what a cache of shared prefixes holds and saves.

1. Turns get ids from a dictionary table of the distinct (role, text); ids are unique long integers, hot turns are
   looked up apart. Positions are numbered in two levels (`earlier`), so no task sorts a whole conversation.
2. A conversation becomes rows of up to BLOCK turn ids. Prefixes that end between rows are known by 128-bit hashes of
   the rows before. Equal conversations become one, with their number; then equal rows behind the same prefix do.
3. Rows are sorted by (prefix, ids) and cut into range shards. Each shard builds ternary search trees, one for each
   prefix: rows go in by medians, so that trees are balanced, and an iterative walk adds up members, children, leaves
   and savings of every node.
4. Nodes that several shards hold (on the first and last path of a shard) are merged by key. A shard knows the rows
   next to it, so what its neighbour has counted isn't counted again, and the parts only need adding.
5. What lies below a full row is added to the nodes above it: each prefix's totals belong to its smallest conversation,
   sums along conversations give what is below any prefix. No step goes level by level.

A conversation may hold a third of all turns, a turn or a sequence a third of all conversations: rows of a conversation
are spread by range, copies are counted before they meet, hot turns and nodes are looked up apart.

Null role and text count as empty. Turns go by number, null first, then by (role, text) hash. Repeated rows are turns
of their own. Rows with a null conv_id belong to no conversation and are left out. Texts of any length are read whole
(as hash and length). Empty tables give no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import looked_up, new_path, scratch, staged, written

#: Turns of a row, rows of a shard.
BLOCK, SHARD_ROWS = 32, 5000
NODE = "k1 long, k2 long, up1 long, up2 long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_of long, path array<struct<k1:long,k2:long>>, own_leaves long, own_saved long"


def ranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df as a table in the given order, with part, the number of a row's range. A key of any size is spread over ranges."""
    return staged(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)[0]


def earlier(placed: DataFrame, key: str, order: list[str], kind: str, **values: Column) -> DataFrame:
    """Adds for each name the sum (kind sum) or exclusive or (kind bit_xor) of a value over the key's earlier rows.

    placed: from `ranged` by key and order. Two levels: within a range, and over the ranges of a key before it."""
    f, join = (F.sum, lambda a, b: a + b) if kind == "sum" else (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    parts = placed.groupBy(key, "part").agg(*[f(v).alias(f"{n}_own") for n, v in values.items()])
    behind = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = parts.select(key, "part", *[F.coalesce(f(f"{n}_own").over(behind), F.lit(0)).alias(f"{n}_shift") for n in values])
    w = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = placed.withColumns({n: F.coalesce(f(v).over(w), F.lit(0)) for n, v in values.items()})
    return within.join(shifts, [key, "part"]).withColumns({n: join(F.col(n), F.col(f"{n}_shift")) for n in values}).drop(*[f"{n}_shift" for n in values])


def encoded(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns, convs): conv_id, pos (from 0), tid (dictionary id), size (UTF-8 bytes of the text); conv_id, n (turns)."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.xxhash64(r, t).alias("h1"), F.xxhash64(F.lit("turn"), t, r).alias("h2"), F.octet_length(t).cast("long").alias("size"),
    )
    placed = ranged(rows, ["conv_id", "turn", "h1"], "turns")
    ids, _ = staged(placed.groupBy("h1", "h2").agg(F.count("*").alias("n")).withColumn("tid", F.monotonically_increasing_id()), "turn_ids")
    named = looked_up(placed, ids, ["h1", "h2"], placed.count())
    turns, _ = staged(earlier(named, "conv_id", ["turn", "h1", "h2"], "sum", pos=F.lit(1)).select("conv_id", "pos", "tid", "size"), "encoded")
    return turns, staged(placed.groupBy("conv_id").agg(F.count("*").alias("n")), "convs")[0]


def rebuilt(turns: DataFrame, convs: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """conv_id, pos, tid, size of the rebuilt conversations: the first h turns of conversation c - c % every, h being
    crc32(c) % heads, then c's own turns after its first h."""
    c = F.col("conv_id")
    first = turns.filter(F.col("pos") < heads - 1).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tid", "size"))).alias("first"))
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    led = convs.select("conv_id", "n", (c - c % every).alias("leader"), h.alias("h")).join(first.withColumnRenamed("conv_id", "leader"), "leader", "left")
    head = F.when(F.col("h") > 0, F.slice("first", F.lit(1), F.greatest("h", F.lit(1))))
    plan, _ = staged(led.select("conv_id", "n", "h", F.coalesce(head, F.array().cast("array<struct<pos:bigint,tid:bigint,size:bigint>>")).alias("head")), "heads")
    lent = plan.select("conv_id", F.inline("head"))
    own = looked_up(turns, plan.select("conv_id", "n", "h", F.size("head").alias("lent")), ["conv_id"], turns.count())
    return lent.select("conv_id", "pos", "tid", "size").unionByName(own.filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "tid", "size"))


class Tree:
    """Ternary search tree of rows of turn ids behind one prefix. Node 0 is the prefix itself."""

    def __init__(self) -> None:
        self.tid, self.size, self.up, self.level = [0], [0], [0], [0]
        self.lo, self.eq, self.hi = [0], [0], [0]
        self.weight, self.least, self.end_of, self.goes_on = [0], [None], [None], [None]

    def insert(self, ids: list[int], sizes: list[int]) -> int:
        """The node at the end of the row; nodes that it needs are added."""
        at = 0
        for t, size in zip(ids, sizes, strict=True):
            links, place = self.eq, at
            while (found := links[place]) and self.tid[found] != t:
                links, place = (self.lo if t < self.tid[found] else self.hi), found
            if not found:
                found = links[place] = len(self.tid)
                for column, value in ((self.tid, t), (self.size, size), (self.up, at), (self.level, self.level[at] + 1), (self.lo, 0), (self.eq, 0), (self.hi, 0), (self.weight, 0), (self.least, None), (self.end_of, None), (self.goes_on, None)):
                    column.append(value)
            at = found
        return at

    def walk(self) -> list[int]:
        """All nodes, each before the nodes below it."""
        out, stack = [0], [self.eq[0]]
        while stack:
            if v := stack.pop():
                out.append(v)
                stack += (self.hi[v], self.eq[v], self.lo[v])
        return out


def by_medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle first, then the middles of both halves."""
    spans = [(0, n)]
    for a, b in spans:
        if a < b:
            yield (a + b) // 2
            spans += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]


def shared_length(row: dict | None, other: dict | None) -> int:
    """How many ids two rows begin with in common; -1 if they are behind different prefixes."""
    if row is None or other is None or any(row[c] != other[c] for c in ("block", "p1", "p2")):
        return -1
    n = 0
    for a, b in zip(row["ids"], other["ids"], strict=False):
        if a != b:
            break
        n += 1
    return n


def tree_nodes(rows: list[dict], before: int, after: int, length: int) -> Iterator[tuple]:
    """The nodes of the rows behind one prefix, sorted by ids, as tuples of NODE. before, after: how many ids the first
    and last row share with the neighbouring shard's row (-1: it is behind another prefix). length: of a full row."""
    tree, block = Tree(), rows[0]["block"]
    ends = [0] * len(rows)
    for k in by_medians(len(rows)):
        row, v = rows[k], tree.insert(rows[k]["ids"], rows[k]["sizes"])
        ends[k] = v
        tree.weight[v], tree.least[v], tree.end_of[v] = row["weight"], row["least"], row["end_of"]
        tree.goes_on[v] = (row["next1"], row["next2"]) if row["goes_on"] else None
    n, up = len(tree.tid), tree.up
    again, keyed = [False] * n, [False] * n
    keyed[0] = True
    for end, most in ((ends[0], before), (ends[-1], after)):
        v = end
        while v:
            if tree.level[v] <= most:
                keyed[v] = True
                again[v] = again[v] or end == ends[0] and tree.level[v] <= before
            v = up[v]
    for v in range(1, n):
        if tree.goes_on[v]:
            while v and not keyed[v]:
                keyed[v], v = True, up[v]
    key: list = [(rows[0]["p1"], rows[0]["p2"])] + [None] * (n - 1)
    order = tree.walk()
    for v in order[1:]:
        if keyed[v]:
            seed = xxhash.xxh128_digest(b"%d %d %d" % (*key[up[v]], tree.tid[v]))
            key[v] = tree.goes_on[v] or (int.from_bytes(seed[:8], "big", signed=True), int.from_bytes(seed[8:], "big", signed=True))
    members, least, children, leaves, saved = tree.weight, tree.least, [0] * n, [0] * n, [0] * n
    extended = ends[-1] if after == len(rows[-1]["ids"]) else -1
    for v in reversed(order[1:]):
        if not tree.eq[v] and not tree.goes_on[v] and v != extended:
            leaves[v] = 1
        saved[v] += (members[v] - (not again[v])) * tree.size[v]
        u = up[v]
        members[u] += members[v]
        least[u] = least[v] if least[u] is None else min(least[u], least[v])
        children[u] += not again[v]
        leaves[u] += leaves[v]
        saved[u] += saved[v]
    for v in order:
        path = None
        if tree.goes_on[v]:
            path, u = [], v
            while u or (not block and not (path and path[-1] == key[0])):
                path.append(key[u])
                u = up[u]
        u, mine = up[v], key[v] or (None, None)
        above = key[u] if v and keyed[u] else (None, None)
        if v or not block:
            yield (*mine, *above, block * length + tree.level[v], least[v], least[u] if v and not keyed[u] else None, members[v], children[v], leaves[v], saved[v], tree.end_of[v], path, None, None)
        else:  # the prefix is a node of the block before; what is below comes to it through the totals
            yield (*mine, None, None, block * length, None, None, 0, children[0], 0, 0, None, None, leaves[0], saved[0])


def shard_nodes(shard: pa.Table, length: int) -> pa.Table:
    """The nodes of one shard, as NODE says."""
    rows = sorted(shard.to_pylist(), key=lambda r: (r["guard"], r["block"], r["p1"], r["p2"], r["ids"]))
    guards = {r["guard"]: r for r in rows if r["guard"]}
    rows, out, at = [r for r in rows if not r["guard"]], [], 0
    while at < len(rows):
        stop = at
        while stop < len(rows) and all(rows[stop][c] == rows[at][c] for c in ("block", "p1", "p2")):
            stop += 1
        before = shared_length(rows[at], guards.get(-1)) if at == 0 else -1
        after = shared_length(rows[stop - 1], guards.get(1)) if stop == len(rows) else -1
        out += tree_nodes(rows[at:stop], before, after, length)
        at = stop
    fields = [pa.field(x.split()[0], pa.int64()) for x in NODE.split(", ") if "array" not in x]
    fields.insert(12, pa.field("path", pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64())]))))
    columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
    columns[12] = [p and [{"k1": a, "k2": b} for a, b in p] for p in columns[12]]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def digests(members: DataFrame) -> DataFrame:
    """rep, ends_sha256 of (rep, conv_id): the digest of the group's ids, ascending, comma-joined. Groups of any size
    pass through the digest in chunks."""
    placed = ranged(members, ["rep", "conv_id"], "members")
    chunks = placed.groupBy("rep", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").cast("binary").alias("chunk"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, digest = None, None
        for batch in it:
            reps, out = [], []
            for r, chunk in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if r != rep:
                    if digest is not None:
                        reps.append(rep)
                        out.append(digest.hexdigest())
                    rep, digest = r, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(chunk.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(out, pa.string())], ["rep", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["rep", "ends_sha256"])

    return chunks.repartition("rep").sortWithinPartitions("rep", "part").select("rep", "part", "chunk").mapInArrow(run, "rep long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. turns: conv_id, pos, tid, size, positions from 0 without gaps; convs: conv_id, one row
    for each conversation, with turns or without."""
    at = F.floor(F.col("pos") / block).cast("long")
    in_order = F.array_sort(F.collect_list(F.struct("pos", "tid", "size")))
    cut = turns.groupBy("conv_id", at.alias("block")).agg(in_order.alias("x")).select("conv_id", "block", F.col("x.tid").alias("ids"), F.col("x.size").alias("sizes"))
    cut = cut.withColumns({"g1": F.xxhash64("block", "ids"), "g2": F.xxhash64(F.lit("row"), "ids", "block")})
    placed = ranged(cut, ["conv_id", "block"], "rows")
    whole = placed.groupBy("conv_id").agg(F.bit_xor("g1").alias("a1"), F.bit_xor("g2").alias("a2"), F.sum(F.size("ids")).alias("length"), F.max("block").alias("last"))
    known, _ = staged(convs.select("conv_id").join(whole, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("a1", "a2", "length")], F.coalesce("last", F.lit(-1)).alias("last")), "sequences")
    same, _ = staged(known.groupBy("a1", "a2", "length").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.min("last").alias("last")), "copies")
    members = looked_up(known.select("conv_id", "a1", "a2", "length"), same.select("a1", "a2", "length", "rep", "n"), ["a1", "a2", "length"], known.count()).select("rep", "conv_id")

    prefixed = earlier(placed, "conv_id", ["block"], "bit_xor", p1=F.col("g1"), p2=F.col("g2"))
    kept = looked_up(prefixed, same.select(F.col("rep").alias("conv_id"), F.col("n").alias("weight"), "last", F.ceil(F.col("length") / block).cast("long").alias("n")), ["conv_id"], placed.count())
    rows, _ = staged(kept.select("conv_id", "block", "p1", "p2", "ids", "sizes", "weight", (F.col("block") < F.col("last")).alias("on"), F.col("p1").bitwiseXOR(F.col("g1")).alias("next1"), F.col("p2").bitwiseXOR(F.col("g2")).alias("next2")), "prefixed")
    facts = [F.first("sizes").alias("sizes"), F.sum("weight").alias("weight"), F.min("conv_id").alias("least"), F.max(F.when(~F.col("on"), F.col("conv_id"))).alias("end_of"), F.max("on").alias("goes_on"), F.first("next1").alias("next1"), F.first("next2").alias("next2")]
    entries, _ = staged(rows.groupBy("block", "p1", "p2", "ids").agg(*facts), "entries")

    n = max(1, -(-entries.count() // shard_rows))
    shards, _ = staged(entries.repartitionByRange(n, "block", "p1", "p2", "ids").withColumn("shard", F.spark_partition_id()).withColumn("guard", F.lit(0)), "shards")
    spot = F.struct("block", "p1", "p2", "ids")
    bounds = shards.groupBy("shard").agg(F.min(spot).alias("first"), F.max(spot).alias("end"))
    by_shard = Window.orderBy("shard")  # one row for each shard
    beside = bounds.select("shard", F.lag("end").over(by_shard).alias("left"), F.lead("first").over(by_shard).alias("right"))
    guards = beside.select("shard", F.explode(F.array(*[F.struct(F.lit(g).alias("guard"), F.col(c).alias("r")) for g, c in ((-1, "left"), (1, "right"))])).alias("x"))
    guards = guards.filter("x.r is not null").select("shard", "x.guard", "x.r.*")
    nodes, _ = staged(shards.unionByName(guards, allowMissingColumns=True).groupBy("shard").applyInArrow(lambda shard: shard_nodes(shard, block), NODE), "nodes")

    bare = same.filter("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "depth", "n_children", "n_leaves", "saved_tokens")], F.col("rep").alias("conv_id"), F.col("n").alias("n_convs"), F.col("rep").alias("end_of"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.filter("k1 is not null").unionByName(bare, allowMissingColumns=True)
    merged, _ = staged(parts.groupBy("k1", "k2", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("end_of").alias("end_of"), F.max("up1").alias("up1"), F.max("up2").alias("up2")), "merged")

    # What is below full rows: the totals of each prefix belong to its smallest conversation.
    later = rows.filter("block > 0").select("conv_id", "block", "p1", "p2")
    totals = nodes.filter("own_leaves is not null").groupBy(F.col("k1").alias("p1"), F.col("k2").alias("p2")).agg(F.sum("own_leaves").alias("leaves"), F.sum("own_saved").alias("saved"))
    owners = later.groupBy("p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    owned = later.join(owners.join(totals, ["p1", "p2"]), ["p1", "p2", "conv_id"], "left").select("conv_id", (-F.col("block")).alias("back"), "p1", "p2", F.coalesce("leaves", F.lit(0)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"))
    below = earlier(ranged(owned, ["conv_id", "back"], "below"), "conv_id", ["back"], "sum", l=F.col("leaves"), s=F.col("saved"))
    under = below.groupBy("p1", "p2").agg(F.sum(F.col("l") + F.col("leaves")).alias("leaves"), F.sum(F.col("s") + F.col("saved")).alias("saved"))
    full = nodes.filter("path is not null").groupBy("k1", "k2").agg(F.first("path").alias("path"))
    added = full.join(under.withColumnsRenamed({"p1": "k1", "p2": "k2"}), ["k1", "k2"]).select(F.explode("path").alias("k"), "leaves", "saved").groupBy("k.k1", "k.k2").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    whole_nodes = merged.join(added, ["k1", "k2"], "left").withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("leaves", F.lit(0)), "saved_tokens": F.col("saved_tokens") + F.coalesce("saved", F.lit(0))})
    whole_nodes = whole_nodes.withColumn("n_leaves", F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves")))

    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_of"]
    plain = nodes.filter("k1 is null")
    inner = plain.filter("up1 is null").select(*shown)
    open_ = plain.filter("up1 is not null").drop("parent_conv_id").unionByName(whole_nodes.filter("up1 is not null"), allowMissingColumns=True)
    counted = open_.groupBy("up1", "up2").agg(F.count("*").alias("n")).join(merged.select(F.col("k1").alias("up1"), F.col("k2").alias("up2"), F.col("conv_id").alias("parent_conv_id")), ["up1", "up2"])
    counted, _ = staged(counted, "parents")
    outer = looked_up(open_, counted, ["up1", "up2"], counted.agg(F.sum("n")).first()[0] or 0).select(*shown)
    root = whole_nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*shown)
    every = inner.unionByName(outer).unionByName(root)
    none = hashlib.sha256().hexdigest()
    signed = every.join(digests(members).withColumnRenamed("rep", "end_of"), "end_of", "left")
    return signed.select(*shown[:-1], F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversation_trie(df: DataFrame, block: int = BLOCK, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The prefix trie of the rebuilt conversations of df (conv_id, turn, role, text), staged."""
    path = new_path(df.sparkSession, "trie")
    with scratch(df.sparkSession):
        turns, convs = encoded(df)
        again, _ = staged(rebuilt(turns, convs), "rebuilt")
        return written(prefix_trie(again, convs, block, shard_rows), path)
