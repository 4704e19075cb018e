"""The prefix trie against a dictionary of all prefixes: rebuilding, long conversations, shards that cut prefixes."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from fleetlens.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def slow_rebuild(rows):
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: y[0])] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def slow_nodes(convs):
    members, kids = collections.defaultdict(list), collections.defaultdict(set)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not kids[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    ends = lambda p: ",".join(str(c) for c in sorted(members[p]) if len(convs[c]) == len(p))
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items())


def told(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


def conversations():
    rng, rows = random.Random(4), []
    for c in range(150):
        for t in range(rng.randrange(0, 14)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 3 else "user", rng.choice(["a", "é", "long text", "", None]) if t else rng.choice(["hi", "hi", "yo"])))
    whole = [(t, "user", f"w{t % 7}") for t in range(70)]
    rows += [(c, *turn) for c in (200, 201, 202, 203, 204, 205, 206) for turn in whole]  # copies
    rows += [(c, *turn) for c in (210, 215) for turn in [*whole[:60], (60, "user", f"other {c}")]]  # part at turn 60
    rows += [(220, *turn) for turn in whole[:33]] + [(225, *turn) for turn in whole[:64]]  # prefixes of others
    rows += [(300, None, "user", "null turns first"), (300, 1, None, None), (301, 0, "user", "x" * 50_000), (None, 0, "user", "no id")]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = conversations()
    odd = {c: F.lit("x") for c in ("pos", "tid", "size", "part", "n", "h1", "block", "ids", "shard", "rep", "k1", "depth")}
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns(odd)


@pytest.mark.parametrize(("block", "shard_rows"), [(trie.BLOCK, trie.SHARD_ROWS), (4, 7), (1, 40)])
def test_trie(table, block, shard_rows):
    rows, df = table
    assert told(trie.conversation_trie(df, block, shard_rows)) == slow_nodes(slow_rebuild(rows))


def test_shards_that_cut_every_prefix(spark):
    """Conversations as they are: each begins with all of the one before, one row to a shard."""
    convs = {c: [("u", f"t{k}") for k in range(c)] for c in range(1, 30)} | {100 + c: [("u", "t0"), ("u", f"z{c % 3}")] for c in range(12)} | {500: []}
    ids = {t: k for k, t in enumerate(sorted({t for s in convs.values() for t in s}))}
    turns = spark.createDataFrame([(c, p, ids[t], len(t[1])) for c, s in convs.items() for p, t in enumerate(s)], "conv_id long, pos long, tid long, size long")
    every = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    for block, shard_rows in ((32, 1), (5, 2), (8, 1000)):
        assert told(trie.prefix_trie(turns, every, block, shard_rows)) == slow_nodes(convs)


def test_trees_are_balanced():
    """Rows that differ in the first id go in by medians: a search takes no more steps than halving does."""
    tree = trie.Tree()
    for k in trie.by_medians(1023):
        tree.insert([k], [1])
    depth, stack = 0, [(tree.eq[0], 1)]
    while stack:
        v, d = stack.pop()
        if v:
            depth = max(depth, d)
            stack += [(tree.lo[v], d + 1), (tree.hi[v], d + 1)]
    assert depth == 10 and sorted(trie.by_medians(1000)) == list(range(1000))


def test_hot_turns_and_one_conversation(spark):
    """A third of the rows in one conversation, one first turn and one text for many."""
    rows = [(0, t, "user", f"t{t}") for t in range(400)] + [(c, t, "user", "same" if t == 0 else f"{c % 4} {t}") for c in range(1, 200) for t in range(4)]
    assert told(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), 16, 50)) == slow_nodes(slow_rebuild(rows))


def test_nothing_and_nothing_but_turnless(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    rows = [(c, 0, "user", "gone")]
    assert told(trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))) == slow_nodes(slow_rebuild(rows))
