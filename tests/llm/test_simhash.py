"""SimHash groups against all pairs: fingerprints bit by bit, buckets of every size, odd rows."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import CLASHES, SCHEMA, corpus, sentence

from fleetlens.llm import simhash
from fleetlens.llm.minhash import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(fps):
    """fingerprint -> smallest fingerprint reachable, comparing all pairs."""
    fps = sorted(set(fps))
    label = {f: f for f in fps}
    links = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                moved = True
    return label


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(i, 64))


def test_groups_of_texts(spark):
    rng, rows = random.Random(3), corpus()
    base = sentence(rng, 400)
    rows += [(500 + k, base.replace(" ", "  ", 1) + f" end{k}", "en", "s", 1) for k in range(60)]
    rows += [(700 + k, None if k % 2 else " \n", "en", "s", 1) for k in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit("x") for c in CLASHES})
    got = simhash.near_fingerprints(df).collect()
    assert len(got) == len(rows)
    fps = {(i, slow_fingerprint(t)) for i, t, *_ in rows}
    assert {(r.doc_id, r.fingerprint) for r in got} == {(i, f"{f:016x}") for i, f in fps}
    label, first = slow_groups(f for _, f in fps), {}
    for i, f in fps:
        if i is not None:
            first[label[f]] = min(first.get(label[f], i), i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", first.get(label[f])) for i, f in fps}
    assert len(first) < len({f for _, f in fps})


@pytest.mark.parametrize("size", [3, simhash.SMALL, 500])
def test_buckets_of_every_size(spark, size):
    """Clusters whose members differ in a few bits, so that buckets hold up to `size` nodes, and single nodes."""
    rng = random.Random(size)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(3):
        center = rng.getrandbits(64)
        fps |= {center ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(4))) for _ in range(size)}
    nodes = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    links = simhash.bucket_links(nodes)
    assert links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 2).count() == 0
    comp = {r.doc_id: r.component for r in components(links)[0].collect()}
    label = slow_groups(fps)
    sets = {}
    for f in fps:
        sets.setdefault(comp.get(simhash.signed(f), simhash.signed(f)), set()).add(label[f])
    assert all(len(s) == 1 for s in sets.values()) and len(sets) == len(set(label.values()))


def test_points_stay_linear(spark):
    """All nodes in one bucket of each table: rows named follow the number of nodes."""
    masks, made = simhash.covering_masks(), []
    for n in (200, 400):
        rng = random.Random(1)
        fps = {sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(n)}
        shared = simhash.in_tables(spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long"), masks).withColumn("size", F.lit(n))
        made.append(simhash.by_points(shared, masks).count() / len(fps))
    assert made[1] < 3 * made[0]


def test_nothing(spark):
    assert simhash.near_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
