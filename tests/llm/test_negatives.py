"""Hard negatives against a full comparison, and what the index leaves out."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def slow(rows, every=100):
    rows = {(i, l, tuple(v)) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    rows = [(i, (l + 1) % 10 if i % 7 == 0 else l, [math.floor(256 * x) for x in v]) for i, l, v in rows]
    out = []
    for i, label, v in rows:
        if i % every == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j, m) for j, m, w in rows if j != i)
            for p, j in [(s, j) for s, j, m in others if m == label][:5]:
                fit = [(k, -s) for s, k, m in others if m != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
                out += [(i, j, r + 1, k, -p, s) for r, (k, s) in enumerate(fit)]
    return sorted(out)


def vectors(n, width=20, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(labels, width))
    rows = []
    for i in range(n):
        label = int(rng.integers(labels))
        rows.append((i, [float(x) for x in (centers[label] * rng.choice([0.2, 1.0]) + rng.normal(size=width)).astype(np.float32)], label))
    return rows


def got(df, **options):
    return sorted(map(tuple, negatives.hard_negatives(df, **options).collect()))


def test_against_all_pairs(spark):
    rows = vectors(900) + [(1000 + k, [0.5] * 20, 2) for k in range(80)] + [(1100, [0.5] * 20, 3)]  # one hot vector: ties
    rows += [(1200, None, 1), (1201, [0.1] * 20, None), (1202, [None] + [0.1] * 19, 1), (1203, [float("nan")] + [0.1] * 19, 1), (1204, [float("inf")] + [0.1] * 19, 1), (None, [0.1] * 20, 1)]
    rows += [(1300, [], 1), (1301, [9.0, 1.0], 2), (1302, [0.1] * 30, 1), rows[0], rows[0], (1400, [0.0] * 20, 1)]
    odd = {c: F.lit("x") for c in ("score", "rank", "v", "window", "hi", "place", "a_group")}
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns(odd)
    want = slow(rows)
    assert want and got(df) == want


@pytest.mark.parametrize("groups", [(64, 3), (1000, 1)])
def test_cells(spark, monkeypatch, groups):
    """Many cells give what one gives."""
    monkeypatch.setattr(negatives, "ROWS", groups[0])
    monkeypatch.setattr(negatives, "ANCHORS", groups[1])
    rows = vectors(400, seed=2)
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow(rows)


def test_index_leaves_out_and_prunes_without_loss():
    rng = np.random.default_rng(5)
    rows = np.floor(rng.normal(size=(500, 32)) * np.linspace(1, 60, 32))
    anchors = rows[:20]
    full = anchors @ rows.T
    allowed = np.ones(full.shape, bool)
    for least in (1e9, 60_000.0, 20_000.0, 1.0, -1e9):
        index = negatives.Index(rows, anchors, least)
        x, y, s = index.join(anchors, np.full(20, least), allowed)
        want = {(a, b) for a, b in zip(*np.nonzero(full >= least), strict=True)}
        assert set(zip(x.tolist(), y.tolist(), strict=True)) == want and all(full[a, b] == v for a, b, v in zip(x, y, s, strict=True))
        if least == 60_000.0:
            assert index.omitted.max() > 0 and sum(map(len, index.lists)) < 4 * 500


def test_large_components(spark):
    """Beyond what doubles hold exactly; beyond 64 bits is an error."""
    rng = random.Random(8)
    rows = [(i, [float(rng.randrange(-(10**6), 10**6)) for _ in range(6)], i % 2) for i in range(150)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == slow([(i, [float(np.float32(x)) for x in v], l) for i, v, l in rows])
    with pytest.raises(Exception, match="64 bits"):
        got(spark.createDataFrame([(0, [1e20], 1), (1, [1e20], 1)], SCHEMA))
    with pytest.raises(Exception, match="64 bits"):
        got(spark.createDataFrame([(0, [1e20], 1), (1, [0.004], 1)], SCHEMA))


def test_nothing(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == []
    assert got(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)) == []
