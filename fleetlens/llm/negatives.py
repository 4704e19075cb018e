"""Hard negatives for embedding training, by threshold joins in the manner of L2AP.

Anchors are joined with all rows in cells: (group of rows) x (group of anchors), each group of a bounded number of
vectors, dealt by hash. So neither side is broadcast and no task holds a label or a hot vector whole. In a cell:

1. Dimensions go from those with the least to those with the most energy. For the lowest threshold asked for, a row's
   first dimensions are left out of the inverted index as long as the norm of what is left out, times the largest such
   norm of an anchor, stays below the threshold: a row that meets no anchor in the index can't reach it.
2. Anchors run through the index from the last block of dimensions to the first and accumulate partial scores. After
   each block, pairs whose partial score plus the product of both remaining norms stays below the anchor's threshold
   go. Dimensions that the index omits are only multiplied for the pairs that are left.
3. Windows (at most so high, at least so low, so many rows) that aren't full lower their thresholds and go again, down
   to the window's lower end.

Each cell gives at most the window's size of rows for each window; a window over those of all cells gives the answer.
First the positives (rows of the anchor's label, no lower end), then the negatives in the windows that these define.

Scores are exact integers: components become floor(256 x) and are multiplied as doubles where all sums stay below 2^53,
else as Python integers; a score outside of 64 bits is an error. Rows with a null id, label or vector, or a null or
non-finite component, take no part. Vectors of unlike length count as filled up with zeros. Rows that are wholly equal
count once; other rows with an anchor's id count as the anchor itself: they are neither its positives nor its negatives.
Ties go to the smaller id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import new_path, scratch, staged, written

SCALE, LABELS, SHIFTED, EVERY = 256, 10, 7, 100
#: Rows and anchors of a cell; anchors that are scored at once, dimensions between two prunings.
ROWS, ANCHORS, STEP, DIMS = 8192, 8192, 128, 8
#: How far down its span a window's threshold goes, turn by turn.
TURNS = (0.125, 0.25, 0.5, 1.0)
#: Part of the pairs from which on they are kept one by one.
SPARSE = 0.2
EXACT = 2.0**53
FOUND = "anchor_id long, window int, negative_id long, score long"


def prepared(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label, v (array of whole doubles): the rows that take part, labels shifted where the id is divisible by 7."""
    i, label, v = F.col(id_col).cast("long"), F.col(label_col).cast("long"), F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    shifted = F.when(i % SHIFTED == 0, (label + 1) % LABELS).otherwise(label)
    rows = df.filter(i.isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))
    scaled = lambda x: x * float(SCALE)
    whole = F.transform(v, lambda x: F.when(F.abs(scaled(x)) < EXACT, F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))  # larger doubles are whole
    return rows.select(i.alias("vec_id"), shifted.alias("label"), whole.alias("v")).distinct()


def dealt(df: DataFrame, groups: int, others: int, own: str, other: str) -> DataFrame:
    """df in `groups` groups by hash, each once for every group of the other side: columns own and other name the cell."""
    return df.withColumn(own, F.pmod(F.xxhash64("vec_id", F.lit(own)), F.lit(groups)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Index:
    """Inverted index of rows by block of dimensions, without what the suffix bound covers."""

    def __init__(self, rows: np.ndarray, anchors: np.ndarray, least: float) -> None:
        self.order = np.argsort((rows * rows).sum(axis=0), kind="stable")
        self.rows, width = rows[:, self.order], rows.shape[1]
        self.cuts = [*range(0, width, DIMS), width]
        self.norms = np.stack([np.sqrt((self.rows[:, :c] ** 2).sum(axis=1)) for c in self.cuts])
        most = np.array([np.sqrt((anchors[:, self.order[:c]] ** 2).sum(axis=1)).max(initial=0) for c in self.cuts])
        covered = self.norms * most[:, None] * (1 + 1e-9) < least
        #: For each row, the number of blocks that are left out.
        self.omitted = np.maximum(covered.cumprod(axis=0).sum(axis=0) - 1, 0) if least > 0 else np.zeros(len(rows), np.int64)
        self.lists = [np.flatnonzero(self.omitted <= k) for k in range(len(self.cuts) - 1)]

    def join(self, anchors: np.ndarray, least: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, row, score) of the allowed pairs that reach the anchor's threshold."""
        a = anchors[:, self.order]
        norms = np.stack([np.sqrt((a[:, :c] ** 2).sum(axis=1)) for c in self.cuts])
        score, x, y = np.zeros(allowed.shape), None, None
        alive = allowed & (self.omitted < len(self.cuts) - 1)[None, :] if self.lists else allowed
        for k in range(len(self.lists) - 1, -1, -1):
            dims, held = slice(self.cuts[k], self.cuts[k + 1]), self.lists[k]
            if x is None:
                if len(held) == len(self.rows):
                    score += a[:, dims] @ self.rows[:, dims].T
                else:
                    score[:, held] += a[:, dims] @ self.rows[held, dims].T
                reach = score + norms[k][:, None] * self.norms[k][None, :] * (1 + 1e-9) + 0.5 >= least[:, None]
                alive &= reach | (self.omitted > k)[None, :]  # these have had their last block
                if np.count_nonzero(alive) < SPARSE * alive.size:
                    x, y = np.nonzero(alive)
                    part = score[x, y]
            else:
                there = self.omitted[y] <= k
                part[there] += (a[x[there], dims] * self.rows[y[there], dims]).sum(axis=1)
                keep = ~there | (part + norms[k][x] * self.norms[k][y] * (1 + 1e-9) + 0.5 >= least[x])
                x, y, part = x[keep], y[keep], part[keep]
        if x is None:
            x, y = np.nonzero(alive)
            part = score[x, y]
        for k in range(len(self.cuts) - 1):  # what the index omits, for the pairs that are left
            if len(more := np.flatnonzero(self.omitted[y] > k)):
                dims = slice(self.cuts[k], self.cuts[k + 1])
                part[more] += (a[x[more], dims] * self.rows[y[more], dims]).sum(axis=1)
        keep = part >= least[x]
        return x[keep], y[keep], part[keep]


def big_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores beyond what doubles hold, as Python integers."""
    whole = lambda m: np.array([[int(v) for v in r] for r in m.tolist()], object).reshape(m.shape)
    got = whole(anchors) @ whole(rows).T
    if got.size and max(abs(got.max()), abs(got.min())) >= 2**63:
        raise ValueError("a score doesn't fit into 64 bits")
    return got


def cell(anchors: dict, rows: dict, same: bool, take: int) -> Iterator[tuple]:
    """(anchor_id, window, row id, score): the first `take` rows of this cell in each window of each anchor."""
    ids, a_all, y = rows["id"], anchors["v"], rows["v"]
    for at in range(0, len(a_all), STEP):
        part = slice(at, at + STEP)
        a, a_id, a_label, hi, lo = a_all[part], anchors["id"][part], anchors["label"][part], anchors["hi"][part], anchors["lo"][part]
        allowed = (a_label[:, None] == rows["label"][None, :]) == same
        allowed &= a_id[:, None] != ids[None, :]
        norm_a, norm_y = np.sqrt((a**2).sum(axis=1)), np.sqrt((y**2).sum(axis=1)).max(initial=0)
        if norm_a.max(initial=0) * norm_y >= EXACT:
            full = big_scores(a, y)
            yield from picked_exactly(full, allowed, a_id, ids, hi, lo, take)
            continue
        top = norm_a * norm_y + 1
        low = [np.maximum(np.array([float(x) for x in w]), -t) for w, t in zip(lo, top, strict=True)]
        high = [np.minimum(np.array([float(x) for x in w]), t) for w, t in zip(hi, top, strict=True)]
        open_ = [np.ones(len(w), bool) & (h >= l) for w, h, l in zip(lo, high, low, strict=True)]
        for share in TURNS:
            busy = np.array([k for k, o in enumerate(open_) if o.any()], np.int64)
            if not len(busy):
                break
            least = np.array([min(h - (h - l) * share for h, l, o in zip(high[k], low[k], open_[k], strict=True) if o) for k in busy])
            least = np.ceil(least)
            x, r, s = Index(y, a[busy], float(least.min())).join(a[busy], least, allowed[busy])
            by = np.lexsort((ids[r], -s, x))
            x, r, s = x[by], r[by], s[by]
            starts = np.searchsorted(x, np.arange(len(busy) + 1))
            for j, k in enumerate(busy.tolist()):
                mine, found = s[starts[j] : starts[j + 1]], ids[r[starts[j] : starts[j + 1]]]
                for w in np.flatnonzero(open_[k]).tolist():
                    first, end = np.searchsorted(-mine, -high[k][w], "left"), np.searchsorted(-mine, -low[k][w], "right")
                    if end - first >= take or share == 1.0:
                        open_[k][w] = False
                        stop = min(end, first + take)
                        yield from ((int(a_id[k]), w, int(i), int(v)) for i, v in zip(found[first:stop], mine[first:stop], strict=True))


def picked_exactly(full: np.ndarray, allowed: np.ndarray, a_id: np.ndarray, ids: np.ndarray, hi: list, lo: list, take: int) -> Iterator[tuple]:
    """The same from exact scores."""
    for k in range(len(full)):
        for w, (h, l) in enumerate(zip(hi[k], lo[k], strict=True)):
            fit = sorted((-s, i) for s, i, ok in zip(full[k].tolist(), ids.tolist(), allowed[k].tolist(), strict=True) if ok and l <= s <= h)
            yield from ((int(a_id[k]), w, i, -s) for s, i in fit[:take])


def searched(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, same: bool, take: int, width: int) -> DataFrame:
    """FOUND: the first `take` rows of each window of each anchor, over all cells. anchors: vec_id, label, v, hi, lo
    (arrays of whole numbers, one entry for each window)."""
    a_groups, r_groups = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            a = {"id": left["vec_id"].to_numpy(), "label": left["label"].to_numpy(), "v": matrix(left["v"], width), "hi": left["hi"].to_pylist(), "lo": left["lo"].to_pylist()}
            y = {"id": right["vec_id"].to_numpy(), "label": right["label"].to_numpy(), "v": matrix(right["v"], width)}
            out = list(cell(a, y, same, take))
        kinds = [("anchor_id", pa.int64()), ("window", pa.int32()), ("negative_id", pa.int64()), ("score", pa.int64())]
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    left = dealt(anchors, a_groups, r_groups, "a_group", "r_group").groupBy("a_group", "r_group")
    right = dealt(rows, r_groups, a_groups, "r_group", "a_group").groupBy("a_group", "r_group")
    found = left.cogroup(right).applyInArrow(run, FOUND)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "negative_id"))).filter(F.col("rank") <= take)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, take: int = 10, low: int = 30, high: int = 90, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (id divisible by
    `every`) and each of its first `positives` rows of the same label, the first `take` rows of another label whose
    score is between low and high percent of the positive's."""
    path = new_path(df.sparkSession, "negatives")
    with scratch(df.sparkSession):
        rows, _ = staged(prepared(df, id_col, vector_col, label_col), "vectors")
        facts = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0), F.max(F.size("v"))).first()
        n_rows, n_anchors, width = facts[0], facts[1], max(facts[2] or 0, 1)
        number = "array<bigint>"
        anchors, _ = staged(rows.filter(F.col("vec_id") % every == 0), "anchors")
        bound: Column = F.lit(2**63 - 1).cast("bigint")
        whole = anchors.withColumns({"hi": F.array(bound).cast(number), "lo": F.array(-bound).cast(number)})
        near, _ = staged(searched(whole, rows, n_anchors, n_rows, True, positives, width).select("anchor_id", F.col("rank").alias("place"), F.col("negative_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        of_anchor = near.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p")).withColumnRenamed("anchor_id", "vec_id")
        p = F.col("p.positive_score")
        hi = F.transform(p, lambda s: F.floor(s * F.lit(high).cast("decimal(3,0)") / 100).cast("bigint"))
        lo = F.transform(p, lambda s: F.ceil(s * F.lit(low).cast("decimal(3,0)") / 100).cast("bigint"))
        spans = anchors.join(of_anchor, "vec_id").withColumns({"hi": hi, "lo": lo}).drop("p")
        found = searched(spans, rows, n_anchors, n_rows, False, take, width)
        named = found.join(near.withColumn("window", F.col("place") - 1), ["anchor_id", "window"])
        return written(named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score")), path)
