"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Windows of a document are as long as the benchmark items (in words). Their 64-bit SimHash over 5-word shingles,
weighted by letters, is cut into 8 blocks of 8 bits: fingerprints within radius 20 differ by 2 bits at most in some
block (pigeonhole), so looking up each block value and its 2-bit neighbours finds all of them. Candidates are
verified by the weighted Jaccard similarity of the shingle multisets, which must reach `percent`.

At similarity 0.8 two fingerprints differ by about 10 bits with a deviation of 3, so a single window lies beyond the
radius with probability of about 2e-4, far less for more similar ones; a test measures it. A window that shares no shingle with any item of its
length has similarity 0, so only windows around shared shingles get fingerprints; this leaves out no match. The index
is built from at most about `items_per_pass` items and `bytes_per_pass` bytes of them and sent to the tasks; larger
benchmarks take further passes over the documents.

Words are runs of letters and digits, lower-cased. Items without words match nothing; items under five words are one
shingle. Null and empty texts have no words; texts of any length are searched whole; repeated rows match alike (once
per doc_id and item); ties between windows go to the first; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import chunks, free_name, texts_of
from fleetlens.llm.shingles import WordHashes, mixed

WORD = re.compile(r"[^\W_]+")
SHINGLE, RADIUS, BLOCKS = 5, 20, 8
#: Windows that are fingerprinted at once; bounds memory, not results.
WINDOWS = 1000
_BITS = np.arange(64, dtype=np.uint64)


def _scrambled(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


class Text:
    """Shingle hashes and weights of a text, for each shingle length asked for."""

    def __init__(self, text: str, known: WordHashes) -> None:
        words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text.lower())]
        self.n, self.hashes, self.words = len(words), known.of(words), words
        self.letters: np.ndarray | None = None

    def shingles(self, k: int) -> np.ndarray:
        return mixed(self.hashes, k, k) if self.n >= k else np.zeros(0, np.uint64)

    def weights(self, k: int) -> np.ndarray:
        if self.letters is None:
            self.letters = np.r_[0, np.cumsum(np.fromiter(map(len, self.words), np.int64, self.n))]
        return self.letters[k:] - self.letters[:-k]


def fingerprints(h: np.ndarray, w: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SimHash of h[s : s + m] for each start s (ascending)."""
    out = np.zeros(len(starts), np.uint64)
    cuts = np.r_[0, np.flatnonzero(np.diff(starts) > 4 * m) + 1, len(starts)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        low, high = starts[a], starts[b - 1] + m
        bits = (_scrambled(h[low:high])[:, None] >> _BITS) & np.uint64(1)
        signed = np.where(bits == 1, w[low:high, None], -w[low:high, None])
        sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signed, axis=0)])
        at = starts[a:b] - low
        positive = (sums[np.minimum(at + m, len(sums) - 1)] - sums[at]) > 0
        out[a:b] = (positive.astype(np.uint64) << _BITS).sum(axis=1, dtype=np.uint64)
    return out


def multiset(h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(h, return_inverse=True)
    return keys, np.bincount(at, w, len(keys))


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


class Group:
    """Items of one length: fingerprints and their block tables, with neighbours of up to RADIUS // BLOCKS bits."""

    def __init__(self, k: int, m: int, members: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.k, self.m = k, m
        self.ids = [i for i, _, _ in members]
        self.sets = [multiset(h, w) for _, h, w in members]
        self.prints = np.array([fingerprints(h, w, np.zeros(1, np.int64), m)[0] for _, h, w in members], np.uint64)
        distance = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
        near = distance <= RADIUS // BLOCKS
        self.tables = []
        for b in range(BLOCKS):
            value = ((self.prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            probe, item = np.nonzero(near[:, value])
            self.tables.append((np.searchsorted(probe, np.arange(257)), item))

    def candidates(self, prints: np.ndarray) -> list[tuple[int, int]]:
        """(window, item) with Hamming distance up to RADIUS."""
        found = []
        for b, (start, item) in enumerate(self.tables):
            value = ((prints >> np.uint64(8 * b)) & np.uint64(255)).astype(np.int64)
            n = start[value + 1] - start[value]
            window = np.repeat(np.arange(len(prints)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(window * len(self.ids) + item[np.repeat(start[value], n) + offset])
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
        return list(zip(window[close].tolist(), item[close].tolist(), strict=True))


class Index:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        known, by_length = WordHashes(), defaultdict(list)
        for item, text in items:
            t = Text(text or "", known)
            if t.n:
                k = min(SHINGLE, t.n)
                by_length[k, t.n - k + 1].append((item, t.shingles(k), t.weights(k)))
        self.groups = [Group(k, m, members) for (k, m), members in sorted(by_length.items())]
        #: k -> sorted shingles of all items, and for each the groups that hold it
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in {g.k for g in self.groups}:
            pairs = [np.stack([np.unique(np.concatenate([s[0] for s in g.sets])), np.full(len(np.unique(np.concatenate([s[0] for s in g.sets]))), n, np.uint64)], axis=1) for n, g in enumerate(self.groups) if g.k == k]
            both = np.concatenate(pairs)
            both = both[np.argsort(both[:, 0], kind="stable")]
            keys, first = np.unique(both[:, 0], return_index=True)
            self.held[k] = keys, np.r_[first, len(both)], both[:, 1].astype(np.int64)
        self.maybe = {k: np.zeros(1 << 20, bool) for k in self.held}
        for k, (keys, _, _) in self.held.items():
            self.maybe[k][(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def matches(self, text: str, known: WordHashes, percent: int) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity): for each item the best verified window."""
        t, best = Text(text, known), {}
        for k, (keys, first, groups) in self.held.items():
            h = t.shingles(k)
            at = np.flatnonzero(self.maybe[k][(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            real = keys[slot] == h[at]
            at, slot = at[real], slot[real]
            if not len(at):
                continue
            w = t.weights(k)
            n = first[slot + 1] - first[slot]
            of = groups[np.repeat(first[slot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            where = np.repeat(at, n)
            for g in np.unique(of):
                group = self.groups[g]
                m = min(group.m, len(h))
                starts = np.unique((where[of == g][:, None] - np.arange(m)).ravel())
                starts = starts[(starts >= 0) & (starts <= len(h) - m)]
                for some in np.split(starts, range(WINDOWS, len(starts), WINDOWS)):
                    for window, item in group.candidates(fingerprints(h, w, some, m)):
                        s = int(some[window])
                        like = likeness(multiset(h[s : s + m], w[s : s + m]), group.sets[item])
                        key = group.ids[item]
                        if 100 * like >= percent - 1e-9 and (key not in best or like > best[key][3]):
                            best[key] = key, s, m + k - 1, like
        return sorted(best.values())


def matches(df: DataFrame, benchmark: DataFrame, percent: int = 80, items_per_pass: int = 20_000, bytes_per_pass: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity: the best window of each document for each item it holds."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null and item_id is not null").distinct()
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // items_per_pass), -(-size["bytes"] // bytes_per_pass))
    docs, out = texts_of(df, id_col, text_col), []
    for p in range(passes):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        index = df.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in rows]))

        def run(it: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            known = WordHashes()
            for batch in it:
                found = [(i, *m) for ids, texts in chunks(batch) for i, text in zip(ids, texts, strict=True) for m in index.value.matches(text, known, percent)]
                cols = zip(*found, strict=True) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        out.append(docs.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double"))
    got = reduce(DataFrame.unionByName, out).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"), "n_words")).alias("b"))
    return got.select("doc_id", "item_id", (-F.col("b.back")).alias("first_word"), F.col("b.n_words").alias("n_words"), F.col("b.similarity").alias("similarity"))


def decontaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of df whose documents hold no benchmark item; rows with a null id stay."""
    id_col = options.get("id_col", "doc_id")
    held = free_name(df, "held_id")
    bad = matches(df, benchmark, **options).select(F.col("doc_id").alias(held)).distinct()
    return df.join(bad, df[id_col] == bad[held], "left_anti")
