"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every text, on two questions: is it junk (symbols,
capitals, repetition, tables, shape, known labels), is it abusive (public insults, words and word beginnings that
labelled abusive texts use, known labels). Expectation maximisation over the vote patterns, of which there are at
most 3 to the number of labellers, estimates each labeller's accuracy from the agreement of all; only its start
counts bad votes more than good ones. The last labeller of junk says good where no other sees anything. The
posterior labels then train a hashed linear scorer on words, word beginnings and style, and the scorer decides.

Counts of votes and patterns cover all texts. Bounded samples, as parameters say: `lexicon_rows` labelled rows for
the learned word lists; for the scorer `fit_rows` texts in equal numbers of each kind (junk, abusive, both, neither)
and `fit_rows` more in proportion, weighted so that each kind keeps its share of all texts. Everything that reaches
the driver is bounded by these, by the number of patterns or by `dims`.

Words are runs of letters, lower-cased, known by 64-bit hashes that are taken over a whole slice of texts at once;
the hash of a word's beginning falls out of the same sums. A slice holds about CHUNK_BYTES of texts, or one longer
text (about 40 bytes of memory for each of its characters).

Null and empty texts have no words and are junk (score 0 of the first question). Texts of any length are read whole;
repeated rows are judged alike; null labels are no votes; several labels of one id count as the worst of them;
a null doc_id is judged like any other; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, slices, staged, texts_of

#: Lengths of word beginnings that are features besides the whole word.
PREFIXES = (3, 4, 5, 6, 7, 8)
BAD, NONE, GOOD = 0, 1, 2
# Fixed value: common English insults.
INSULTS = "idiot moron stupid loser scum trash pathetic worthless disgusting clown imbecile jerk fool dumb retard bastard bitch asshole"
LETTER, UPPER, SYMBOL, EXCLAIM, PIPE, STOP = 1, 2, 4, 8, 16, 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Steps of the style measures, as features.
STEPS = {"symbols": (0.005, 0.03), "upper": (0.15, 0.4), "exclaims": (0.02, 0.2), "pipes": (0.001, 0.03), "repeats": (0.02, 0.1), "distinct": (0.2, 0.3), "dup_lines": (0.2, 0.5), "stops": (0.01, 0.5), "words": (3, 10)}


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The classes of each code point, as bits. In blocks, as a list of all characters takes 100 MB of a worker."""
    out, block = np.zeros(0x110000, np.uint8), 1 << 12
    for start in range(0, len(out), block):
        chars = list(map(chr, range(start, start + block)))
        out[start : start + block] = np.array(list(map(str.isalpha, chars)), np.uint8) * LETTER | np.array(list(map(str.isupper, chars)), np.uint8) * UPPER
    for bit, some in ((SYMBOL, "#*$%&<>"), (EXCLAIM, "!"), (PIPE, "|"), (STOP, ".")):
        out[[ord(c) for c in some]] |= bit
    return out


@lru_cache(maxsize=4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE)], dtype=np.uint64)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = h ^ np.uint64(salt * 0xD6E8FEB86659FD93 % 2**64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each distinct value's first occurrence, and each value's number, in order of first occurrence."""
    codes = pa.array(x).dictionary_encode().indices.to_numpy()
    first = np.zeros(int(codes.max()) + 1 if len(codes) else 0, np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return first, codes


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a zero, and where each text starts."""
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)][: len(texts)]


@dataclass(frozen=True)
class Looks:
    """What a slice of texts looks like."""

    n: int
    style: dict[str, np.ndarray]  # measure -> value of each text
    doc: np.ndarray  # of each distinct (text, word)
    word: np.ndarray  # number of its word in the slice
    parts: np.ndarray  # [part, word]: hashes of the word and of its beginnings
    valid: np.ndarray  # [part, word]: whether the word has that beginning

    def sums(self, values: np.ndarray) -> np.ndarray:
        """[text, column]: sums of the words' values over the distinct words of each text."""
        return np.stack([np.bincount(self.doc, v, self.n) for v in values[self.word].T], axis=1) if values.shape[1] else np.zeros((self.n, 0))


def looks(texts: list[str]) -> Looks:
    n = len(texts)
    low, low_start = _codes([t.lower() for t in texts])
    at = np.flatnonzero((_classes()[low] & LETTER) != 0)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)  # of each word, among the letters
    length = np.diff(np.r_[first, len(at)])
    of = np.searchsorted(low_start, at[first], "right") - 1 if len(first) else np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(first, length)
    powers = _powers(1 << max(6, int(length.max(initial=1)).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum((low[at] + np.uint32(1)) * powers[place], dtype=np.uint64)]
    whole = _mixed(sums[first + length] - sums[first], 1)
    new, word = _distinct(whole)
    start, size = first[new], length[new]
    valid = np.stack([np.ones(len(new), bool), *(size > p for p in PREFIXES)])
    parts = np.stack([whole[new], *(_mixed(sums[np.minimum(start + p, len(sums) - 1)] - sums[start], p) for p in PREFIXES)])
    pairs = np.unique(of * max(1, len(new)) + word)

    raw, raw_start = _codes(texts)
    kinds = _classes()[raw]
    marked = np.flatnonzero(kinds > LETTER)
    kinds, mark_of = kinds[marked], np.searchsorted(raw_start, marked, "right") - 1
    count = lambda bit: np.bincount(mark_of[(kinds & bit) != 0], minlength=n)

    lines = pc.split_pattern(pa.array(texts, pa.large_string()), "\n")
    line, line_of = lines.flatten(), np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
    seen = pc.not_equal(pc.binary_length(pc.utf8_trim_whitespace(line)), 0).to_numpy(zero_copy_only=False)
    _, line_code = _distinct(line)
    line_of, line_code = line_of[seen], line_code[seen].astype(np.int64)
    n_lines = np.bincount(line_of, minlength=n)
    distinct_lines = np.bincount(np.unique(line_of * (len(line) + 1) + line_code) // (len(line) + 1), minlength=n)

    words = np.bincount(of, minlength=n)
    letters, some = np.maximum(1, np.bincount(of, length, n)), np.maximum(1, words)
    again = np.flatnonzero((word[1:] == word[:-1]) & (of[1:] == of[:-1]))
    doc, number = pairs // max(1, len(new)), pairs % max(1, len(new))
    measures = {
        "words": words.astype(float), "symbols": count(SYMBOL) / letters, "upper": count(UPPER) / letters, "exclaims": count(EXCLAIM) / some, "pipes": count(PIPE) / some,
        "repeats": np.bincount(of[again], minlength=n) / some, "distinct": np.bincount(doc, minlength=n) / some, "dup_lines": 1 - distinct_lines / np.maximum(1, n_lines), "stops": count(STOP) / some,
    }
    return Looks(n, measures, doc, number, parts, valid)


@dataclass(frozen=True)
class Lexicon:
    """Values of parts of words, by hash."""

    keys: np.ndarray  # sorted
    values: np.ndarray

    @staticmethod
    def of(known: dict[int, float]) -> Lexicon:
        keys = np.array(sorted(known), np.uint64)
        return Lexicon(keys, np.array([known[k] for k in keys.tolist()], float))

    def look_up(self, look: Looks) -> np.ndarray:
        """For each word of the slice: the largest value of its parts, 0 if none is known."""
        out = np.zeros(look.parts.shape[1])
        if len(self.keys):
            maybe = np.zeros(1 << 16, bool)
            maybe[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            for h, valid in zip(look.parts, look.valid, strict=True):
                some = np.flatnonzero(maybe[(h & np.uint64(0xFFFF)).astype(np.int64)] & valid)
                slot = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
                out[some] = np.maximum(out[some], np.where(self.keys[slot] == h[some], self.values[slot], 0.0))
        return out


@lru_cache(maxsize=1)
def _insults() -> Lexicon:
    return Lexicon.of(dict.fromkeys(looks([INSULTS]).parts[0].tolist(), 1.0))


def known_values(look: Looks, lexicons: tuple[Lexicon, ...]) -> np.ndarray:
    """[word, list]: whether it is an insult, and the values of the learned lists."""
    return np.stack([x.look_up(look) for x in (_insults(), *lexicons)], axis=1)


def hashed(names: list[str], dims: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(p) % dims for p in names], np.int64)


def junk_votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """[text, labeller]. Each kind of junk is another, so a labeller that doesn't see its own kind says nothing; the
    last one says good where none of them sees anything."""
    seen = np.stack([s["symbols"] >= 0.03, s["upper"] >= 0.4, s["exclaims"] >= 0.2, s["pipes"] >= 0.03, s["repeats"] >= 0.1, (s["words"] >= 30) & (s["distinct"] <= 0.1), s["dup_lines"] >= 0.5, s["words"] < 3], axis=1)
    return np.concatenate([np.where(seen, BAD, NONE), np.where(seen.any(axis=1), NONE, GOOD)[:, None]], axis=1)


def abuse_votes(sums: np.ndarray) -> np.ndarray:
    """[text, labeller]; sums: number of insults and values of the lexicons over each text's distinct words."""
    bad, good = np.array([1.0] + [5.0] * (sums.shape[1] - 1)), np.array([0.0] + [2.0] * (sums.shape[1] - 1))
    return np.where(sums >= bad, BAD, np.where(sums <= good, GOOD, NONE))


def _strings(votes: np.ndarray) -> pa.Array:
    """One string of digits for each row."""
    digits = np.ascontiguousarray(votes.astype(np.uint8) + ord("0"))
    return pa.array(digits.view(f"S{votes.shape[1]}").ravel().astype(str).tolist(), pa.string())


def bad_posterior(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], np.ndarray]:
    """P(bad) of each vote pattern, and the estimated P(vote | class) of each labeller [class, labeller, vote].
    Silence of a labeller is no evidence; without any vote the share of bad texts is the posterior."""
    if not patterns:
        return {}, np.zeros((2, 0, 3))
    votes = np.array([[int(c) for c in p] for p in patterns])
    n = np.array(list(patterns.values()), float)
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    post = (bad + 0.02) / (bad + 0.5 * good + 0.12)
    given = np.stack([votes == v for v in (BAD, NONE, GOOD)], axis=2).astype(float)
    spoken = given * (np.arange(3) != NONE)
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        was, logs = post, []
        for c, p in enumerate((post, 1 - post)):
            table[c] = np.einsum("p,pjv->jv", n * p, given) + 0.1
            table[c] /= table[c].sum(axis=1, keepdims=True)
            logs.append(np.log((n * p).sum() / n.sum() + 1e-9) + np.einsum("pjv,jv->p", spoken, np.log(table[c])))
        post = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
        if np.abs(post - was).max() < 1e-9:
            break
    return dict(zip(patterns, post.tolist(), strict=True)), table


def look_features(s: dict[str, np.ndarray], votes: np.ndarray, dims: int) -> np.ndarray:
    """[text, feature]: hashed style steps, and what the labellers other than the known labels say."""
    cols = []
    for name, steps in STEPS.items():
        cols.append(hashed([f"={name}:{k}" for k in range(len(steps) + 1)], dims)[sum((s[name] >= x).astype(np.int64) for x in steps)])
    for k in range(votes.shape[1]):
        cols.append(hashed([f"+{k}:{v}" for v in (BAD, NONE, GOOD)], dims)[votes[:, k]])
    return np.stack(cols, axis=1)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # [question, dims]
    bias: np.ndarray
    lexicons: tuple[Lexicon, ...]
    labellers: tuple[np.ndarray, np.ndarray]


def _votes(look: Looks, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return junk_votes(look.style), abuse_votes(look.sums(known))


def lexicon(docs: DataFrame, prefixes: bool, ratio: float = 20.0, least: int = 4) -> Lexicon:
    """Words (or word beginnings) of abusive texts with the log of their rate there against other texts.
    docs: doc_id, text, toxic."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch):
                look = looks(part.column(1).to_pylist())
                toxic = part.column(2).to_numpy(zero_copy_only=False)
                rows = look.parts[1:] if prefixes else look.parts[:1]
                valid = (look.valid[1:] if prefixes else look.valid[:1])[:, look.word]
                h, doc = rows[:, look.word][valid], np.broadcast_to(look.doc, valid.shape)[valid]
                first, code = _distinct(h)
                pairs = np.unique(doc * max(1, len(first)) + code)
                doc, code = pairs // max(1, len(first)), pairs % max(1, len(first))
                bad, every = np.bincount(code[toxic[doc] == 1], minlength=len(first)), np.bincount(code, minlength=len(first))
                yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(bad), pa.array(every - bad)], ["f", "bad", "good"])

    size = docs.agg(F.sum(F.col("toxic").cast("long")).alias("bad"), F.sum((1 - F.col("toxic")).cast("long")).alias("good")).first()
    n_bad, n_good = size["bad"] or 0, size["good"] or 0
    rate = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    sums = docs.select("doc_id", "text", "toxic").mapInArrow(run, "f long, bad long, good long").groupBy("f").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    kept = sums.filter(F.col("bad") >= least).withColumn("r", rate("bad", n_bad) / rate("good", n_good)).filter(F.col("r") >= ratio)
    return Lexicon.of({r["f"] % 2**64: float(np.log(r["r"])) for r in kept.collect()})  # of lexicon_rows texts


@dataclass(frozen=True)
class Sample:
    """Rows to fit on: hashed features of all rows in one array, the driver's largest. A row has two stretches of it,
    style and votes with value 1, words with a value of their own."""

    flat: np.ndarray
    length: np.ndarray  # of each stretch
    value: np.ndarray  # of each stretch

    def blocks(self, most: int = 500_000) -> Iterator[tuple[slice, slice]]:
        """Rows and their features in blocks of about `most` features, so what is computed of them stays small."""
        ends = np.cumsum(self.length)[1::2]
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most)))
            yield slice(start, stop), slice(before, int(ends[stop - 1]))
            start = stop


def _fit_linear(sample: Sample, target: np.ndarray, weight: np.ndarray, dims: int, rounds: int = 120, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps over the whole sample."""
    weight, blocks = weight / weight.sum(), list(sample.blocks())
    norms = (sample.length * sample.value**2).reshape(-1, 2).sum(axis=1)
    step = 4 / (1 + float(norms.max()))
    w, bias, ahead, bias_ahead = np.zeros(dims), 0.0, np.zeros(dims), 0.0
    for k in range(1, rounds + 1):
        gradient, slope = l2 * ahead, 0.0
        for rows, part in blocks:
            x, n = sample.flat[part].astype(np.int64), sample.length[2 * rows.start : 2 * rows.stop]
            value, some = sample.value[2 * rows.start : 2 * rows.stop], n > 0
            sums = np.zeros(len(n))
            sums[some] = np.add.reduceat(np.take(ahead, x, mode="clip"), (np.cumsum(n) - n)[some])
            dots = (sums * value).reshape(-1, 2).sum(axis=1) + bias_ahead
            r = weight[rows] * (1 / (1 + np.exp(-np.clip(dots, -30, 30))) - target[rows])
            gradient += np.bincount(x, np.repeat(np.repeat(r, 2) * value, n), dims)
            slope += float(r.sum())
        was, bias_was = w, bias
        w, bias = ahead - step * gradient, bias_ahead - step * slope
        ahead, bias_ahead = w + (k - 1) / (k + 2) * (w - was), bias + (k - 1) / (k + 2) * (bias - bias_was)
    return w, float(bias)


def fit(df: DataFrame, labels: DataFrame, lexicon_rows: int = 4000, fit_rows: int = 4500, fit_bytes: int = 96_000_000, dims: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Labellers, their accuracies and the scorer. labels: doc_id, quality, toxic (0, 1 or null).

    The scorer is fitted on about twice fit_rows texts and at most fit_bytes of their features; a text that would take
    more than an eighth of these is scored, but not fitted on. Equal rows count once there."""
    spark, docs = df.sparkSession, texts_of(df, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    marks = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    n_marks = marks.filter("toxic is not null").count()
    draw = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) / 1e6
    some = marks.filter("toxic is not null").filter(draw < lexicon_rows / max(1, n_marks))
    taken, taken_path = staged(docs.join(F.broadcast(some.select("doc_id", "toxic")), "doc_id").dropDuplicates(["doc_id", "text_hash"]).drop("text_hash"), "labelled")  # about lexicon_rows ids
    lexicons = (lexicon(taken, prefixes=False), lexicon(taken, prefixes=True))
    dropped(spark, taken_path)

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch):
                look = looks(part.column(1).to_pylist())
                junk, abuse = _votes(look, known_values(look, lexicons))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), _strings(junk), _strings(abuse)], ["doc_id", "text_hash", "junk", "abuse"])

    # the known labels vote last; only votes are shuffled to meet them, no texts
    heard = docs.mapInArrow(vote, "doc_id long, text_hash long, junk string, abuse string").join(marks, "doc_id", "left")
    says = lambda c, bad: F.when(F.col(c).isNull(), str(NONE)).when(F.col(c) == bad, str(BAD)).otherwise(str(GOOD))
    votes, votes_path = staged(heard.select("doc_id", "text_hash", F.concat("junk", says("quality", 0)).alias("junk"), F.concat("abuse", says("toxic", 1)).alias("abuse")), "votes")
    patterns = votes.groupBy("junk", "abuse").agg(F.count("*").alias("n")).collect()  # at most 3 ** 14 rows
    sums = [Counter(), Counter()]
    for r in patterns:
        sums[0][r["junk"]] += r["n"]
        sums[1][r["abuse"]] += r["n"]
    (junk, junk_table), (abuse, abuse_table) = (bad_posterior(dict(c)) for c in sums)
    kind = {(r["junk"], r["abuse"]): 2 * (abuse[r["abuse"]] > 0.5) + (junk[r["junk"]] > 0.5) for r in patterns}
    size = Counter()
    for r in patterns:
        size[kind[r["junk"], r["abuse"]]] += r["n"]
    share = {k: min(1.0, fit_rows / len(size) / n + fit_rows / size.total()) for k, n in size.items()}
    schema = "junk string, abuse string, p_junk double, p_abuse double, kind int, share double"
    judged = spark.createDataFrame([(r["junk"], r["abuse"], junk[r["junk"]], abuse[r["abuse"]], int(k), share[k]) for r in patterns for k in [kind[r["junk"], r["abuse"]]]], schema)
    chosen = votes.join(F.broadcast(judged), ["junk", "abuse"]).filter(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) / 1e6 < F.col("share"))

    def features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in slices(batch):
                look = looks(part.column(1).to_pylist())
                more = look_features(look.style, np.hstack(_votes(look, known_values(look, lexicons))), dims)
                parts, cuts = (look.parts % np.uint64(dims)).astype(np.int32), np.searchsorted(look.doc, np.arange(look.n + 1))
                words = [look.word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                x = [np.r_[more[k].astype(np.int32), parts[:, w].T[look.valid[:, w].T]].tobytes() for k, w in enumerate(words)]  # word by word, so they compress
                cols = [pa.array(x, pa.binary()), pa.array([more.shape[1]] * look.n, pa.int32()), pa.array(list(map(len, words)), pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *(part.column(k) for k in (2, 3, 4))], ["x", "n_more", "n_words", "p_junk", "p_abuse", "kind"])

    spot = ["doc_id", "text_hash"]
    picked = F.broadcast(chosen.select(*spot, "p_junk", "p_abuse", "kind").dropDuplicates(spot))  # about twice fit_rows texts
    texts = docs.join(picked, spot).dropDuplicates(spot).select("doc_id", "text", "p_junk", "p_abuse", "kind")
    drawn_rows, drawn_path = staged(texts.mapInArrow(features, "x binary, n_more int, n_words int, p_junk double, p_abuse double, kind int"), "fit_rows")
    sizes = drawn_rows.select(F.xxhash64("x").alias("h"), F.octet_length("x").cast("long").alias("size")).filter(F.col("size") <= fit_bytes // 8)
    within = sizes.withColumn("so_far", F.sum("size").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("so_far") <= fit_bytes)  # over the sample
    last = within.agg(F.max("h")).first()[0]
    drawn_rows = drawn_rows.filter((F.octet_length("x") <= fit_bytes // 8) & (F.xxhash64("x") <= F.lit(last).cast("long")))
    size_of = drawn_rows.agg(F.coalesce(F.sum(F.octet_length("x").cast("long")), F.lit(0)).alias("bytes")).first()
    flat, at, facts = np.zeros(size_of["bytes"] // 4, np.int32), 0, []
    for r in drawn_rows.toLocalIterator():  # a partition at a time passes through the JVM
        x = np.frombuffer(r["x"], np.int32)
        flat[at : at + len(x)] = x
        at += len(x)
        facts.append((r["n_more"], len(x) - r["n_more"], 1.0, max(1, r["n_words"]) ** -0.5, r["p_junk"], r["p_abuse"], r["kind"]))
    dropped(spark, votes_path, drawn_path)
    if not facts:
        return Model(np.zeros((2, dims)), np.full(2, -1.0), lexicons, (junk_table, abuse_table))
    table = np.array(facts)
    # words share one unit of length, whatever the text's; style and votes have one each
    sample, kinds = Sample(flat, table[:, :2].astype(np.int64).ravel(), table[:, 2:4].ravel()), table[:, 6].astype(int)
    drawn = Counter(kinds.tolist())
    weight = np.array([size[k] / drawn[k] for k in kinds.tolist()])
    fitted = [_fit_linear(sample, table[:, c], weight, dims) for c in (4, 5)]
    return Model(np.stack([w for w, _ in fitted]), np.array([b for _, b in fitted]), lexicons, (junk_table, abuse_table))


def _scorer(df: DataFrame, model: Model, put):
    """The function for mapInArrow; put(slice, quality, abuse) makes the batch to yield."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by dims

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        dims = m.weights.shape[1]
        for batch in it:
            for part in slices(batch):
                look = looks(pc.fill_null(part.column(1), "").to_pylist())
                known = known_values(look, m.lexicons)
                at = (look.parts % np.uint64(dims)).astype(np.int64)
                weighed = np.stack([(w[at] * look.valid).sum(axis=0) for w in m.weights], axis=1)
                more = look_features(look.style, np.hstack(_votes(look, known)), dims)
                size = np.maximum(1, np.bincount(look.doc, minlength=look.n))
                sums = look.sums(weighed) / np.sqrt(size)[:, None] + m.weights[:, more].sum(axis=2).T + m.bias
                p = 1 / (1 + np.exp(-np.clip(sums, -50, 50)))
                empty = look.style["words"] == 0
                yield put(part, np.where(empty, 0.0, 1 - p[:, 0]), np.where(empty, 0.0, p[:, 1]))

    return run


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality (probability of being no junk), abuse (probability), kept."""

    def put(part: pa.RecordBatch, quality: np.ndarray, abuse: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(quality), pa.array(abuse), pa.array((quality >= 0.5) & (abuse < 0.5))], ["doc_id", "quality", "abuse", "kept"])

    return texts_of(df, id_col, text_col).mapInArrow(_scorer(df, model, put), "doc_id long, quality double, abuse double, kept boolean")


def kept_rows(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, that `score` keeps, in one pass without a join; each text goes to Python once."""
    names = df.columns
    sent = [id_col, text_col, *(c for c in names if c not in (id_col, text_col))]

    def put(part: pa.RecordBatch, quality: np.ndarray, abuse: np.ndarray) -> pa.RecordBatch:
        rows = pa.RecordBatch.from_arrays([part.column(sent.index(c)) for c in names], names)
        return rows.filter(pa.array((quality >= 0.5) & (abuse < 0.5)))

    return df.select(*sent).mapInArrow(_scorer(df, model, put), df.schema)
