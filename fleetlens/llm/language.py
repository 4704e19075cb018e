"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's likelihood is the sum over all
its segmentations into pieces (forward algorithm); a text's is the product over its words. Training is expectation
maximisation over the words of a sample: tasks add expected piece counts (forward-backward), Spark sums them by
language and piece, and what reaches the driver is bounded by vocabulary times languages, whatever the input.

Words are runs of letters of any length, lower-cased; a letter that the vocabulary doesn't know is spelled with its 256
byte pieces, which have probabilities by language like all others. Long words don't underflow: sums are scaled as they
go, and the scales are kept as logarithms.

Training uses at most about `per_language` texts of each language, chosen by a hash of id and text. Every labelled
language is learned, however many: languages are learned and scored in blocks, so memory is vocabulary times the
languages of a block. A letter is what Unicode calls one (general categories L*): number signs, digits and marks are
none. A text that is null or has no letter gets `und` with score 0, as does every text if nothing was learned. Ties go to the smaller language name. Texts of any length are read whole; repeated rows get equal results;
other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import chunks, slices, staged, texts_of
from fleetlens.storage import dropped

#: Runs of letters: code points that str.isalpha takes. Number signs such as ½ or Ⅻ are word characters, but no letters.
#: Those beyond the basic plane make a character class slow, so they have a pattern of their own.
NUMBERS = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
LETTERS = re.compile(rf"[^\W\d_{''.join(c for c in NUMBERS if c <= '\uffff')}]+")
HIGH_NUMBERS = re.compile(rf"[{''.join(c for c in NUMBERS if c > '\uffff')}]+")


def letter_runs(text: str) -> list[str]:
    """The runs of letters of a text."""
    words = LETTERS.findall(text)
    return words if all(map(str.isalpha, words)) else [w for x in words for w in HIGH_NUMBERS.split(x) if w]


#: Numbers (word, language) whose likelihoods a worker keeps; beyond it the memory is emptied. Results don't depend on it.
KEPT = 1_200_000
#: Numbers that one forward pass holds at once; bounds memory, not results.
CELLS = 1_000_000
#: Positions between two scalings.
STRIDE = 8
#: Stands for byte 0 inside a spelled word (a private character plane, which holds no letters).
BYTE = 0x10FF00


class Vocabulary:
    """Lower-cased pieces and the 256 byte pieces, numbered. `table` also holds each piece's beginnings, as -1."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = list(dict.fromkeys([*pieces, *(chr(BYTE + b) for b in range(256))]))
        self.table = {p[:n]: -1 for p in self.pieces for n in range(1, len(p))}
        self.table.update((p, k) for k, p in enumerate(self.pieces))
        self.longest = max(map(len, self.pieces))
        self.letters = {p for p in self.pieces if len(p) == 1}

    def __len__(self) -> int:
        return len(self.pieces)

    def spelled(self, word: str) -> str:
        """A word with its start mark, letters outside the vocabulary as bytes."""
        word = "\u2581" + word
        if self.letters.issuperset(word):
            return word
        return "".join(c if c in self.letters else "".join(chr(BYTE + b) for b in c.encode("utf-8", "surrogatepass")) for c in word)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The pieces of a vocabulary file; its control, byte and unknown pieces are left to `Vocabulary`."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Vocabulary([sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))])


def edges(spelled: list[str], vocab: Vocabulary) -> np.ndarray:
    """Rows (word, start, end, piece): every piece at every place."""
    out, table = [], vocab.table
    for k, w in enumerate(spelled):
        n = len(w)
        for i in range(n):
            for j in range(i + 1, n + 1):
                p = table.get(w[i:j])
                if p is None:
                    break
                if p >= 0:
                    out += (k, i, j, p)
    return np.array(out, np.int64).reshape(-1, 4)


@dataclass(frozen=True)
class Sums:
    """Scaled sums over all segmentations up to (or from) each position, and the logarithms of their scales."""

    value: np.ndarray  # [language, word, position]
    scale: np.ndarray  # [scaling, language, word], cumulative
    at: np.ndarray  # the scaling that a position's value has

    def log(self, lang: int | slice, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        return np.log(self.value[lang, word, position]) + (self.scale[self.at[position], lang, word] if isinstance(lang, int) else self.scale[self.at[position], :, word].T)


def forward(e: np.ndarray, lengths: np.ndarray, prob: np.ndarray, longest: int, backward: bool = False) -> Sums:
    """Sums up to each position; backward: from each position to the word's end. lengths: of the spelled words.

    Backward passes run from each word's end, so position t of the result is t letters before it."""
    langs, n_words, size = prob.shape[0], len(lengths), int(lengths.max(initial=0)) + 1
    value, scale = np.zeros((langs, n_words, size)), np.zeros((size // STRIDE + 2, langs, n_words))
    value[:, :, 0] = 1
    word, source, target, piece = e.T
    if backward:
        source, target = lengths[word] - target, lengths[word] - source
    order = np.argsort(target, kind="stable")
    word, source, target, p = word[order], source[order], target[order], prob[:, piece[order]]
    cuts, seen = np.searchsorted(target, np.arange(size + 1)), 0
    for t in range(1, size):
        a, b = cuts[t], cuts[t + 1]
        for g in range(langs):
            value[g, :, t] = np.bincount(word[a:b], value[g, word[a:b], source[a:b]] * p[g, a:b], n_words)
        if t % STRIDE == 0:
            window = value[:, :, max(0, t - longest + 1) : t + 1]
            most = window.max(axis=2)
            most[:, lengths < t] = 1  # those words have ended
            window /= most[:, :, None]
            seen += 1
            scale[seen] = scale[seen - 1] + np.log(most)
    at = np.minimum((np.arange(size) + longest - 1) // STRIDE, seen)  # the last scaling whose window held a position
    return Sums(value, scale, at)


def _ends(s: Sums, lengths: np.ndarray) -> np.ndarray:
    """[language, word]: logarithm of the sum over all segmentations."""
    return s.log(slice(None), np.arange(len(lengths)), lengths)


def blocks(lengths: np.ndarray, langs: int) -> Iterator[np.ndarray]:
    """Word numbers, shortest first, in blocks whose sums take about CELLS numbers."""
    order, start = np.argsort(lengths, kind="stable"), 0
    while start < len(order):
        some = lengths[order[start : start + max(1, CELLS // (langs * (int(lengths[order[start]]) + 1)))]]
        stop = start + max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * (some + 1) * langs, CELLS, "right")))
        yield order[start:stop]
        start = stop


def log_likelihoods(words: list[str], vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """[word, language]: log of the sum over all segmentations."""
    spelled = [vocab.spelled(w) for w in words]
    lengths, out = np.array(list(map(len, spelled)), np.int64), np.zeros((len(words), len(prob)))
    for some in blocks(lengths, len(prob)):
        s = forward(edges([spelled[i] for i in some], vocab), lengths[some], prob, vocab.longest)
        out[some] = _ends(s, lengths[some]).T
    return out


def expected_counts(words: list[str], n: np.ndarray, vocab: Vocabulary, prob: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words that occur n times each; prob: of one language."""
    spelled, total = [vocab.spelled(w) for w in words], np.zeros(len(vocab))
    lengths = np.array(list(map(len, spelled)), np.int64)
    for some in blocks(lengths, 2):
        size, e = lengths[some], edges([spelled[i] for i in some], vocab)
        a, b = forward(e, size, prob[None], vocab.longest), forward(e, size, prob[None], vocab.longest, backward=True)
        w, s, t, piece = e.T
        weight = np.exp(a.log(0, w, s) + np.log(prob[piece]) + b.log(0, w, size[w] - t) - _ends(a, size)[0][w])
        total += np.bincount(piece, n[some][w] * weight, len(total))
    return total


@dataclass(frozen=True)
class Model:
    path: str
    #: Languages and their piece probabilities [language, piece], some languages at a time.
    blocks: tuple[tuple[tuple[str, ...], np.ndarray], ...]

    @property
    def languages(self) -> tuple[str, ...]:
        return tuple(g for languages, _ in self.blocks for g in languages)


def fit(df: DataFrame, path: str, per_language: int = 1500, block: int = 200, rounds: int = 3, smoothing: float = 0.05, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learns piece probabilities from text and non-null lang of every given row (sampled to the bound), a block of
    languages at a time; there may be any number of blocks."""
    known = df.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter("lang is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("size"))
    languages = sorted(r["lang"] for r in sizes.select("lang").collect())
    shares = F.broadcast(sizes.select("lang", (F.lit(float(per_language)) / F.col("size")).alias("share")))  # a row for each language
    part = known.join(shares, "lang").filter((F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) / 1e6) < F.col("share"))

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for langs, texts in chunks(batch):
                seen: dict[tuple[str, str], int] = {}
                for lang, text in zip(langs, texts, strict=True):
                    for w in letter_runs(text.lower()):
                        seen[lang, w] = seen.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    words, w_path = staged(part.select("lang", "text").mapInArrow(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    blocks = tuple(_learned(words, path, tuple(languages[k : k + block]), rounds, smoothing) for k in range(0, len(languages), block))
    dropped(df.sparkSession, w_path)
    return Model(path, blocks)


def _learned(words: DataFrame, path: str, languages: tuple[str, ...], rounds: int, smoothing: float) -> tuple[tuple[str, ...], np.ndarray]:
    """The languages with their piece probabilities, by expectation maximisation over their words (lang, word, n)."""
    vocab, context = vocabulary(path), words.sparkSession.sparkContext
    words = words.filter(F.col("lang").isin(*languages))
    at = {g: k for k, g in enumerate(languages)}
    prob = np.full((len(languages), len(vocab)), 1 / len(vocab))
    for _ in range(rounds):
        shared = context.broadcast(prob)  # bounded by vocabulary times languages

        def expected(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            prob, total, vocab = shared.value, {}, vocabulary(path)
            for batch in it:
                for part in slices(batch):
                    lang = np.array([at[g] for g in part.column(0).to_pylist()], np.int64)
                    words, n = part.column(1).to_pylist(), part.column(2).to_numpy(zero_copy_only=False)
                    for g in np.unique(lang).tolist():
                        mine = np.flatnonzero(lang == g)
                        total[g] = total.get(g, 0) + expected_counts([words[i] for i in mine], n[mine], vocab, prob[g])
            for g, counts in total.items():
                piece = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), g, np.int32)), pa.array(piece.astype(np.int32)), pa.array(counts[piece])], ["g", "piece", "n"])

        sums = words.mapInArrow(expected, "g int, piece int, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full_like(prob, smoothing)
        counts[sums["g"].to_numpy(), sums["piece"].to_numpy()] += sums["n"].to_numpy()
        prob = counts / counts.sum(axis=1, keepdims=True)
        shared.unpersist()
    return languages, prob


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior of the predicted language). Rows pass one block of languages after the other
    and carry the best language so far with its log likelihood and the logarithm of the sum of all."""
    start = {"lang_pred": F.lit(None).cast("string"), "best": F.lit(None).cast("double"), "total": F.lit(None).cast("double")}
    rows = texts_of(df, id_col, text_col).withColumns(start)
    for languages, prob in model.blocks:
        rows = rows.mapInArrow(_scorer(df, model.path, languages, prob), "doc_id long, text string, lang_pred string, best double, total double")
    score = F.when(F.col("best").isNull(), 0.0).otherwise(F.exp(F.col("best") - F.col("total")))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"))


def _scorer(df: DataFrame, path: str, languages: tuple[str, ...], prob: np.ndarray):
    """The function for mapInArrow that sets the rows of predict against a block of languages."""
    shared = df.sparkSession.sparkContext.broadcast(prob)  # bounded by vocabulary times languages of a block

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, index, table = vocabulary(path), {}, np.zeros((0, len(languages)))
        for batch in it:
            for part in slices(batch):
                if len(index) * len(languages) > KEPT:
                    index, table = {}, table[:0]
                numbers, new = [], []
                for text in part.column(1).to_pylist():
                    own = letter_runs(text.lower())
                    at = np.zeros(len(own), np.int64)
                    for k, w in enumerate(own):
                        i = index.get(w)
                        if i is None:
                            i = index[w] = len(index)
                            new.append(w)
                        at[k] = i
                    numbers.append(at)
                if new:
                    table = np.concatenate([table, log_likelihoods(new, vocab, shared.value)])
                preds, bests, totals = (part.column(k).to_pylist() for k in (2, 3, 4))
                for row, at in enumerate(numbers):
                    if len(at):
                        ll = table[at].sum(axis=0)
                        k = int(ll.argmax())
                        best, total = float(ll[k]), float(ll[k] + np.log(np.exp(ll - ll[k]).sum()))
                        totals[row] = total if totals[row] is None else float(np.logaddexp(totals[row], total))
                        if bests[row] is None or best > bests[row]:
                            preds[row], bests[row] = languages[k], best
                facts = [pa.array(preds, pa.string()), pa.array(bests, pa.float64()), pa.array(totals, pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *facts], ["doc_id", "text", "lang_pred", "best", "total"])

    return run
