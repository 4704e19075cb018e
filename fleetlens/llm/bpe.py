"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. In each round every word finds its pair of lowest
rank (binary search of the pair keys in the sorted keys of the merge table), all words merge theirs at once,
and words without a pair leave the array. A worker keeps the ids of the words it has met, up to a bound.

Null and empty texts have no ids and decode to the empty text; very long texts are worked on whole; repeated
rows give repeated results; an empty table gives an empty table; other columns are ignored by `encode_decode`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import chunks, texts_of

# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int64(1 << 40)
#: Distinct words that a worker keeps; beyond it the memory is emptied. Results don't depend on it.
KEPT_WORDS = 300_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class _Index(dict):
    """Word -> number; a new word gets the next number and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = len(self)
        self[word] = n
        self.new.append(word)
        return n


class ByteBPE:
    def __init__(self, path: str) -> None:
        spec = json.loads(open(path, encoding="utf-8").read())
        letters = _byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.base = max(vocab.values()) + 1
        self.byte_ids = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_ids[b] = vocab[letter]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = made
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("added tokens that strip or need word borders aren't supported")
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.words = regex.compile(PATTERN)
        size = max([self.base, *(i + 1 for i in self.specials.values())])
        self.token_bytes = [b""] * size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.token_bytes[i] = token.encode()
        self._forget()

    def _forget(self) -> None:
        self.index = _Index()
        self.flat = np.array(list(self.specials.values()), np.uint32)
        self.length = np.ones(len(self.specials), np.int64)
        for s in self.specials:
            self.index[s] = len(self.index)
        self.start = np.arange(len(self.specials), dtype=np.int64)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and how many each has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), length)
        done_sym, done_owner = [], []
        while len(sym):
            rank = np.full(len(sym), NONE)
            key = sym[:-1] * self.base + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[:-1] = np.where((self.keys[at] == key) & (owner[:-1] == owner[1:]), self.ranks[at], NONE)
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(rank, first)
            per = np.diff(np.r_[first, len(sym)])
            own_best = np.repeat(best, per)
            over = own_best == NONE
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
            hit = (rank == own_best) & ~over
            at = np.flatnonzero(hit)
            if not len(at):
                break
            # the same pair may overlap itself (a a a): of a run of hits every second one merges
            new_run = np.r_[True, np.diff(at) != 1]
            within = np.arange(len(at)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
            at = at[within % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = ~over
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        if not done_sym:
            return np.zeros(0, np.uint32), length
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return sym[order].astype(np.uint32), np.bincount(owner, minlength=len(words))

    def _learn(self) -> None:
        if new := self.index.new:
            flat, length = self.merged([w.encode("utf-8", "surrogatepass") for w in new])
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(length) - length])
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat])
            self.index.new = []

    def _split(self, text: str) -> list[str]:
        if self.split is None or not self.split.search(text):
            return self.words.findall(text)
        out, end = [], 0
        for m in self.split.finditer(text):
            out += self.words.findall(text[end : m.start()])
            out.append(m.group())
            end = m.end()
        return out + self.words.findall(text[end:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > KEPT_WORDS:
            self._forget()
        numbers = []
        for text in texts:
            words = self._split(text)
            numbers.append(np.fromiter(map(self.index.__getitem__, words), np.int64, len(words)))
        self._learn()
        out = []
        for k in numbers:
            length = self.length[k]
            end = np.cumsum(length)
            total = int(end[-1]) if len(end) else 0
            out.append(self.flat[np.repeat(self.start[k] - end + length, length) + np.arange(total)])
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


def _run(df: DataFrame, path: str, schema: str, work) -> DataFrame:
    out = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in it:
            for ids, values in chunks(batch):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([ids, *work(bpe, values)], out, strict=True)], schema=out)

    return df.mapInArrow(batches, schema)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, packed), n_tokens."""
    return _run(texts_of(df, id_col, text_col), path, "doc_id long, ids binary", lambda bpe, v: [[x.astype("<u4").tobytes() for x in bpe.encode(v)]]).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded: the text of packed ids; bytes that are no UTF-8 become U+FFFD."""
    ids = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.unhex(F.lit(""))).alias("ids"))
    return _run(ids, path, "doc_id long, decoded string", lambda bpe, v: [[bpe.decode(np.frombuffer(x, "<u4")) for x in v]])


def encode_decode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, decoded in one pass over the texts."""

    def both(bpe: ByteBPE, texts: list[str]) -> list[list]:
        ids = bpe.encode(texts)
        return [[x.astype("<u4").tobytes() for x in ids], [bpe.decode(x) for x in ids]]

    return _run(texts_of(df, id_col, text_col), path, "doc_id long, ids binary, decoded string", both).withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))
