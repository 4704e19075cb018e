"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

A run of 20 or more key characters is suspicious if a BPE vocabulary needs many tokens for it: text that a
tokenizer knows takes 3 to 5 characters a token, random strings under `least_chars_per_token`. Before the test,
digests of known length, UUIDs and plain numbers are set aside. Runs shaped like identifiers (names made of letter
parts) are tested by part and without case instead, since the vocabulary knows few words in capitals; their shape alone
proves nothing. Parts that are one token each pass; random parts of one or two letters can't be told from words.

Null and empty texts have no spans; texts of any length are scanned whole; repeated rows give repeated results;
empty tables give empty results; other columns are ignored. Spans count code points, ends exclusive.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.common import chunks, texts_of

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
# Lengths in hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
#: Letter parts (one case, or capitalised) joined by separators, each with a short number at most.
IDENTIFIER = re.compile(r"(?:(?:[a-z]+|[A-Z]+|(?:[A-Z][a-z]+)+)[0-9]{0,4}(?:[-_/+=]+|$))+")
CAMEL = re.compile(r"[a-z]+(?:[A-Z][a-z]+)*[0-9]{0,4}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[A-Z]")
REPEATED = re.compile(r"([-_/+=])[-_/+=]+")
LEAST_KEY = 20


@lru_cache(maxsize=2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """A digest, UUID or number: no random secret, whatever its tokens."""
    return (len(run) in DIGEST_LENGTHS and bool(DIGEST.fullmatch(run))) or bool(UUID.fullmatch(run)) or not re.search(r"[A-Za-z]", run)


def has_random_parts(run: str, enc, least_chars_per_token: float) -> bool:
    """Whether the letter parts of a run shaped like an identifier, all together or of one stretch that is long enough
    for a key, need more tokens than words do. Repeated separators count once."""
    run = REPEATED.sub(r"\1", run).strip("-_/+=")
    for stretch in {run, *re.split(r"[/+=]", run), *re.split(r"[-_/+=]", run)}:
        if len(stretch) >= LEAST_KEY:
            parts = [p.lower() for p in PART.findall(stretch)]
            tokens = sum(len(enc.encode_ordinary(p)) for p in parts)
            if tokens > len(parts) and sum(map(len, parts)) < least_chars_per_token * tokens:
                return True
    return False


def is_random(run: str, enc, least_chars_per_token: float) -> bool:
    if is_known(run):
        return False
    if IDENTIFIER.fullmatch(run) or CAMEL.fullmatch(run):
        return has_random_parts(run, enc, least_chars_per_token)
    return len(run) < least_chars_per_token * len(enc.encode_ordinary(run))


def random_spans(text: str, enc, least_chars_per_token: float) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text) if is_random(m.group(), enc, least_chars_per_token)]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, by start, then kind."""
    out = [(*m.span(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def scan(df: DataFrame, vocabulary: str, least_chars_per_token: float = 2.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and found: arrays of spans (kind, start, end), base ones alone and with those of the test."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    named = lambda spans: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in spans]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in it:
            for ids, texts in chunks(batch):
                base, found = [], []
                for text in texts:
                    own = base_spans(text)
                    more = [(*s, 3) for s in random_spans(text, enc, least_chars_per_token)]
                    base.append(named(own))
                    found.append(named(sorted(own + more, key=lambda s: (s[0], s[2]))))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base, span), pa.array(found, span)], ["doc_id", "base", "found"])

    kind = "array<struct<kind: string, start: long, end: long>>"
    return texts_of(df, id_col, text_col).mapInArrow(run, f"doc_id long, base {kind}, found {kind}")
