"""License scans: fixed phrases, and fuzzy search for short notices.

A notice may differ from its wording by k edits. Cut into k + 1 pieces, at least one piece stands in the text
unchanged (pigeonhole), so an Aho-Corasick search for the pieces finds every place that can match; there, the regex
library's bounded-error matching verifies the edits and gives the span.

Null and empty texts have no words, spans or labels; texts of any length are scanned whole; repeated rows give
repeated results; empty tables give empty results; other columns are ignored. Spans count code points of the
lower-cased text, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from fleetlens.llm.common import ascii_lower, chunks, texts_of

# Base phrases with their labels, and the opening words of public notices.
PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
NOTICES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license, version 2.0"),
    ("gpl", "licensed under the gnu general public license"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("isc", "permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by-sa", "licensed under cc by-sa 4.0"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 16


@lru_cache(maxsize=1)
def searcher():
    """Automaton of all pieces -> (notice, offset), and the notices as (label, wording, edits, pattern)."""
    import ahocorasick

    auto, notices, found = ahocorasick.Automaton(), [], {}
    for k, (label, wording) in enumerate(NOTICES):
        edits = max(1, len(wording) // CHARS_PER_EDIT)
        notices.append((label, wording, edits, regex.compile(f"(?b)(?:{regex.escape(wording)}){{e<={edits}}}")))
        cuts = [len(wording) * j // (edits + 1) for j in range(edits + 2)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            found.setdefault(wording[a:b], []).append((k, a))
    for piece, places in found.items():
        auto.add_word(piece, (len(piece), places))
    auto.make_automaton()
    return auto, notices


def fuzzy_spans(low: str) -> list[tuple[int, int, str, int, float]]:
    """(start, end, label, edits, likeness): for each place the best match; overlapping notices leave the better one."""
    auto, notices = searcher()
    ranges: dict[int, list[list[int]]] = {}
    for end, (length, places) in auto.iter(low):
        for k, offset in places:
            _, wording, edits, _ = notices[k]
            begin = end - length + 1 - offset
            a, b = max(0, begin - edits), min(len(low), begin + len(wording) + edits)
            mine = ranges.setdefault(k, [])
            if mine and a <= mine[-1][1]:
                mine[-1] = [min(a, mine[-1][0]), max(b, mine[-1][1])]
            else:
                mine.append([a, b])
    hits = []
    for k, places in ranges.items():
        label, wording, _, pattern = notices[k]
        for a, b in places:
            for m in pattern.finditer(low, a, b):
                edits = sum(m.fuzzy_counts)
                hits.append((m.start(), m.end(), label, edits, 1 - edits / len(wording)))
    return best_apart(hits)


def best_apart(hits: list[tuple[int, int, str, int, float]]) -> list[tuple[int, int, str, int, float]]:
    """Hits in text order that don't overlap: the likelier go first, then the longer, the earlier. What is kept stays
    sorted, so each hit is held against its two neighbours."""
    best: list[tuple[int, int, str, int, float]] = []
    for hit in sorted(hits, key=lambda h: (-h[4], -(h[1] - h[0]), h[0], h[2])):
        k = bisect_left(best, hit[0], key=lambda x: x[0])
        if (k == 0 or best[k - 1][1] <= hit[0]) and (k == len(best) or hit[1] <= best[k][0]):
            best.insert(k, hit)
    return best


def phrase_places(low: str) -> tuple[int, list[tuple[int, str]]]:
    """Number of words, and (word number, label) of every base phrase."""
    words = WORD.findall(low)
    if "license" not in low:
        return len(words), []
    out = []
    for i, word in enumerate(words):
        if word == "license":
            for phrase, label in PHRASES.items():
                n = len(phrase)
                if i + 1 >= n and tuple(words[i + 1 - n : i + 1]) == phrase:
                    out.append((i + 1 - n, label))
    return len(words), out


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, places (word number, label) of the phrases, notices (start, end, label, edits, likeness)."""
    place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string())]))
    notice = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("likeness", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for ids, texts in chunks(batch):
                n, places, notices = [], [], []
                for text in texts:
                    low = ascii_lower(text)
                    count, at = phrase_places(low)
                    n.append(count)
                    places.append([{"word": w, "label": x} for w, x in at])
                    notices.append([dict(zip(("start", "end", "label", "edits", "likeness"), h, strict=True)) for h in fuzzy_spans(low)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(places, place), pa.array(notices, notice)], ["doc_id", "n_words", "places", "notices"])

    return texts_of(df, id_col, text_col).mapInArrow(
        run, "doc_id long, n_words long, places array<struct<word: long, label: string>>, notices array<struct<start: long, end: long, label: string, edits: long, likeness: double>>"
    )
