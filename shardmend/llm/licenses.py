"""License scans: base phrases exactly, short notices with a bounded number of edits.

A text is lower-cased in A-Z and cut into words of digits, letters a-z and anything beyond ASCII; words are joined by
one space. Base phrases are found where their words stand consecutively. A notice may differ by EDIT_SHARE of its
length: it is split into one piece more than it may have edits, so that one piece at least stands unchanged in any
occurrence. Pieces found exactly locate candidates, the stretches of whole words around them, and the ``regex``
library's bounded-error matching verifies the edits of each stretch.

Null text counts as empty and has no words and no labels. Very long texts are read whole, once for each piece, and their
stretches one by one. Rows that repeat a doc_id have equal results. Of overlapping finds of one label, the one with fewest
edits, then the first, counts. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shardmend.llm.common import arrow_map

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Short notices and their labels.
NOTICES = {
    "all rights reserved": "reserved",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the mit license": "mit",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge": "mit",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software": "isc",
}
#: Edits that a notice may have: one for so many characters.
CHARS_PER_EDIT = 10

_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SCHEMA = "n_words long, base array<struct<label:string,word:long>>, found array<struct<label:string,first_word:long,last_word:long,edits:int,similarity:double>>"
_BASE_TYPE = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
_FOUND_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("similarity", pa.float64())]))


def pieces(phrase: str) -> list[tuple[int, bytes]]:
    """Exact seeds of a phrase: one more than the edits that it may have, with their places."""
    n = len(phrase) // CHARS_PER_EDIT + 1
    cut = [len(phrase) * i // n for i in range(n + 1)]
    return [(a, phrase[a:b].encode()) for a, b in zip(cut, cut[1:], strict=False)]


def _plans() -> list[tuple[str, str, int, regex.Pattern, list[tuple[int, bytes]]]]:
    out = []
    for phrase, label in NOTICES.items():
        k = len(phrase) // CHARS_PER_EDIT
        out.append((phrase, label, k, regex.compile(rb"(?b)(?:" + phrase.encode() + rb"){e<=" + str(k).encode() + rb"}"), pieces(phrase)))
    return out


PLANS = _plans()


def words_of(text: str) -> bytes:
    """The words of a text, joined by one space."""
    return b" ".join(text.encode().lower().translate(_SPACES).split())


def places(text: bytes, phrase: bytes) -> list[int]:
    """Where the words of a phrase stand in words joined by spaces, overlaps included."""
    out, at = [], text.find(phrase)
    while at >= 0:
        end = at + len(phrase)
        if (at == 0 or text[at - 1] == 32) and (end == len(text) or text[end] == 32):
            out.append(at)
        at = text.find(phrase, at + 1)
    return out


def word_starts(text: bytes, low: int, high: int) -> list[int]:
    """Places from ``low`` to ``high`` where a word starts."""
    return [p for p in range(max(low, 0), min(high, len(text) - 1) + 1) if text[p] != 32 and (p == 0 or text[p - 1] == 32)]


def word_ends(text: bytes, low: int, high: int) -> list[int]:
    """Places from ``low`` to ``high`` where a word has just ended."""
    return [p for p in range(max(low, 1), min(high, len(text)) + 1) if text[p - 1] != 32 and (p == len(text) or text[p] == 32)]


def notices(text: bytes) -> list[tuple[str, int, int, int, float]]:
    """(label, start, end, edits, similarity) of notices in words joined by spaces."""
    found: list[tuple[str, int, int, int, float]] = []
    for phrase, label, k, pattern, seeds in PLANS:
        # Whole words only. What stands before a seed has its length give or take the edits, and so has what stands behind
        # it: a few starts and ends of words around each seed are all stretches that there are.
        spans: set[tuple[int, int]] = set()
        for offset, seed in seeds:
            at, rest = text.find(seed), len(phrase) - offset
            while at >= 0:
                ends = word_ends(text, at + rest - k, at + rest + k)
                if ends:
                    spans.update((s, e) for s in word_starts(text, at - offset - k, at - offset + k) for e in ends if abs(e - s - len(phrase)) <= k)
                at = text.find(seed, at + 1)
        for s, e in spans:
            m = pattern.fullmatch(text, s, e)
            if m is not None:
                edits = sum(m.fuzzy_counts)
                found.append((label, s, e, edits, 1 - edits / len(phrase)))
    # Of what overlaps under one label, the best stays; taken spans of a label don't overlap, so neighbours tell.
    taken: dict[str, list[tuple[int, int]]] = {}
    best: list[tuple[str, int, int, int, float]] = []
    for f in sorted(found, key=lambda f: (f[0], f[3], f[1], f[2])):
        spans = taken.setdefault(f[0], [])
        i = bisect.bisect_left(spans, (f[1], f[2]))
        if (i == 0 or spans[i - 1][1] <= f[1]) and (i == len(spans) or spans[i][0] >= f[2]):
            spans.insert(i, (f[1], f[2]))
            best.append(f)
    return sorted(best, key=lambda f: (f[1], f[2], f[0]))


def word_numbers(words: bytes, places: set[int]) -> dict[int, int]:
    """The number of the word at each place."""
    out, n, last = {}, 0, 0
    for p in sorted(places):
        n += words.count(b" ", last, p)
        out[p], last = n, p
    return out


def scan(text: str | None) -> tuple[int, list[dict], list[dict]]:
    """Number of words, base places, notices."""
    words = words_of(text or "")
    bases = [(label, p) for phrase, label in BASE.items() for p in places(words, phrase.encode())]
    found = notices(words)
    at = word_numbers(words, {p for _, p in bases} | {p for f in found for p in (f[1], f[2] - 1)})
    base = [{"label": label, "word": at[p]} for label, p in bases]
    more = [{"label": label, "first_word": at[s], "last_word": at[e - 1], "edits": edits, "similarity": near} for label, s, e, edits, near in found]
    return (words.count(b" ") + 1 if words else 0), sorted(base, key=lambda b: (b["word"], b["label"])), more


def license_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, base, found): base places and notices with their spans in words."""
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, base, found = zip(*map(scan, batch.column("text").to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(base, _BASE_TYPE), pa.array(found, _FOUND_TYPE)], names=["doc_id", "n_words", "base", "found"])

    return arrow_map(docs.select("doc_id", "text"), run, f"doc_id {id_type}, {SCHEMA}")


def license_report(docs: DataFrame) -> DataFrame:
    """A row for each document: numbers of words and base places, the first and last of them, labels and the best score."""
    from pyspark.sql import functions as F

    names = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("base", lambda x: x["word"])
    score = F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda x: x["similarity"])), F.lit(0.0)))
    return license_spans(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names("base")).alias("base_labels"), joined(F.concat(names("base"), names("found"))).alias("labels"), score.alias("score"), F.size("found").cast("long").alias("n_notices"),
    )
