"""Hashes of words and shingles against Python's own, on generated texts."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardmend.llm import common

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\r\x0b\x0c  Z9-", max_size=40)), max_size=12)


def words(text):
    return re.findall(common.WORD, text or "")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_hash_alike_where_they_are_alike(texts):
    data, starts = common.utf8(pa.array(texts, pa.string()))
    h, row, begin, end = common.word_hashes(data, starts)
    expect = [(i, w) for i, t in enumerate(texts) for w in words(t)]
    assert [(int(r), bytes(data[b:e]).decode()) for r, b, e in zip(row, begin, end, strict=True)] == expect
    by_word, by_hash = {}, {}
    for x, (_, w) in zip(h.tolist(), expect, strict=True):
        assert by_word.setdefault(w, x) == x and by_hash.setdefault(x, w) == w


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 5))
def test_shingles_are_runs_of_words(texts, k):
    data, starts = common.utf8(pa.array(texts, pa.string()))
    h, row, _, _ = common.word_hashes(data, starts)
    g, of = common.shingle_hashes(h, row, len(texts), k)
    got = Counter((int(r), int(x)) for r, x in zip(of, g, strict=True))
    runs = [(i, tuple(w[j : j + k])) for i, t in enumerate(texts) if (w := words(t)) for j in range(max(1, len(w) - k + 1))]
    assert sorted(got.values()) == sorted(Counter(runs).values()) and Counter(int(r) for r in of) == Counter(i for i, _ in runs)


def test_groups_of_rows_cover_all():
    for sizes in ([], [0, 0, 0], [5, 1, 0, 9, 2], [100]):
        starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        parts = list(common.row_groups(starts, 6))
        assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))


def test_ranks_over_shards_are_ranks(spark):
    rows = [(g, i * 7 % 101) for g in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r["g"], r["v"]): r["rank"] for r in common.ranked(df, ["g"], [F.col("v")], F.floor(F.col("v") / 10)).collect()}
    for g in ("a", "b", None):
        own = sorted(v for x, v in rows if x == g)
        assert [got[(g, v)] for v in own] == list(range(len(own)))
