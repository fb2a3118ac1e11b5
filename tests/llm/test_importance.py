"""Importance resampling against a plain version over regular expressions and zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shardmend.llm import importance
from shardmend.llm.common import utf8

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def runs(text, most):
    own = words(text)
    return [" ".join(own[i : i + k]) for k in range(1, most + 1) for i in range(len(own) - k + 1)]


def bucket(run, buckets):
    return zlib.crc32(run.encode()) % buckets


TEXTS = ["", None, "A", "one  two,three", "É é ß", "x" * 300 + " y", "日本語 テキスト", "a1b2-c3 D4", "don't", "\x00z\x7fq", "ends here", "here begins", " lead", "trail ", "z" * 48, "z" * 49, "🙂"]


@pytest.mark.parametrize("run", [1, 2, 3])
def test_features_by_regular_expressions(run):
    r = random.Random(run)
    texts = TEXTS + ["".join(r.choice(["a", "Z", " ", "é", "-", "0", "\n", "語", "."]) for _ in range(r.randrange(80))) for _ in range(200)]
    data, starts = utf8(pa.array(texts, pa.string()))
    row, found, n_words = importance.features(data, starts, 997, run)
    assert n_words.tolist() == [len(words(t)) for t in texts]
    for i, t in enumerate(texts):
        assert Counter(found[row == i].tolist()) == Counter(bucket(x, 997) for x in runs(t, run)), t


def plain(docs, target, percent, least, buckets, run):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(bucket(x, buckets) for x in runs(text, run))
    for text in target:
        t.update(bucket(x, buckets) for x in runs(text, run))
    ns, nt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ns + buckets) / ((s[b] + 1) * (nt + buckets))))
    out = []
    for i, text in docs:
        own = runs(text, run)
        key = str(i) if i is not None else "text " + hashlib.md5((text or "").encode()).hexdigest()
        weight = sum(gain(bucket(x, buckets)) for x in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{key}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    for k, x in enumerate(able[: len(able) * percent // 100], 1):
        x[4] = k
    return [tuple(x[:5]) for x in out]


def table(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(200)]
    return [" ".join(r.choice(vocabulary[: r.choice([20, 200])]) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("run", [1, 2])
def test_whole_result_by_a_plain_version(spark, run):
    docs = list(enumerate(table(1, 300))) + [(None, "no id " * 30), (1000, None), (1001, ""), (1002, " ".join(table(3, 500)))]
    target = [*table(2, 40), None, ""]
    frame = spark.createDataFrame([(i, t, "clash", "clash") for i, t in docs], "doc_id long, text string, score string, rank string").repartition(6)
    got = importance.resampled(frame, spark.createDataFrame([(t,) for t in target], "text string"), 25, 20, 500, run)
    expect = plain(docs, target, 25, 20, 500, run)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expect, key=str)
    assert importance.drawn(frame, frame, percent=25).count() == sum(len(words(t)) >= 20 for _, t in docs) * 25 // 100


def test_repeated_rows_ties_and_empty_tables(spark):
    text = "word " * 25
    docs = spark.createDataFrame([(7, text)] * 40 + [(8, text)] * 40 + [(9, "short")], "doc_id long, text string")
    none = docs.limit(0).select("text")
    rows = importance.resampled(docs, none, percent=30).collect()
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, 25)) and len(rows) == 81
    assert len({r["doc_id"] for r in rows if r["rank"] is not None}) == 1
    assert all(r["rank"] is None for r in importance.resampled(docs, docs, percent=0).collect())
    assert all(r["rank"] is not None for r in importance.resampled(docs, docs, percent=100).collect() if r["doc_id"] != 9)
    assert importance.resampled(docs.limit(0), docs).collect() == []
    words_as_ids = docs.selectExpr("concat('id ', doc_id) AS doc_id", "text")
    assert len(importance.resampled(words_as_ids, none).collect()) == 81


def test_long_words_and_rows_side_by_side():
    texts = ["a" * 100_000, "a" * 100_000 + "b", "", "b"]
    data, starts = utf8(pa.array(texts))
    row, found, _ = importance.features(data, starts)
    assert found.tolist() == [bucket(t, importance.BUCKETS) for t in texts if t] and row.tolist() == [0, 1, 3]
    assert np.array_equal(importance.CRC[:4], np.array([0, 0x77073096, 0xEE0E612C, 0x990951BA], np.uint32))
