"""Fill-in-middle against plain slices, and the boundary lists against a scan."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardmend.llm import infill


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aé語🙂", max_size=3000)))
def test_boundaries_by_a_scan(text):
    raw = text.encode("utf-8", "surrogatepass")
    index = infill.elias_fano(raw)
    places = [0]
    for c in text:
        places.append(places[-1] + len(c.encode("utf-8", "surrogatepass")))
    some = range(len(places)) if len(places) < 100 else [*random.Random(1).sample(range(len(places)), 60), 0, len(places) - 1]
    assert [infill.selected(index, i) for i in some] == [places[i] for i in some]


def test_lists_are_small():
    for text in ("a" * 100_000, "é" * 50_000, "🙂" * 25_000):
        assert len(infill.elias_fano(text.encode())) * 8 < 4.2 * len(text) + 2000


def plain(i, text):
    own = text or ""
    key = str(i) if i is not None else "text " + hashlib.md5(own.encode()).hexdigest()
    h = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(own) + 1), h2 % (len(own) + 1)))
    if not own or any(m in own for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        form, out = "plain", own
    elif h4 % 100 < 20:
        form, out = "spm", f"<S>{own[b:]}<P>{own[:a]}<M>{own[a:b]}"
    else:
        form, out = "psm", f"<P>{own[:a]}<S>{own[b:]}<M>{own[a:b]}"
    return (i, len(own), form, a if form != "plain" else None, b - a if form != "plain" else None, out, own)


def rows():
    r = random.Random(4)
    texts = ["".join(r.choice(["a", " ", "é", "語", "🙂", "<", ">", "P", "S", "M", "\n"]) for _ in range(r.randrange(120))) for _ in range(300)]
    texts += ["a copy that many rows hold"] * 400 + ["ein zweiter Text, den viele haben: é"] * 150
    texts += [None, "", "<P>", "x<S>y", "<M", "<", "P>", "a" * 200_000, "语" * 70_000 + "🙂"]
    return list(enumerate(texts)) + [(5, "repeated"), (5, "repeated"), (5, "other text"), (None, "no id"), (None, None)]


@pytest.mark.parametrize("hot_rows", [512, 16])
def test_whole_result_by_plain_slices(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(infill, "HOT_ROWS", hot_rows)
    docs = spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows()], "doc_id long, text string, name string, `p.q` string, _fim string").repartition(6)
    got = [(x["doc_id"], *x["_fim"]) for x in infill.infilled(docs, docs.columns).collect()]
    expect = [plain(i, t) for i, t in rows()]
    assert sorted(got, key=str) == sorted(expect, key=str)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    carried = infill.infilled(docs, docs.columns)
    assert carried.columns == ["doc_id", "text", "name", "p.q", "_fim"] and carried.where("name = 'clash' AND `p.q` = 'clash'").count() == len(expect)
    assert infill.infilled(docs.limit(0), ["doc_id"]).collect() == []


def test_digest_and_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", "some text"), ("b", None)], "doc_id string, text string")
    for x in infill.infill_digest(docs).collect():
        _, n, form, prefix, middle, out, own = plain(x["doc_id"], {"a": "some text", "b": None}[x["doc_id"]])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(x)[1:] == (n, form, prefix, middle, sha(out), sha(own))
