"""Best-fit packing against whole texts through the tokenizer and a plan piece by piece."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardmend.llm import bestfit, queries

SCHEMA = "doc_id long, text string, length string, rank string"


def tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def test_parts_of_texts_give_the_ids_of_the_whole():
    r = random.Random(5)
    own = tokenizer()
    words = ["the", "don't", "é", "x y", "12", "...", "\n", "\t", "  ", " ", "　", "日本語のテキスト", "a" * 70, "<|endoftext|>", "🙂", "\x1f", " ", "I'll", "-", "​"]
    texts = ["", " ", "  ", "x", "  x", "x  ", "　 x", " 　x", "a  　x", "a \n x", "<|endoftext|>", "a  <|endoftext|> b"]
    texts += ["".join(r.choice(words) + r.choice(["", " ", "  ", " "]) for _ in range(r.randrange(60))) for _ in range(600)]
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encode = bestfit.encoder(f.read())
    expect = [own.encode(t, add_special_tokens=False).ids for t in texts]
    for step in (1, 7, 1 << 20):
        assert [bestfit.ids_of(t, encode, step).tolist() for t in texts] == expect


def test_ranks_give_the_ids_of_the_tokenizer():
    """Every entry of the vocabulary as a text, all words of the sample documents, and a tokenizer that isn't done by ranks."""
    own = tokenizer()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    encode = bestfit.encoder(text)
    assert bestfit.byte_ranks(text) is not None
    texts = [own.decode([i], skip_special_tokens=False) for i in range(50257)]
    for row in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist():
        texts += {" " + x for x in (row or "").split(" ")}
    assert [encode(t) for t in texts] == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        words = f.read()
    assert bestfit.byte_ranks(words) is None and bestfit.encoder(words)("two words") == Tokenizer.from_str(words).encode("two words", add_special_tokens=False).ids


def one_by_one(lengths, capacity):
    """Sequences that best-fit decreasing opens, piece by piece."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= x]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(capacity - x)
    return sorted(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120))
def test_plan_over_counts_is_best_fit_piece_by_piece(lengths):
    counts = defaultdict(int)
    for x in lengths:
        counts[x] += 1
    at, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset, per in bestfit.best_fit(counts, 30):
        for i in range(n):
            at[first + i // per].append((offset + i % per * length, length))
            ranks[length].append(rank + i)
    assert all(sorted(v) == list(range(counts[k])) for k, v in ranks.items())
    rooms = []
    for slots in at.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:], strict=False))
        rooms.append(30 - sum(n for _, n in slots))
    assert sorted(rooms) == one_by_one(lengths, 30)


def test_plan_stays_small():
    counts = {k: 10**9 // k for k in range(1, 1025)}
    runs = bestfit.best_fit(counts)
    assert len(runs) < 20_000
    used = max(first + -(-n // per) for _, _, n, first, _, per in runs)
    assert used <= 1.001 * sum(k * n for k, n in counts.items()) / 1024 + 1


def rows(seed=3):
    r = random.Random(seed)
    texts = [" ".join(r.choice(["stone", "river", "of", "Éa", "12,5", "x\n\ny"]) for _ in range(r.choice([0, 1, 3, 40, 300, 900]))) for _ in range(60)]
    texts += ["same words here"] * 40 + [None, "", " ", "q" * 5000, "w " * 3000]
    return [(i, t, "clash", "clash") for i, t in enumerate(texts)] + [(7, "repeated id", "", ""), (7, "repeated id", "", ""), (None, "no id", "", ""), (None, None, "", "")]


def test_pieces_and_sequences(spark, monkeypatch):
    monkeypatch.setattr(bestfit, "SHARD_ROWS", 8)
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    own = tokenizer()
    expect = []
    for i, text, *_ in rows():
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        expect += [(i, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = bestfit.packed_pieces(docs).collect()
    key = lambda x: (x[0] is not None, *[v or 0 for v in x])
    assert sorted((tuple(x[:5]) for x in got), key=key) == sorted(expect, key=key)
    of = defaultdict(list)
    for x in got:
        of[x["sequence_id"]].append((x["offset"], x["length"]))
    for slots in of.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:], strict=False)) and sum(n for _, n in slots) <= 1024
    assert len(of) == len(one_by_one([x[3] for x in expect], 1024)) == max(of) + 1
    again = bestfit.packed_pieces(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    whole = bestfit.sequences(docs).collect()
    assert len(whole) == len(of) and sum(x["length"] for x in whole) == sum(x[3] for x in expect)
    text_of = {i: t for i, t, *_ in rows() if i is not None}
    for x in whole:
        assert len(x["ids"]) == x["length"]
        for doc_id, begin, end in zip(x["doc_ids"], x["offsets"], [*x["offsets"][1:], x["length"]], strict=True):
            if doc_id not in (None, 7) and end - begin < 1024 and len(text_of[doc_id] or "") < 2000:
                assert own.decode(x["ids"][begin : end - 1], skip_special_tokens=False) == (text_of[doc_id] or "")
    assert bestfit.packed_pieces(docs.limit(0)).collect() == [] and bestfit.sequences(docs.limit(0)).collect() == []


def test_ids_of_any_type_and_the_query(spark, tmp_path):
    docs = spark.createDataFrame([("a", "one two"), ("b", None)], "doc_id string, text string")
    assert {(x["doc_id"], x["length"]) for x in bestfit.packed_pieces(docs).collect()} == {("a", 3), ("b", 1)}
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_best_fit(spark, str(tmp_path)).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
