"""Each operator against a plain version of what it computes, on small inputs."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shardmend.llm import common, fingerprint, html, licenses, linededup, media, mixing, neardup, packing, quality
from shardmend.llm.common import utf8

VOCABULARY = [a + b for a in "ka lo mi ne ru sa to vi".split() for b in "b d f g l m n p r s t".split()]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) + (str(r.randrange(9)) if r.random() < 0.5 else "") for _ in range(n))


def edited(r, text, rate):
    return " ".join(r.choice(VOCABULARY) + "x" if r.random() < rate else w for w in text.split(" "))


def family(seed, groups=12, size=8):
    """Groups of copies with more and more edits, around the threshold too."""
    r = random.Random(seed)
    out = []
    for _ in range(groups):
        base = prose(r, r.choice([5, 20, 60, 150]))
        out += [edited(r, base, r.choice([0, 0.02, 0.04, 0.06, 0.1])) for _ in range(size)]
    r.shuffle(out)
    return out


def test_fingerprint_features_by_brute_force():
    r = random.Random(3)
    texts = ["", "abc", "x" * 200, "the quick brown fox " * 9, "".join(r.choice("abcdefgh é") for _ in range(500)), "".join(r.choice("abcdefgh é") for _ in range(70))]
    rank = fingerprint.rarity_ranks(np.arange(fingerprint.GRADES)[::-1])
    got = fingerprint.features(*utf8(pa.array(texts)), rank)
    for text, h in zip(texts, got, strict=True):
        b = text.encode()
        b = b + b"\0" * (64 - len(b)) if 0 < len(b) < 64 else b
        grades = [(6 * 64 * 1024 - sum(int(round(v * math.log2(v) * 1024)) for v in Counter(b[i : i + 64]).values())) * 1000 // (6 * 64 * 1024) for i in range(len(b) - 63)]
        popular = Counter(min(range(s, min(len(grades), s + 64)), key=lambda i: (rank[grades[i]], i)) for s in range(max(1, len(grades) - 63))) if grades else Counter()
        least = min(16, max(popular.values(), default=0))
        assert len(h) == len({b[i : i + 64] for i, n in popular.items() if n >= least})
    assert fingerprint.likeness(fingerprint.digest(got[4]), fingerprint.digest(got[4])) == 1.0


def test_long_text_in_pieces_equals_whole(monkeypatch):
    r = random.Random(4)
    data = utf8(pa.array(["".join(r.choice("abcdefgh é.,!ABCD") for _ in range(30_000))]))
    rank = fingerprint.rarity_ranks(np.arange(fingerprint.GRADES)[::-1])
    whole = fingerprint.features(*data, rank)[0]
    monkeypatch.setattr(fingerprint, "PIECE", 4096)
    assert (fingerprint.features(*data, rank)[0] == whole).all()


def test_dull_stretches_of_a_long_text(monkeypatch):
    """A piece of spaces alone has no feature of its own where the rest of its text has popular windows; dull texts have."""
    r = random.Random(41)
    text = prose(r, 400) + " " * 20_000 + prose(r, 300) + "ab" * 9000
    texts = [text, " " * 30_000, "x" * 9_000 + "y" * 9_000, "short one"]
    rank = fingerprint.rarity_ranks(np.arange(fingerprint.GRADES)[::-1])
    data = utf8(pa.array(texts))
    whole = fingerprint.features(*data, rank)
    monkeypatch.setattr(fingerprint, "PIECE", 4096)
    for h, w in zip(fingerprint.features(*data, rank), whole, strict=True):
        assert h.tolist() == w.tolist() and len(w)


def test_neighbours_follow_descending_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "PART_BYTES", 500)
    monkeypatch.setattr(fingerprint, "LEAST_PART", 500)
    monkeypatch.setattr(fingerprint, "WORK_CHARS", 400)
    texts = {i * 3: prose(random.Random(i), 30 + i) for i in range(40)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    import hashlib

    ids = sorted(texts, reverse=True)
    for row in fingerprint.fingerprints(docs).collect():
        own, other = texts[row["doc_id"]], texts[ids[(ids.index(row["doc_id"]) + 1) % len(ids)]]
        k = len(own) // 3
        assert row["edited_sha256"] == hashlib.sha256((own[: len(own) - k] + other[:k]).encode()).hexdigest()


@pytest.mark.parametrize("buckets", [1, 3, 5])
def test_boundaries_are_optimal(buckets):
    r = random.Random(buckets)
    lengths = np.array(sorted(r.sample(range(1, 60), 11)))
    counts = np.array([r.randrange(1, 9) for _ in lengths])
    tokens = lengths * counts

    def waste(bounds):
        return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))

    best = min((waste((*c, lengths[-1])) for c in itertools.combinations(lengths[:-1], buckets - 1)))
    assert waste(packing.optimal_boundaries(lengths, counts, tokens, buckets)) == best


def test_mix_fills_up_to_the_caps(spark):
    sizes = {"a": 1000, "b": 4000, "c": 300, "d": 2500}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    weight, left = dict(zip(sorted(sizes), (3, 1, 2, 3), strict=True)), 1.5 * sum(sizes.values())
    target, open_ = {}, set(sizes)
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not full:
            target |= share
            break
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    assert got == pytest.approx(target)


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_by_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    texts = family(k)
    sets = [{" ".join(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k).collect()}
    assert got == {i: find(i) for i in range(len(texts))}


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 200), (200, 300)], "x long, y long")
    got = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_likelihood_finds_the_similarity():
    r = np.random.default_rng(5)
    for true in (0.5, 0.8, 0.95):
        shared, own = int(2000 * true), int(1000 * (1 - true))
        u = r.integers(0, 1 << 32, (shared + 2 * own, neardup.M)).astype(np.uint32)
        a, b = (neardup.registers(u[s].min(axis=0)) for s in (slice(0, shared + own), np.r_[0:shared, shared + own : len(u)]))
        est = neardup.likely_similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([shared + own]), np.array([shared + own]))[0]
        assert abs(est - shared / (shared + 2 * own)) < 0.1


@pytest.mark.parametrize(("hot", "depth"), [(6, 16), (1000, 1), (10**6, 16)])
def test_line_dedup_by_brute_force(spark, monkeypatch, hot, depth):
    for name, value in {"HOT": hot, "OFTEN": 1, "LOOK_ROWS": 64, "WORDS_IN_BUCKET": 4000, "FLUSH": 500, "PACK": 20, "DEPTH": depth}.items():
        monkeypatch.setattr(linededup, name, value)
    lines = family(9, groups=15, size=10)
    docs = {i: "\n".join(lines[i * 5 : i * 5 + 5]) for i in range(30)}
    seen, expect = [], {}
    for i, text in docs.items():
        kept = []
        for line in text.split("\n"):
            own = set(line.split())
            if not any(100 * len(own & o) >= 80 * len(own | o) for o in seen):
                kept.append(line)
            seen.append(own)
        expect[i] = "\n".join(kept)
    got = linededup.without_repeated_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == expect


def test_quality_on_held_out_rows(spark):
    r = random.Random(6)
    good = [(i, prose(r, 60), 1) for i in range(300)]
    bad = [(300 + i, " ".join(w + r.choice(["###", "$$$", "!!"]) for w in prose(r, 60).split()), 0) for i in range(300)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    rows = quality.quality_scores(docs.drop("quality"), docs.drop("text")).collect()
    out = [r["predicted"] == (r["doc_id"] < 300) for r in rows if r["held_out"]]
    assert len(out) > 100 and sum(out) / len(out) > 0.97


def test_interactions_are_learned():
    r = np.random.default_rng(7)
    x = r.random((3000, len(quality.NAMES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (2, 5) in [(a, b) for a, b, _ in model.pairs]
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_license_notices_with_edits():
    n, base, found = licenses.scan("Relesed under teh MIT License. CC BY-SA, cc by cc by; General Public License")
    assert n == 15 and [b["word"] for b in base if b["label"] == "cc-by"] == [5, 8, 10]
    assert [f["label"] for f in found if f["edits"]] == ["mit"] and [b["label"] for b in base][-1] == "gpl"
    assert licenses.scan("we released under the bit lichens")[2] == [] or licenses.scan("we released under the bit lichens")[2][0]["edits"] <= 3
    assert licenses.scan("the stone of the amber river and the lantern")[1:] == ([], [])


def test_main_text_of_pages():
    page = """<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav>
      <div class="cookie-notice">We use cookies on this site and on the others of it</div>
      <main><h1>A &amp; B</h1><p>First   of the <b>paragraphs</b>,<br>that goes on.<p>Short.<aside>by the way</aside>
      <form><input>Your mail</form><div id="comments"><p>I am one of the readers and this is what I think of it</p></div></main>
      <footer>&copy; us</footer><script>var t = "</p>";</script></body>"""
    assert html.main_text(page) == "A & B\nFirst of the paragraphs, that goes on.\nShort."
    assert html.main_text("<p>" + "of the and in to a " * 20 + "</p><p>Short.</p><ul><li><a href=x>Link</a></li></ul>").endswith("\nShort.")


def test_audio_round_trip_and_blocks(monkeypatch):
    payload = bytes(random.Random(8).randrange(256) for _ in range(64 * 900))
    assert media.unwav(media.wav(payload)) == payload
    samples = np.frombuffer(payload, np.uint8)
    mels, level = media.log_mel(samples)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 37)
    again = media.log_mel(samples)
    assert np.abs(mels - again[0]).max() <= 0.011 and len(level) == len(again[1])
    assert media.active_spans(np.array([-20.0, -1, 0, -5, -9, -9, -1])) == [(1, 4), (6, 7)]
    stream = pa.ipc.open_stream(media.tensor_stream(mels)).read_all()
    cube = stream.column("patch").combine_chunks().to_numpy_ndarray()
    assert cube.shape[1:] == (media.PATCH, media.MELS) and np.allclose(cube.reshape(-1, media.MELS)[: len(mels)], mels)


def test_cuts_are_released(spark):
    df = common.materialise(spark.range(3))
    assert df.count() == 3
    common.release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(common.cuts_folder(spark)).count()
