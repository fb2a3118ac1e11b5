"""The corpus pipeline against plain versions of its stages, each on its own input."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from shardmend.llm import packing, quality
from shardmend.llm.common import cuts_folder

VOCABULARY = [a + b for a in "ka lo mi ne ru sa to vi".split() for b in "b d f g l m n p r s t".split()]


def prose(r, n):
    return " ".join(r.choice(VOCABULARY) + (str(r.randrange(9)) if r.random() < 0.5 else "") for _ in range(n))


def edited(r, text, rate):
    return " ".join(r.choice(VOCABULARY) + "x" if r.random() < rate else w for w in text.split(" "))


def plain_lines(rows):
    seen, out = [], []
    for i, t, *rest in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        kept = []
        for line in ("" if t is None else t).split("\n"):
            own = set(line.split())
            if not own or not any(100 * len(own & o) >= 80 * len(own | o) for o in seen):
                kept.append(line)
            if own:
                seen.append(own)
        t = None if t is None else "\n".join(kept)
        out.append((i, t, *rest[:-1], None if t is None else len(t)))
    return out


def plain_near(rows, k=2):
    sets = []
    for _, t, *_ in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for a, i in enumerate(order):
        for j in order[a + 1 :]:
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)), key=order.index)
                root[y] = x
    return [r for i, r in enumerate(rows) if find(i) == i]


def draw(seed, row):
    key = str(row[0]) if row[0] is not None else "text " + hashlib.md5((row[1] or "").encode()).hexdigest()
    return int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52


def plain_mix(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s)))}
    left, open_, target = 1.5 * sum(size.values()), set(size), {}
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2.0 * size[s] for s in full} if full else share
        left -= sum(2.0 * size[s] for s in full)
        open_ = open_ - full if full else set()
    out = []
    for r in rows:
        rate = target[r[3]] / size[r[3]] if size[r[3]] else 0.0
        out += [r] * (int(rate) + (draw("mix-1", r) < rate - int(rate)))
    return out


def least_padding(lengths, buckets):
    have = sorted(Counter(lengths).items())
    best = {0: 0}
    for _ in range(buckets):
        new = dict(best)
        for a, cost in best.items():
            for b in range(a + 1, len(have) + 1):
                c = cost + sum((have[b - 1][0] - n) * k for n, k in have[a:b])
                new[b] = min(new.get(b, c), c)
        best = new
    return best[len(have)]


def test_whole_pipeline_by_plain_stages(spark, tmp_path):
    r = random.Random(31)
    texts = [prose(r, r.choice([6, 25, 60])) + "\n" + prose(r, 30) for _ in range(50)]
    rows = [(i, t, "en", r.choice(["s0", "s1", "s2", None]), len(t)) for i, t in enumerate(texts)]
    # Near copies that keep their lines: each differs enough from the first for the line stage, on one long line or many short ones.
    rows += [(100 + i, texts[0].split("\n")[0] + "\n" + prose(r, 12), "en", "s0", 1) for i in range(3)]
    longer = [" ".join(prose(r, 60).split()) for _ in range(4)]
    rows += [(120 + i, "\n".join(" ".join(t.split()[k : k + step]) for k in range(0, 60, step)), "en", "s1", 1) for i, (t, step) in enumerate((t, s) for t in longer for s in (5, 60, 15))]
    rows += [(150, "", "en", "s1", 0), (151, None, None, None, None), (152, " \n\t", "en", "s2", 3), (None, prose(r, 20), "en", "s2", 1), (None, None, "en", "s0", None)]
    rows += [(200 + i, " ".join(w + "$$$" for w in prose(r, 40).split()), "en", "s2", 1) for i in range(30)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(x[0], int(x[0] < 200), 0) for x in rows if x[0] is not None and x[0] not in (150, 151, 152)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    as_rows = lambda df: Counter(tuple(x) for x in df.collect())

    # The classifier: rows whose scores, by the operator on single columns, reach a half.
    scored = Counter((x["doc_id"], x["predicted"]) for x in quality.quality_scores(docs, labels).collect())
    first = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    kept = list(as_rows(first).elements())
    assert Counter(x[0] for x in kept) == Counter(i for (i, p), n in scored.items() for _ in range(n) if p)
    assert {i for i in range(50)} <= {x[0] for x in kept} and not any(x[0] and x[0] >= 200 for x in kept)

    expect = plain_lines(kept)
    second = spark.createDataFrame(kept, kind)
    assert as_rows(corpus_pipeline.drop_repeated_lines(spark, second, str(tmp_path))) == Counter(expect)
    third = plain_near(expect)
    assert as_rows(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(expect, kind), str(tmp_path))) == Counter(third)
    # The stage by itself, on copies that no line stage has touched.
    loose = [(i, x, "en", "a", 1) for i, x in enumerate(edited(r, t, rate) for t in longer for rate in (0, 0, 0.01, 0.03, 0.1, 0.3))]
    assert as_rows(corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(loose, kind), str(tmp_path))) == Counter(plain_near(loose)) and len(plain_near(loose)) < len(loose)
    fourth = plain_mix(third)
    assert as_rows(corpus_pipeline.mix_sources(spark, spark.createDataFrame(third, kind), str(tmp_path))) == Counter(fourth)

    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == [*docs.columns, "n_tokens", "bucket", "bucket_len", "batch", "slot", "padding"]
    got = [x.asDict() for x in done.collect()]
    assert Counter(tuple(x[c] for c in docs.columns) for x in got) == Counter(fourth)
    assert all(x["n_tokens"] == len((x["text"] or "").split()) and x["padding"] == x["bucket_len"] - x["n_tokens"] for x in got)
    assert sum(x["padding"] for x in got) == least_padding([x["n_tokens"] for x in got], packing.BUCKETS)
    for b in {x["bucket"] for x in got}:
        own = sorted((x for x in got if x["bucket"] == b), key=lambda x: (x["batch"], x["slot"]))
        per = max(1, packing.BUDGET // max(1, own[0]["bucket_len"]))
        assert [(x["batch"], x["slot"]) for x in own] == [divmod(k, per) for k in range(len(own))]
        draws = [draw("pack-1", (x["doc_id"], x["text"])) for x in own]
        assert draws == sorted(draws) and len({x["bucket_len"] for x in own}) == 1


def test_runs_leave_only_what_results_read(spark, tmp_path):
    import os

    r = random.Random(32)
    rows = [(i, prose(r, 40), "en", "a", 1) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = cuts_folder(spark)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    done = corpus_pipeline.run(spark, str(tmp_path))
    left = set(os.listdir(folder)) - before
    assert len(left) <= 3 and done.count() > 0


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_stages_take_empty_tables_and_any_names(spark, tmp_path, stage):
    names = "_quality _gone _u _rank _length _bucket _mix_size _mix_own _id bucket row own place _place _shard target source_size k".split()
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", 3, *("mine" for _ in names)) for i, t in enumerate(["one two three", "", None, "four five"])], kind)
    out = stage(spark, docs, str(tmp_path))
    assert out.columns[: len(docs.columns)] == docs.columns and all(x[n] == "mine" for x in out.select(*[f"`{n}`" for n in names if n != "bucket"]).collect() for n in names if n != "bucket")
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
