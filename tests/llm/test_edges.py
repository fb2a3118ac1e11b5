"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from shardmend.llm import chat, fingerprint, html, licenses, linededup, media, mixing, neardup, packing, quality

WORDS = "the of and stone river quick amber violet copper maple signal lantern harbour meadow thunder glass".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(n))


LONG = "\n".join(prose(i, 60) for i in range(400))
ROWS = [
    (1, prose(1, 40), "en", "a"),
    (2, prose(1, 40), "en", "a"),
    (2, prose(1, 40), "en", "a"),
    (3, None, None, None),
    (4, "", "en", "b"),
    (5, " \n\t ", "en", None),
    (6, LONG, "en", "c"),
    (7, LONG + " end", "en", "c"),
    (None, prose(2, 30), "en", "b"),
    (None, None, None, None),
    (8, "one", "en", "é"),
    (9, "one", "en", "b"),
    (10, "\n\n" + prose(3, 20) + "\n" + prose(3, 20), None, "b"),
]
CLASHES = "size target taken rank regs n cid bucket batch features d l sure token part tail _mix score wav payload copies bound p.q".split()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (3, None, 1), (None, 1, 0), (6, 1, 0), (4, 0, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")


def by_row(df):
    return [r.asDict() for r in df.collect()]


def test_fingerprints(docs):
    rows = by_row(fingerprint.fingerprints(docs))
    assert len(rows) == len(ROWS)
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["fingerprint"] == of[2]["fingerprint"] != ""
    assert of[3]["fingerprint"] == of[4]["fingerprint"] == "" and of[4]["n_chars"] == 0
    assert of[2]["near_next"] == 1.0 and of[3]["near_next"] == 0.0
    assert of[7]["near_next"] > 0.9
    assert all(0 <= r[c] <= 1 for r in rows for c in ("near_edited", "near_next"))
    assert by_row(fingerprint.fingerprints(docs.limit(0))) == []


def test_packing(docs):
    carried = by_row(packing.packed(docs, docs.columns, buckets=3, budget=100))
    assert all(r["bucket"] == r["batch"] == "clash" for r in carried)
    rows = [r["_pack"].asDict() for r in carried]
    assert len(rows) == len(ROWS)
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").split()) for _, t, *_ in ROWS)
    assert all(r["padding"] >= 0 and r["n_tokens"] <= r["bucket_len"] for r in rows)
    slots = [(r["bucket"], r["batch"], r["slot"]) for r in rows]
    assert len(set(slots)) == len(slots)
    assert by_row(packing.packed(docs.limit(0), ["doc_id"])) == []


def test_mixing(docs):
    plan = by_row(mixing.mixture(docs))
    assert len(plan) == len(ROWS) and all(r["size"] == "clash" for r in plan)
    assert all(r["_mix"]["taken"] == r["_mix"]["size"] * r["_mix"]["copies"] <= 2 * r["_mix"]["size"] for r in plan)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["_mix"]["copies"] for r in plan)
    assert by_row(mixing.mixture(docs.limit(0))) == []


def test_near_duplicates(docs):
    rows = by_row(neardup.near_duplicates(docs, 2))
    assert len(rows) == len(ROWS)
    of = {r["doc_id"]: r for r in rows}
    assert of[2]["component_id"] == 1 and not of[2]["kept"]
    assert of[7]["component_id"] == 6
    assert of[3]["kept"] and of[3]["n_shingles"] == 0 and of[4]["component_id"] == 4
    assert of[9]["component_id"] == 8 and of[8]["n_shingles"] == 1
    assert of[None]["kept"] and of[None]["component_id"] is None
    kept = neardup.deduplicated(docs, 5)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "3", "4", "5", "6", "8", "10", "None", "None"])
    assert by_row(neardup.near_duplicates(docs.limit(0), 2)) == []


def test_rows_without_ids_are_told_apart(spark):
    text = prose(5, 40)
    rows = [(None, text), (None, text), (None, prose(6, 40)), (3, text), (None, None), (4, prose(7, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long")).repartition(3)
    kept = [(x["doc_id"], x["text"]) for x in neardup.deduplicated(docs, 2).collect()]
    assert sorted(kept, key=str) == sorted([(3, text), (None, rows[2][1]), (None, None), (4, rows[5][1])], key=str)
    lines = [(x["doc_id"], x["text"]) for x in linededup.without_repeated_lines(docs).collect()]
    assert sorted(lines, key=str) == sorted([(None, text), (None, ""), (None, rows[2][1]), (3, ""), (None, None), (4, rows[5][1])], key=str)
    alone = docs.where("doc_id IS NULL")
    assert neardup.deduplicated(alone, 2).count() == 3 and linededup.without_repeated_lines(alone).where("text = ''").count() == 1


def test_ids_must_be_numbers_where_they_order_or_link(spark):
    named = spark.createDataFrame([("a", "some text")], "doc_id string, text string")
    for run in (fingerprint.fingerprints, lambda d: neardup.near_duplicates(d, 2), neardup.deduplicated, linededup.without_repeated_lines):
        with pytest.raises(ValueError, match="doc_id must be a whole number"):
            run(named)


def test_quality(docs, labels):
    rows = by_row(quality.quality_scores(docs, labels))
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert {r["doc_id"]: r["held_out"] for r in rows}[None] is False
    assert by_row(quality.quality_scores(docs.limit(0), labels)) == []
    assert {r["score"] for r in by_row(quality.quality_scores(docs, labels.limit(0)))} == {0.5}
    assert quality.accepted(docs, labels).columns == docs.columns


def test_line_dedup(docs):
    out = linededup.without_repeated_lines(docs)
    rows = by_row(out)
    assert len(rows) == len(ROWS) and out.columns == [*docs.columns, "_lines"]
    of = {r["doc_id"]: r for r in rows}
    assert of[1]["text"] == ROWS[0][1] and of[2]["text"] == "" and of[2]["n_chars"] == 0
    assert of[3]["text"] is None and of[3]["n_chars"] is None and of[4]["text"] == ""
    assert of[6]["text"] == LONG and of[7]["text"] == ""
    assert of[10]["text"] == "\n\n" + prose(3, 20) and of[10]["_lines"]["n_removed"] == 1
    assert of[8]["text"] == "one" and of[9]["text"] == ""
    assert by_row(linededup.without_repeated_lines(docs.limit(0))) == []


def test_licenses(docs):
    rows = by_row(licenses.license_report(docs))
    assert len(rows) == len(ROWS) and {r["labels"] for r in rows} == {""} and {r["first_word"] for r in rows} == {None}
    assert by_row(licenses.license_report(docs.limit(0))) == []


def test_chat(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "bot", "yes"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yes"), (3, 2, "user", None), (4, None, None, ""), (4, None, None, ""), (None, 0, "user", "x"), (5, 0, "user", "hi"), (5, 1, "bot", "no"), (6, 0, "user", "hi"), (6, 1, "bot", "no")]
    df = spark.createDataFrame([(*t, "clash", "clash") for t in turns], "conv_id long, turn long, role string, text string, k string, line string")
    rows = {r["conv_id"]: r for r in by_row(chat.rendered(df))}
    assert set(rows) == {3, 4, 5, None}
    assert rows[3]["text"] == "<|user|>\nhi\n<|end|>\n<|bot|>\nyes\n<|end|>\n<|user|>\n\n<|end|>"
    assert rows[4]["n_turns"] == 2 and rows[5]["n_copies"] == 2
    assert by_row(chat.rendered(df.limit(0))) == []


def test_html(spark):
    pages = [(1, "u", None), (2, None, ""), (None, "u", "<p>plain text here"), (2, None, ""), (4, "u", "<div>" * 3000 + "deep" + "</p>" * 50), (5, "u", "<script>never</script><title>t</title>")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string")
    rows = by_row(html.extracted(df))
    assert sorted(r["text"] for r in rows) == ["", "", "", "", "deep", "plain text here"]
    assert by_row(html.extracted(df.limit(0))) == []


def test_media(docs):
    rows = by_row(media.media_digest(docs))
    assert len(rows) == len(ROWS)
    of = {r["doc_id"]: r for r in rows}
    assert of[3]["payload_bytes"] == 64 and of[3]["n_bytes"] == 0 and of[3]["media_sha256"] == of[4]["media_sha256"]
    assert of[8]["feature"] == of[9]["feature"]
    assert all(r["payload_bytes"] % 64 == 0 and 0 <= r["payload_bytes"] - r["n_bytes"] <= 64 for r in rows)
    assert by_row(media.media_digest(docs.limit(0))) == []
