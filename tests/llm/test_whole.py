"""Whole jobs: places where an operator once did less than its method says."""

import random

import corpus_pipeline
from shardmend.llm import html, licenses, linededup, queries


def without_matches(docs):
    """Texts by doc_id without the lines that match any earlier line, by brute force; only lines without words stay."""
    seen, out = [], {}
    for i, text in sorted(docs.items()):
        kept = []
        for line in text.split("\n"):
            own = set(line.split())
            if not own or not any(100 * len(own & o) >= 80 * len(own | o) for o in seen):
                kept.append(line)
            if own:
                seen.append(own)
        out[i] = "\n".join(kept)
    return out


def test_short_lines_by_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(linededup, "HOT", 20)
    monkeypatch.setattr(linededup, "LOOK_ROWS", 64)
    r = random.Random(12)
    words = "read more home menu by next page top share".split()
    docs = {i: "\n".join(" ".join(r.choice(words) for _ in range(r.randrange(9))) for _ in range(6)) for i in range(40)}
    docs |= {50: "a1 b1 c1 d1\na1 b1 c1 d1 e1", 51: "a2 b2 c2 d2 e2\nd2 c2 b2 a2", 52: "one", 53: "one one  one", 54: "ha ha ha ha ha ha ha ha ha hi\n\n \nhi ha"}
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    expect = without_matches(docs)
    assert expect[50] == "a1 b1 c1 d1" and expect[51] == "a2 b2 c2 d2 e2" and expect[53] == "" and expect[54].endswith("\n\n ")
    got = queries.op6_line_dedup(spark, str(tmp_path)).collect()
    assert {x["doc_id"]: x["text"] for x in got} == expect
    stage = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert {x["doc_id"]: x["text"] for x in stage.collect()} == expect


PROSE = "This is the text of the page and it is about the river and the stones that are in it."


def test_signs_do_not_drop_pages():
    article = f'<article><h1 id="search-results">Title</h1><h2 id="comments-on-the-law">Law</h2><p>{PROSE}</p></article>'
    whole = f"Title\nLaw\n{PROSE}"
    for sign in ("no-sidebar", "has-sidebar", "right-sidebar"):
        assert html.main_text(f'<html class="{sign}"><body class="{sign}">{article}</body></html>') == whole
    assert html.main_text(f'<body><div class="content-with-sidebar">{article}<div>Links</div></div></body>') == whole
    assert html.main_text(f'<body><div class="content-with-sidebar"><p>{PROSE}</p></div></body>') == PROSE
    assert html.main_text(f'<body><p>{PROSE}</p><div class="content-ad">Buy now</div><div class="ad">{PROSE}</div></body>') == PROSE


def test_markup_loses_no_text():
    after = "<p>Text after it.</p>"
    assert html.main_text(f"<body><script>for(i=0;i<n.length;i++)f(i);</script>{after}<script>x</script></body>") == "Text after it."
    assert html.main_text(f"<html><head><title>t</title><meta charset=utf-8><noscript><p>off</p></noscript><body>{after}") == "Text after it."
    assert html.main_text(f"<head><title>t</title>{after}") == "Text after it."
    assert html.main_text("<head><title>a <b</title>Bare text") == "Bare text"
    assert html.main_text(f"<p>Before.</p><img alt=it's src=x>{after}<p>It's more.</p>") == "Before.\nText after it.\nIt's more."
    assert html.main_text("<p>" + "<i don't>a</i> " * 60 + '<b title="x > y">end</b></p>') == " ".join(["a"] * 60 + ["end"])
    assert html.main_text("<a x=\">\"" * 50_000) is not None


def test_notices_before_a_better_one_count():
    text = "mozila public license or mozilla public license or mozilla publik license"
    assert [(f["first_word"], f["last_word"], f["edits"]) for f in licenses.scan(text)[2]] == [(0, 2, 1), (4, 6, 0), (8, 10, 1)]
    back_to_back = " ".join(["mozila public license", "mozilla public license"] * 20)
    assert [(f["first_word"], f["edits"]) for f in licenses.scan(back_to_back)[2]] == [(3 * i, 1 - i % 2) for i in range(40)]
