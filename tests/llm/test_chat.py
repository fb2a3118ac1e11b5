"""Collapse of cumulative snapshots against a plain version."""

import random

from shardmend.llm import chat


def plain(turns):
    """(conv_id, n_turns, n_copies, text) of maximal conversations; turns without an id are conversations of their own."""
    found, alone = {}, []
    for c, k, role, text in turns:
        if c is None:
            alone.append([(role, text)])
        else:
            found.setdefault(c, []).append((k is not None, k or 0, role is not None, role or "", text is not None, text or ""))
    whole = [(c, tuple((r if has else None, t if some else None) for _, _, has, r, some, t in sorted(rows))) for c, rows in found.items()]
    whole += [(None, tuple(x)) for x in alone]
    proper = {x[:k] for _, x in whole for k in range(1, len(x))}
    out = {}
    for c, x in whole:
        if x not in proper:
            out.setdefault(x, []).append(c)
    line = lambda r, t: f"<|{r or ''}|>\n{t or ''}\n<|end|>"
    return sorted(((min((c for c in ids if c is not None), default=None), len(x), len(ids), "\n".join(line(*y) for y in x)) for x, ids in out.items()), key=str)


def test_snapshots_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    r = random.Random(41)
    turns, conv = [], 0
    for _ in range(25):
        base = [(r.choice(["user", "bot", None]), r.choice(["hi", "yes", "", None, "no"])) for _ in range(r.choice([1, 2, 5, 30]))]
        for _ in range(r.randrange(1, 4)):
            conv += 1
            turns += [(conv, 3 * k, role, text) for k, (role, text) in enumerate(base[: r.randrange(1, len(base) + 1)])]
    turns += [(900, k, "user", f"t{k}") for k in range(600)] + [(901, k, "user", f"t{k}") for k in range(599)]
    turns += [(None, 1, "user", "hi"), (None, 9, "user", "hi"), (None, None, None, None), (None, 2, "user", "t0"), (None, 4, "bot", "alone")]
    r.shuffle(turns)
    rows = chat.rendered(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((tuple(x) for x in rows), key=str) == plain(turns)


def test_conversations_of_any_id_type(spark):
    rows = [("a", 0, "user", "x"), ("b", 0, "user", "x"), (None, 0, "user", "x")]
    got = chat.rendered(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()
    assert [(x["conv_id"], x["n_copies"]) for x in got] == [("a", 3)]
