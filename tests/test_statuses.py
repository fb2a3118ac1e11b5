"""Statuses of nodes, the catalogue of steps, and runs from stored prefixes, against plain runs step by step."""

import pytest
from pyspark.sql import functions as F

from shardmend.functions.hashes import payload_hash
from shardmend.functions.prng import Pcg32, turn_seed
from shardmend.operators.seeded_steps import STEPS, try_step
from shardmend.plans import prefix_store, step_catalogue
from shardmend.plans.presets import STORIES, story
from shardmend.plans.recipe import Patch, Recipe, Repeat, Step, apply_recipe
from shardmend.plans.statuses import node_rows, run_nodes
from shardmend.sources import markers

PAYLOADS = [markers.fake_photo(i, 400 + 300 * i) for i in range(6)] + [b"", b"no photo at all", None]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cuts")))
    return spark.createDataFrame(list(enumerate(PAYLOADS)), "ord long, bytes binary").withColumn("nodes", F.lit("clash"))


def plain(data, seed):
    """Bytes and statuses after the recipe of the test below."""
    out = []

    def run(name, own, params=None):
        nonlocal data
        data, error = try_step(name, data, Pcg32(own + seed), params or {})
        return error

    out.append(("ok", None))
    data = data[: len(data) * 9 // 10]
    error = run("sof_dims", 7)
    out.append(("error" if error else "ok", error))
    out.append(("disabled", None))
    out.append(("unavailable", 'step "unheard_of" is not available yet'))
    error = None
    for turn in range(3):
        for name, own in (("zero_run", 5), ("cbcr_swap", 6)):
            error = error or run(name, turn_seed(own, 11, turn), {"length": 3})
    out.append(("error" if error else "ok", error))
    return data, out


def test_statuses_by_a_plain_run(spark, rows):
    recipe = Recipe(
        [
            Step("truncate", {"percent": 90}), Step("sof_dims", {}, 7), Step("bitflip", {}, 8, enabled=False), Step("unheard_of"),
            Repeat([Step("zero_run", {"length": 3}, 5), Step("cbcr_swap", {}, 6)], 3, seed=11), Patch("gone", [(0, b"x")]),
        ]
    )
    done = {r["ord"]: r for r in run_nodes(rows, recipe, seed="ord").collect()}
    for i, data in enumerate(PAYLOADS):
        if data is None:
            assert done[i]["bytes"] is None and done[i]["nodes"] is None
            continue
        expect, statuses = plain(data, i)
        assert bytes(done[i]["bytes"]) == expect
        assert [(n["status"], n["error"]) for n in done[i]["nodes"]] == [*statuses, ("stale", None)]
        assert [n["node"] for n in done[i]["nodes"]] == list(range(6)) and done[i]["nodes"][-1]["size"] == len(expect) and done[i]["nodes"][2]["size"] is None
    known = rows.where("ord = 1").select(payload_hash(F.col("bytes")).alias("h")).first()["h"]
    patched = node_rows(run_nodes(rows, Recipe([Patch(known, [(1, b"zz")])])), "ord")
    assert {(r["ord"], r["status"]) for r in patched.collect()} == {(i, "ok" if i == 1 else "stale") for i in range(8)}


def test_bad_parameters_and_faults_of_steps(monkeypatch):
    g = Pcg32(1)
    assert try_step("bitflip", b"abc", g, {"rate": "much"}) == (b"abc", "parameter rate can't be 'much'")
    assert try_step("splice", b"abc", g, {}) == (b"abc", "no other payload to take from")
    assert try_step("cbcr_swap", b"abc", g, {})[1] == "no such segment"
    monkeypatch.setitem(STEPS, "faulty", lambda data, g: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        try_step("faulty", b"abc", g, {})


def test_catalogue_and_clamps():
    known = step_catalogue.CATALOGUE
    assert known["splice"]["pool"] and known["splice"]["random"] and known["strip_exif"]["layer"] == "meta" and not known["sof_dims"]["random"]
    step = step_catalogue.clamped(Step("base64_damage", {"lines": 1000, "mode": "burn", "own": 5}, 3))
    assert step == Step("base64_damage", {"lines": 100, "own": 5}, 3)
    assert step_catalogue.clamped(Step("truncate", {"percent": -3, "byte": 2.5})).params == {"percent": 0.0, "byte": 3}
    assert step_catalogue.clamped(Step("unheard_of", {"x": 1e9})).params == {"x": 1e9}
    for name in STORIES:
        for bad in (0, 0.3, 1):
            for s in story(name, bad, 7).nodes:
                assert s == step_catalogue.clamped(s) and s.id in known


def test_marks_by_hand(spark):
    step = lambda uid, id_, on="true": f'{{"uid":"{uid}","id":"{id_}","enabled":{on}}}'
    recipes = [
        [step("a", "truncate"), step("b", "requantize"), step("c", "coeff_kill")],
        [step("a", "truncate"), step("b", "strip_exif"), step("c", "coeff_kill")],
        [step("a", "truncate", "false"), step("b", "requantize")],
        [f'{{"uid":"r","type":"repeat","times":5,"children":[{step("a", "requantize")},{step("b", "bitflip")}]}}'],
        ['{"uid":"p","type":"patch"}', step("a", "resave"), step("b", "unheard_of"), step("c", "resave")],
        [],
    ]
    df = spark.createDataFrame([(i, '{"steps":[' + ",".join(r) + "]}") for i, r in enumerate(recipes)] + [(9, None), (10, "no json")], "recipe_id long, json string")
    assert {tuple(r) for r in step_catalogue.reencode_marks(df).collect()} == {(0, "b"), (1, "c"), (3, "a"), (4, "a")}


def test_runs_from_stored_prefixes(spark, rows, tmp_path):
    recipe = Recipe([Step("truncate", {"percent": 90}), Step("bitflip", {"rate": 50}, 3), Step("sof_dims", {}, 4), Step("byte_patch", {"at": 1, "hex": "AA"})])
    store = prefix_store.PrefixStore(spark, str(tmp_path / "store"))
    source = F.concat_ws(":", F.hex(F.sha2("bytes", 256)), "ord")
    run = lambda df, r, keep: prefix_store.run_stored(df.drop("nodes"), r, store, "ord", source, keep, seed="ord")
    first = {r["ord"]: r for r in run(rows.where("ord < 4"), Recipe(recipe.nodes[:2]), [1]).collect()}
    assert all(r["start"] == 0 for r in first.values())
    second = {r["ord"]: r for r in run(rows.where("ord <> 2"), recipe, [2, 3]).collect()}
    assert {i: r["start"] for i, r in second.items()} == {i: 2 if i < 4 else 0 for i in range(len(PAYLOADS)) if i != 2}
    third = {r["ord"]: r for r in run(rows, recipe, [3]).collect()}
    # Those that fail at the third node have nothing stored from there on, so that it runs again; nor have null payloads.
    failed = {i for i, r in second.items() if r["nodes"] and any(n["status"] == "error" for n in r["nodes"])}
    assert failed == {6, 7}
    assert {i: r["start"] for i, r in third.items()} == {i: 2 if i == 2 else 0 if i in failed or i == 8 else 4 for i in range(len(PAYLOADS))}
    whole = {r["ord"]: r["bytes"] for r in apply_recipe(rows, recipe, seed="ord").collect()}
    assert {i: r["bytes"] for i, r in second.items()} == {i: b for i, b in whole.items() if i != 2}
    assert {i: r["bytes"] for i, r in third.items()} == whole
    assert [n["status"] for n in third[1]["nodes"]] == ["cached"] * 4 and [n["status"] for n in second[1]["nodes"]] == ["cached", "cached", "ok", "ok"]
    kept = store.read(recipe)
    assert kept.count() == kept.select("key").distinct().count() == len(PAYLOADS) - 3
