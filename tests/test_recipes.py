"""The recipe format, hashes, steps that recipes name, and steps on segments, by plain versions and hand vectors."""

import json
import random

import pytest
from pyspark.sql import functions as F

from shardmend.functions.hashes import has_hash, payload_hash, text_hash
from shardmend.functions.prng import Pcg32
from shardmend.operators import marker_steps, patterns, seeded_steps
from shardmend.plans.presets import STORIES, seed_for, story
from shardmend.plans.recipe import Patch, Recipe, Repeat, Step, apply_recipe, needs_other, parse_recipe, plan_keys, unrolled, write_recipe
from shardmend.sources import markers

DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def base36(n):
    return DIGITS[n] if n < 36 else base36(n // 36) + DIGITS[n % 36]


def plain_text_hash(s):
    a, b = 0x811C9DC5, 0x01000193 ^ 0x5BD1E995
    for c in map(ord, s):
        a, b = (a ^ c) * 0x01000193 & 0xFFFFFFFF, (b ^ c) * 0x5BD1E995 & 0xFFFFFFFF
        b ^= b >> 15
    return base36(a) + base36(b)


def plain_payload_hash(data):
    a, b = 0x811C9DC5 ^ len(data), 0x9747B28C
    for c in data:
        a, b = (a ^ c) * 0x01000193 & 0xFFFFFFFF, ((b + c) * 0x5BD1E995 & 0xFFFFFFFF) ^ b >> 13
    return base36(a) + base36(b) + base36(len(data))


PAYLOADS = [b"", b"\x01\x02\x03", b"a\nb\r\n" * 9, bytes(range(256)), random.Random(5).randbytes(700)]


@pytest.fixture(scope="module")
def payloads(spark):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(PAYLOADS)], "ord long, bytes binary")


def test_hashes(spark, payloads):
    assert {r["ord"]: r["h"] for r in payloads.select("ord", payload_hash(F.col("bytes")).alias("h")).collect()} == {i: plain_payload_hash(b) for i, b in enumerate(PAYLOADS)}
    texts = ["", "a", "src:x|S\n", "é1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text_hash(F.col("t")).alias("h")).collect()
    assert {r["t"]: r["h"] for r in rows} == {t: plain_text_hash(t) for t in texts}
    base = plain_payload_hash(PAYLOADS[2])
    assert [r["ord"] for r in payloads.where(has_hash(F.col("bytes"), F.lit(base))).collect()] == [2]


NESTED = {
    "format": "any-recipe", "version": 1, "engine": "2", "source": "bundled:a",
    "steps": [
        {"type": "step", "id": "ransomware_partial", "params": {"kb": "1", "unknown": 3}, "seed": 7, "uid": "s1"},
        {"type": "repeat", "times": 900, "seed": 1, "enabled": False, "children": [{"type": "step", "id": "bitflip", "params": {}, "seed": 2}, {"type": "step", "id": 4}]},
        {"type": "repeat", "times": 0, "seed": 1, "children": [{"type": "step", "id": "tool_fill_pattern", "params": {"sectors": 1, "protect_header": False}, "seed": 2}]},
        {"type": "patch", "baseHash": "zz", "patches": [{"offset": 2, "bytes": [300, 1]}, {"offset": "x", "bytes": []}]},
        {"type": "note"}, None, {"type": "step", "id": "no_such_step", "params": {}},
    ],
}


def test_recipe_format(payloads):
    recipe = parse_recipe(json.dumps(NESTED))
    assert [type(n) for n in recipe.nodes] == [Step, Repeat, Repeat, Patch, Step] and recipe.source == "bundled:a"
    assert recipe.nodes[1].times == 500 and len(recipe.nodes[1].steps) == 1 and recipe.nodes[2].times == 1
    assert recipe.nodes[3].patches == [(2, bytes([44, 1]))]
    assert parse_recipe(write_recipe(recipe)) == recipe
    for bad in ("[]", "{}", '{"format": "other", "steps": []}'):
        with pytest.raises(ValueError):
            parse_recipe(bad)
    got = {r["ord"]: bytes(r["bytes"]) for r in apply_recipe(payloads, recipe).collect()}
    for i, b in enumerate(PAYLOADS):
        b = seeded_steps.ransomware(b, Pcg32(7), kb=1)
        (fill,) = [s for s in unrolled(recipe) if isinstance(s, Step) and s.id == "tool_fill_pattern"]
        assert got[i] == seeded_steps.tool_fill_pattern(b, Pcg32(fill.seed), sectors_each=1, protect_header=False)


def test_patches_hold_for_one_version(payloads):
    patch = Patch(plain_payload_hash(PAYLOADS[3]), [(1, b"\xaa"), (254, b"\xbb\xcc\xdd"), (900, b"\x01")])
    got = {r["ord"]: bytes(r["bytes"]) for r in apply_recipe(payloads, Recipe([patch])).collect()}
    b = PAYLOADS[3]
    assert got == dict(enumerate(PAYLOADS)) | {3: b[:1] + b"\xaa" + b[2:254] + b"\xbb\xcc"}


def test_keys_depend_on_pool_and_order(payloads):
    keys = lambda nodes, pool="": payloads.limit(1).select(plan_keys(Recipe(nodes), F.lit("s"), pool).alias("k")).first()["k"]
    a, b = Step("truncate", {"b": 1, "a": [2]}, 3), Step("splice", {}, 4)
    first = plain_text_hash('src:s|Struncate:3:{"a":[2],"b":1}')
    assert keys([a, b], "p") == [first, plain_text_hash(first + "|Ssplice:4:{}|pool:p")]
    assert keys([a, b], "p")[0] == keys([a, b], "q")[0] and keys([a, b], "p")[1] != keys([a, b], "q")[1]


def test_stories(payloads):
    assert story("ransomware", 0.5, 3).nodes[1].params["skip"] == story("ransomware", 0.5, 3).nodes[0].params["kb"] * 1024
    assert [n.id for n in story("email-1998", 0.4, 1).nodes] == ["base64_damage"] and [n.id for n in story("email-1998", 0.6, 1).nodes] == ["seven_bit"]
    assert [n.seed for n in story("dead-sd", 1, 9).nodes] == [seed_for(9, i) for i in (1, 2, 3)]
    assert needs_other(story("dead-sd", 1, 9)) and not needs_other(story("dead-sd", 0, 9))
    with_other = payloads.withColumn("other", F.lit(bytearray(markers.fake_photo(1, 9000))))
    for name in STORIES:
        assert apply_recipe(with_other, story(name, 1.0, 5), seed="ord", other="other").count() == len(PAYLOADS)


def test_steps_that_do_not_apply_pass_their_input_on(payloads):
    g = lambda: Pcg32(1)
    for name in seeded_steps.STEPS:
        assert isinstance(seeded_steps.run_step(name, b"no photo", g(), {"count": "x"}, b"neither"), bytes)
    assert seeded_steps.run_step("no_such", b"abc", g(), {}) == b"abc"
    assert seeded_steps.run_step("splice", b"abc", g(), {}, None) == b"abc"
    assert seeded_steps.run_step("byte_insert", b"a" * 50, g(), {"hex": "CA FE F"}) .count(b"\xca\xfe") == 1


def test_walk_passes_noise():
    head = b"\xff\xd8" + b"\x12\xff\x05" + b"\xff\xff\xff\xfe\x00\x04ab" + b"\xff\xdd\x00\x00" + b"\xff\xd9tail"
    found = list(markers.segments(head))
    assert [(s["name"], s["offset"], s["length"]) for s in found] == [("SOI", 0, 2), ("COM", 7, 6), ("DRI", 13, 4), ("EOI", 17, 2)]
    assert markers.scan_range(b"\xff\xd8\xff\xda\x00\x02abc") == (6, 9)
    assert markers.body_start(b"\xff\xd8\xff\xda\x00\x02abc") == 6 and markers.body_start(b"x" * 700) == 624


def test_samples_without_repeats(spark):
    rows = spark.createDataFrame([(1, 10), (2, 3), (3, 0)], "seed long, size int")
    got = {r["seed"]: r["picked"] for r in patterns.seeded_sample(rows, "seed", "size", 4).collect()}
    assert len(set(got[1])) == 4 and sorted(got[2]) == [0, 1, 2] and got[3] == []
    assert got[1] == marker_steps.drawn(Pcg32(1), 10, 4)


def test_scrambled_pages_change_places():
    data = bytes(1000) + b"".join(bytes([i]) * 2048 for i in range(1, 9))
    out = seeded_steps.chipoff_xor(data, Pcg32(3), strength=0, start=0, shuffle=True, protect_header=False, page_kb=2)
    assert len(out) == len(data) and sorted(out) == sorted(data)


def test_batches_of_payloads_are_bounded(spark, tmp_path):
    """Python tasks hold no more than a bounded batch, by rows and by bytes, whatever a table holds."""
    import pyarrow as pa

    from shardmend import catalogue

    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    spark.range(3000).selectExpr("id AS doc_id", "repeat('x', IF(id % 100 = 0, 500000, 10)) AS text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")

    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    found = catalogue.payloads(spark, str(tmp_path)).mapInArrow(seen, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 3000 and max(r["n"] for r in found) <= 512 and max(r["size"] for r in found) < 3_000_000


def test_prefix_keys_are_made_of_the_key_before(spark):
    """Each key is made once: the plan grows with the nodes, not with their square."""
    from pyspark.sql import functions as F

    from shardmend.plans.recipe import Recipe, Step, plan_keys

    size = lambda n: len(spark.range(1).select(plan_keys(Recipe([Step("truncate", {"percent": k}) for k in range(n)]), F.lit("a")))._jdf.queryExecution().analyzed().toString())
    assert size(24) < 6 * size(6)


def test_stories_carry_other_payloads_only_where_steps_take_them(spark):
    """Results are those of every story over payloads with donors; only stories with a donor step join donors."""
    from shardmend import catalogue
    from shardmend.operators import donors

    sf = "/root/testdata/sf0.001"
    found = catalogue.preset_stories(spark, sf)
    takes = [name for name in STORIES if needs_other(story(name, 0.5, 7))]
    assert 0 < len(takes) < len(STORIES)
    pool = donors.with_donor(catalogue.payloads(spark, sf).withColumnRenamed("doc_id", "ord")).withColumnRenamed("ord", "doc_id")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins(found) == joins(pool) * len(takes) > 0
    want = {}
    for name in STORIES:
        rows = apply_recipe(pool, story(name, 0.5, 7), seed="doc_id", other="other").select("doc_id", F.length("bytes").alias("n_out"), catalogue.digest().alias("digest")).collect()
        want |= {(r["doc_id"], name): (r["n_out"], r["digest"]) for r in rows}
    rows = found.collect()
    assert len(rows) == len(want) and {(r["doc_id"], r["story"]): (r["n_out"], r["digest"]) for r in rows} == want
