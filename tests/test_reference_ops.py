"""Byte steps, seeded damage, donors, cards, structure, clips and streams by hand vectors and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from shardmend import catalogue
from shardmend.functions.prng import Pcg32, mix32
from shardmend.operators import byte_steps, cards, coefficients, donors, seeded_steps
from shardmend.plans.recipe import Recipe, Repeat, Step, apply_recipe, parse_recipe, plan_keys, unrolled
from shardmend.sources import clips, markers
from shardmend.sources.files import classified
from shardmend.streaming import live

PAYLOADS = [b"", b"a", b"a\nb\r\nc\n\n", bytes(range(256)) * 5, b"\x80\xff\n\x00\r\n", random.Random(1).randbytes(5000)]


@pytest.fixture(scope="module")
def payloads(spark):
    return spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(PAYLOADS)], "ord long, bytes binary")


def applied(payloads, step):
    return {r["ord"]: bytes(r["b"]) for r in payloads.select("ord", step(F.col("bytes")).alias("b")).collect()}


def test_byte_steps(payloads):
    for i, b in applied(payloads, byte_steps.seven_bit).items():
        low = len(PAYLOADS[i]) * 30 // 100
        assert b == PAYLOADS[i][:low] + bytes(x & 127 for x in PAYLOADS[i][low:])
    for i, b in applied(payloads, byte_steps.ftp_ascii).items():
        expect = b"".join(b"\r\n" if x == b"\n" and PAYLOADS[i][k - 1 : k] != b"\r" else x for k, x in enumerate(PAYLOADS[i][j : j + 1] for j in range(len(PAYLOADS[i]))))
        assert b == expect
    for i, b in applied(payloads, byte_steps.byte_swap16).items():
        low = len(PAYLOADS[i]) // 2
        pairs = [PAYLOADS[i][k : k + 2] for k in range(low, len(PAYLOADS[i]), 2)]
        assert b == PAYLOADS[i][:low] + b"".join(p[::-1] for p in pairs)
    for i, b in applied(payloads, lambda c: byte_steps.byte_patch(c, 3, "CAFE")).items():
        p = PAYLOADS[i]
        assert b == p[:3] + b"\xca\xfe"[: max(0, len(p) - 3)] + p[5:]


def test_generator_vectors():
    assert Pcg32(7).draw(5).tolist() == [4187086478, 3876496192, 736012236, 2305512030, 2834228802]
    one, many = Pcg32(9), Pcg32(9)
    assert [one.one() for _ in range(20)] == many.draw(13).tolist() + many.draw(7).tolist()
    assert all(0 <= Pcg32(s).below(7) < 7 for s in range(50))


def test_mix32_on_columns(spark):
    def plain(h):
        h = (h ^ h >> 16) * 0x7FEB352D & 0xFFFFFFFF
        h = (h ^ h >> 15) * 0x846CA68B & 0xFFFFFFFF
        return h ^ h >> 16

    values = [0, 1, 77, 0xFFFFFFFF, 0x80000000, 123456789]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", mix32(F.col("v")).alias("m")).collect()
    assert {r["v"]: r["m"] for r in rows} == {v: plain(v) for v in values}


@pytest.mark.parametrize("name", sorted(n for n, f in seeded_steps.STEPS.items() if f.__module__ == seeded_steps.__name__ and not seeded_steps.takes_other(n)))
def test_seeded_steps_repeat_and_spare_headers(payloads, name):
    df = payloads.withColumn("seed", F.col("ord") + 5)
    first, again = ({r["ord"]: bytes(r["bytes"]) for r in seeded_steps.seeded(d, name).collect()} for d in (df, df.repartition(5)))
    assert first == again and len(first) == len(PAYLOADS)
    photo = markers.fake_photo(3, 60_000)
    done = seeded_steps.STEPS[name](photo, Pcg32(1))
    if name not in ("ransomware", "ftp_stretch"):
        assert done != photo and done[: markers.body_start(photo)] == photo[: markers.body_start(photo)]


def test_seeded_sizes():
    # Noise that holds no marker: where markers are, damage keeps to what follows them.
    b = PAYLOADS[-1].replace(b"\xff", b"\xfe")
    assert len(seeded_steps.byte_insert(b, Pcg32(2), count=3, length=4)) == len(b) + 12
    assert seeded_steps.ransomware(seeded_steps.ransomware(b, Pcg32(4)), Pcg32(4)) == b
    assert sum(bin(x ^ y).count("1") for x, y in zip(b, seeded_steps.bitflip(b, Pcg32(1), rate=0.001), strict=True)) == 1


def test_transfer_kernels():
    text = b"a\nb\r\nc\n" * 40
    out = seeded_steps.ftp_stretch(text, Pcg32(3), portion=0.3)
    assert out.replace(b"\r\n", b"\n") == text.replace(b"\r\n", b"\n") and len(text) < len(out)
    assert seeded_steps.ftp_stretch(text, Pcg32(3), portion=1.0, direction="crlf_to_lf") == text.replace(b"\r\n", b"\n")
    data = random.Random(2).randbytes(3000).replace(b"\xff", b"a")
    assert len(seeded_steps.base64_damage(data, Pcg32(1), lines=1)) == len(data) - 57
    assert len(seeded_steps.base64_damage(data, Pcg32(1), mode="garble")) == len(data)
    twice = seeded_steps.chipoff_xor(seeded_steps.chipoff_xor(data, Pcg32(1), strength=100), Pcg32(1), strength=100)
    assert twice == data != seeded_steps.chipoff_xor(data, Pcg32(1), strength=100)
    over = seeded_steps.splice(data, Pcg32(1), bytes(5000), clusters=1, cluster_kb=1)
    assert len(over) == len(data) and over[1024:2048] == bytes(1024) and over[:1024] == data[:1024] and over[2048:] == data[2048:]


def test_donors(payloads):
    rows = donors.with_donor(payloads).collect()
    assert {r["ord"]: bytes(r["other"]) for r in rows} == {i: PAYLOADS[(i + 1) % len(PAYLOADS)] for i in range(len(PAYLOADS))}
    assert donors.pool_rotation(payloads, 9).count() == len(PAYLOADS) * (len(PAYLOADS) - 1)
    gaps = payloads.where("ord IN (0, 2, 5)")
    assert {(r["ord"], r["k"]): r["donor"] for r in donors.pool_rotation(gaps, 2).collect()} == {(0, 0): 2, (0, 1): 5, (2, 0): 5, (2, 1): 0, (5, 0): 0, (5, 1): 2}
    assert {r["ord"]: bytes(r["other"]) for r in donors.with_donor(gaps).collect()} == {0: PAYLOADS[2], 2: PAYLOADS[5], 5: PAYLOADS[0]}
    assert [bytes(r["other"]) for r in donors.with_donor(payloads.where("ord = 3")).collect()] == [PAYLOADS[3]]


def test_chains_with_a_loop_end(spark):
    table = spark.createDataFrame([(1, 2, 3), (1, 3, 5), (1, 5, None), (1, 8, 9), (1, 9, 8)], "card_id long, cluster long, next long")
    heads = spark.createDataFrame([(1, 2), (1, 8)], "card_id long, head long")
    got = sorted((r["head"], r["pos"], r["cluster"]) for r in cards.follow_chains(table, heads).collect())
    assert got == [(2, 0, 2), (2, 1, 3), (2, 2, 5), (8, 0, 8), (8, 1, 9)]


def test_zigzag_and_median(spark):
    assert [coefficients.zigzag().index(i) for i in range(10)] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert spark.range(1).select(coefficients.upper_median(F.array(*map(F.lit, [10, 1, 3, 2]))).alias("m")).first()["m"] == 3


def test_structure(spark):
    photo = markers.fake_photo(5, 2000)
    assert [s["name"] for s in markers.segments(photo)] == ["SOI", "DQT", "SOF0", "SOS", "EOI"]
    assert [s["truncated"] for s in markers.segments(photo[:80])][-1] is True
    assert list(markers.segments(b"no photo")) == [] and markers.scan_range(b"no photo") == (0, 8)
    assert markers.scan_end(b"\xff\x00\xff\xd0a\xff\xd9", 0) == 5
    assert markers.neutralised(b"\xff\xc4\xff\x00\xff\xd1abc\xff") == b"\xfe\xc4\xff\x00\xff\xd1abc\xff"


def test_clips(spark):
    frames = [markers.fake_photo(i, 300 + i) for i in range(4)]
    avi = clips.muxed(frames, 25, 16, 16)
    fps, out = clips.demuxed(avi)
    assert fps == 25 and out == frames
    assert clips.demuxed(b"junk" + b"".join(frames))[1] == frames
    df = spark.createDataFrame([(1, bytearray(avi)), (2, None)], "clip_id long, bytes binary")
    back = clips.clips_of_frames(clips.clip_frames(df), 16, 16).collect()
    assert [(r["clip_id"], r["n_frames"]) for r in back] == [(1, 4)] and bytes(back[0]["bytes"]) == avi


def test_recipes(payloads):
    recipe = parse_recipe('{"steps": [{"repeat": 3, "steps": [{"id": "truncate", "params": {"percent": 90}}]}, {"id": "seven_bit", "enabled": false}]}')
    assert len(unrolled(recipe)) == 3
    assert {r["ord"]: len(r["bytes"]) for r in apply_recipe(payloads, recipe).collect()} == {i: int(int(int(len(b) * 0.9) * 0.9) * 0.9) for i, b in enumerate(PAYLOADS)}
    keys = payloads.select(plan_keys(Recipe([Step("truncate"), Step("seven_bit", enabled=False), Repeat([], 4), Step("seven_bit")]), F.col("ord").cast("string")).alias("k")).collect()
    assert len({r["k"][0] for r in keys}) == len(PAYLOADS)
    keys = keys[0]["k"]
    assert keys[0] == keys[1] == keys[2] != keys[3]


def test_files_and_streams(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.dat").write_bytes(markers.fake_photo(1, 500))
    (folder / "b.json").write_bytes(b"{}")
    (folder / "c.bin").write_bytes(b"RIFF0000AVI ")
    assert {r["path"].rsplit("/", 1)[1]: r["kind"] for r in classified(spark, str(folder)).collect()} == {"a.dat": "photo", "b.json": "recipe", "c.bin": "avi"}
    out = live.live_recipe(live.frames(spark, str(folder)), Recipe([Step("truncate", {"percent": 50})]))
    q = out.select(F.length("bytes").alias("n")).writeStream.format("memory").queryName("cut").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.sql("select n from cut").collect()) == [1, 6, 250]
    (tmp_path / "versions").mkdir()
    versions = spark.readStream.schema("k string, v int").json(str(tmp_path / "versions"))
    (tmp_path / "versions" / "x.json").write_text('{"k": "a", "v": 1}\n{"k": "a", "v": 3}\n{"k": "b", "v": 2}\n')
    live.keep_latest(versions, "k", "v", str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination(60)
    (tmp_path / "versions" / "y.json").write_text('{"k": "a", "v": 2}\n{"k": "b", "v": 5}\n')
    live.keep_latest(versions, "k", "v", str(tmp_path / "sink"), str(tmp_path / "ck")).awaitTermination(60)
    assert sorted((r["k"], r["v"]) for r in live.latest(spark, f"{tmp_path}/sink", "k", "v").collect()) == [("a", 3), ("b", 5)]


def test_carving_gets_whole_photos_back(spark):
    photos = [markers.fake_photo(i, 700 + 411 * i) for i in range(5)]
    rows, at = [], 2
    for p in photos:
        rows += [(1, at + k, bytearray(p[k * 512 : k * 512 + 512])) for k in range(-(-len(p) // 512))]
        at += -(-len(p) // 512)
    lost = [r for r in rows if r[1] != rows[-1][1]]
    df = spark.createDataFrame(lost, "card_id long, cluster long, bytes binary")
    got = cards.carved(df).orderBy("first").collect()
    assert [bytes(r["bytes"]) for r in got][:4] == photos[:4] and [r["complete"] for r in got] == [True] * 4 + [False]


def test_seeded_recipes_fuse_and_repeat(spark, payloads):
    from shardmend.functions.prng import turn_seed
    from shardmend.plans.presets import STORIES, story

    recipe = Recipe([Repeat([Step("bitflip", {"rate": 500.0}, 3)], 2, seed=9), Step("truncate", {"percent": 80}), Step("zero_run", {"length": 8}, 4)])
    got = {r["ord"]: bytes(r["bytes"]) for r in apply_recipe(payloads, recipe, seed="ord").collect()}
    for i, b in enumerate(PAYLOADS):
        for t in range(2):
            b = seeded_steps.bitflip(b, Pcg32(turn_seed(3, 9, t) + i & 0xFFFFFFFF), rate=500.0)
        assert got[i] == seeded_steps.zero_run(b[: int(len(b) * 0.8)], Pcg32(4 + i), length=8)
    assert all(apply_recipe(payloads, story(name, 1.0, 5), seed="ord").count() == len(PAYLOADS) for name in STORIES)


def test_next_in_group_over_blocks(spark):
    from shardmend.operators import lookups

    r = random.Random(4)
    rows = [(i, r.choice([None, "a", "b"])) for i in sorted(r.sample(range(1000), 60))]
    got = {(x["g"], x["i"]): x["next"] for x in lookups.next_in_group(spark.createDataFrame(rows, "i long, g string"), ["g"], "i", block=50).collect()}
    for g in (None, "a", "b"):
        own = [i for i, x in rows if x == g]
        assert all(got[(g, i)] == own[(k + 1) % len(own)] for k, i in enumerate(own))


def test_interval_and_last_before(spark):
    from shardmend.operators import lookups

    points = spark.createDataFrame([(1, i) for i in range(0, 200, 7)], "k long, at long")
    intervals = spark.createDataFrame([(1, 0, 30, "a"), (1, 30, 31, "b"), (1, 60, 150, "c"), (1, 80, 80, "none")], "k long, low long, high long, name string")
    got = {r["at"]: r["name"] for r in lookups.interval_join(points, intervals, "k", "at", "low", "high", 16).collect()}
    assert got == {i: "a" if i < 30 else "c" for i in range(0, 200, 7) if i < 30 or 60 <= i < 150}
    marks = spark.createDataFrame([(1, 14, "x"), (1, 15, "y"), (1, 120, "z")], "k long, at long, v string")
    got = {r["at"]: r["v"] for r in lookups.last_before(points, marks, "k", "at", "v", 32).collect()}
    assert got == {i: None if i < 14 else "x" if i < 15 else "y" if i < 120 else "z" for i in range(0, 200, 7)}


def test_card_fields(spark):
    from shardmend.functions import card_fields

    row = spark.range(1).select(
        card_fields.volume_label(F.lit("my [card]/2024 é photos")).alias("label"), card_fields.short_name(F.lit("img.0001.jpeg")).alias("name"), card_fields.packed_time(F.lit(86400 * 40 + 3725)).alias("time")
    ).first()
    assert row["label"] == "MY CARD2024" and row["name"] == "IMG.0001JPE"
    assert row["time"] == (20 << 9 | 2 << 5 | 10) << 16 | 1 << 11 | 2 << 5 | 2


def test_catalogue_names():
    assert set(catalogue.ORACLE_SQL) <= set(catalogue.QUERIES)
