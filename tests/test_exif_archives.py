"""Exif trees, quantisation tables, lost headers, archives and masks, against plain readers and hand values."""

import io
import random
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from shardmend.functions.prng import Pcg32
from shardmend.operators import coefficients, lookups, marker_steps
from shardmend.operators.seeded_steps import try_step
from shardmend.sources import archives, exif, markers


def tree(r, order):
    value = lambda n: bytes(r.randrange(256) for _ in range(n))
    entries = lambda tags: [exif.Entry(t, 7, n, value(n)) for t in sorted(tags) for n in [r.randrange(1, 12)]]
    return exif.Tree(order, entries({0x010F, 0x0110, 0x013B}), entries({0x9003, 0xA431, 0x927C}), entries({1, 2, 4}), [exif.Entry(0x0103, 3, 1, struct.pack(order + "H", 6))], value(r.randrange(1, 40)))


@pytest.mark.parametrize("order", ["<", ">"])
def test_trees_go_there_and_back(order):
    r = random.Random(71)
    pointers = set(exif.POINTERS) | {exif.THUMB_AT, exif.THUMB_SIZE}
    for _ in range(60):
        given = tree(r, order)
        for name in r.sample(["exif", "gps"], r.randrange(3)):
            setattr(given, name, [])
        if r.random() < 0.3:
            given.second, given.thumb = [], None
        found = exif.parsed(exif.written(given))
        for name in ("main", "exif", "gps", "second"):
            assert [e for e in getattr(found, name) if e.tag not in pointers] == getattr(given, name), name
        assert found.thumb == given.thumb and exif.written(found) == exif.written(given)


def test_damaged_trees_end():
    r = random.Random(72)
    whole = exif.written(tree(r, "<"))
    for _ in range(400):
        data = bytearray(whole)
        for _ in range(r.randrange(1, 6)):
            data[r.randrange(6, len(data))] = r.randrange(256)
        found = exif.parsed(bytes(data[: r.randrange(len(data) + 1)]))
        assert found is None or isinstance(exif.written(found), bytes)
    circle = exif.PREFIX + b"II" + struct.pack("<HIHHHIII", 42, 8, 1, 0x8769, 4, 1, 8, 8)
    assert exif.parsed(circle).exif == [] and exif.parsed(circle).second == []
    assert exif.parsed(b"Exif\0\0XX12345678") is None and exif.parsed(b"") is None


def photo_with(block, more=b""):
    return b"\xff\xd8" + (marker_steps.segment(0xE1, block) if block else b"") + more + markers.fake_photo(3, 400)[2:]


def test_private_fields_go():
    r = random.Random(73)
    given = tree(r, ">")
    notes = marker_steps.segment(0xE1, b"http://ns.adobe.com/xap") + marker_steps.segment(0xED, b"Photoshop 3.0") + marker_steps.segment(0xFE, b"kept")
    out, error = try_step("strip_exif", photo_with(exif.written(given), notes), Pcg32(1), {})
    assert error is None and b"adobe" not in out and b"Photoshop" not in out and b"kept" in out
    left = exif.parsed(out[out.index(b"Exif\0\0") :])
    assert {e.tag for e in left.main} == {0x010F, 0x0110, 0x8769} and {e.tag for e in left.exif} == {0x9003} and left.gps == [] and left.thumb == given.thumb
    assert try_step("strip_exif", photo_with(exif.PREFIX + b"no tree"), Pcg32(1), {})[0] == photo_with(b"")
    turned = marker_steps.exif_orientation(photo_with(exif.written(given)), Pcg32(1), 3)
    again = exif.parsed(turned[turned.index(b"Exif\0\0") :])
    assert [e.data for e in again.main if e.tag == exif.ORIENTATION] == [struct.pack(">H", 3)] and [e for e in again.gps] == given.gps


def test_quantisation_by_hand():
    assert marker_steps.quality_table(0, 50)[:6] == [16, 11, 12, 14, 12, 10] and marker_steps.quality_table(1, 100) == [1] * 64 and max(marker_steps.quality_table(0, 1)) == 255
    photo = markers.fake_photo(1, 300)
    assert marker_steps.quantisation(photo) == [(0, 0, list(range(1, 65)))]
    scaled = marker_steps.qtable_decode_swap(photo, Pcg32(1), factor=5.0)
    assert marker_steps.quantisation(scaled)[0][2] == [min(5 * k, 255) for k in range(1, 65)] and len(scaled) == len(photo)
    assert marker_steps.qtable_decode_swap(photo, Pcg32(1), mode="swap") == photo
    assert try_step("qtable_decode_swap", b"nothing", Pcg32(1), {})[1] == "no quantisation tables found"


def test_headers_found_by_their_looks():
    small, large = markers.fake_photo(1, 300), markers.fake_photo(2, 900)
    at = large.index(b"\xff\xc0")
    large = large[: at + 5] + b"\x01\x00\x02\x00" + large[at + 9 :]
    hidden = b"\xff\xd8\xff\xe1\xff\xff" + small + bytes(5000) + large[2:] + bytes(70_000)
    out, error = try_step("repair_header", hidden, Pcg32(1), {})
    assert error is None and out == large + bytes(70_000)
    assert try_step("repair_header", small, Pcg32(1), {}) == (small, "the header is whole")
    assert try_step("repair_header", b"\xff\xd8" + bytes(50), Pcg32(1), {})[1] == "no frame header in the file"


def test_donors_by_real_signatures(spark):
    photos = {0: markers.fake_photo(1, 300), 3: markers.fake_photo(2, 400), 5: b"no photo", 7: markers.fake_photo(3, 350).replace(b"\xff\xdb\x00\x43\x00\x01", b"\xff\xdb\x00\x43\x00\x09"), 9: None}
    signed = marker_steps.signature_table(spark.createDataFrame(list(photos.items()), "photo_id long, bytes binary"))
    rows = {x["photo_id"]: x for x in signed.collect()}
    assert rows[0]["tables"] == rows[3]["tables"] != rows[7]["tables"] and rows[0]["frame"] == rows[7]["frame"] and rows[5]["frame"] is rows[9]["tables"] is None
    own = F.concat(F.lit("none "), F.col("photo_id").cast("string"))
    best = lookups.best_donor(signed.withColumn("frame", F.coalesce("frame", own)).withColumn("tables", F.coalesce("tables", own)), "photo_id", "tables", "frame")
    assert {tuple(x) for x in best.collect()} == {(0, 3, 3), (3, 0, 3), (5, 7, 0), (7, 0, 1), (9, 0, 0)}


def test_archives_open_elsewhere_and_here(spark, monkeypatch):
    monkeypatch.setattr(archives, "SHARD", 7)
    r = random.Random(74)
    files = [(a, 3 * k, f"dir/é{k}.bin", bytes(r.randrange(256) for _ in range(r.choice([0, 5, 300, 2000])))) for a in range(3) for k in range(40)] + [(9, 1, "only", None)]
    df = spark.createDataFrame(files, "archive long, place long, name string, bytes binary").repartition(5)
    parts = archives.archived(df, 4096).persist()
    for a in (0, 1, 2, 9):
        rows = sorted((x["begin"], bytes(x["bytes"])) for x in parts.collect() if x["archive"] == a)
        whole = b"".join(b for _, b in rows)
        assert all(begin == sum(len(b) for _, b in rows[:k]) for k, (begin, _) in enumerate(rows)) and (len(rows) > 3 or a == 9)
        with zipfile.ZipFile(io.BytesIO(whole)) as z:
            assert z.testzip() is None and {n: z.read(n) for n in z.namelist()} == {n: b or b"" for x, _, n, b in files if x == a}
    got = archives.extracted(parts, 4096).collect()
    assert {(x["archive"], x["name"]): bytes(x["bytes"]) for x in got} == {(a, n): b or b"" for a, _, n, b in files} and all(x["whole"] for x in got)
    broken = parts.withColumn("bytes", F.when(F.col("begin") == 0, F.concat(F.expr("substring(bytes, 1, 45)"), F.lit(b"!"), F.expr("substring(bytes, 47)"))).otherwise(F.col("bytes")))
    assert sum(not x["whole"] for x in archives.extracted(broken, 4096).collect()) in (1, 2, 3)
    monkeypatch.setattr(archives, "MOST_ENTRIES", 39)
    with pytest.raises(Exception, match="more than an archive can hold"):
        archives.archived(df, 4096).collect()
    assert archives.archived(df.limit(0)).collect() == []


def plain_mask(mask, x, y, width, height):
    return mask["data"][min(y * mask["h"] // max(height, 1), mask["h"] - 1) * mask["w"] + min(x * mask["w"] // max(width, 1), mask["w"] - 1)] / 255


def test_masks_by_hand(spark):
    mask = {"w": 3, "h": 2, "data": [0, 51, 102, 153, 204, 255]}
    grid = spark.range(35).selectExpr("id % 7 AS x", "id div 7 AS y")
    rows = grid.select("x", "y", coefficients.mask_weight(mask, 0.5, F.col("x"), F.col("y"), F.lit(7), F.lit(5)).alias("w")).collect()
    assert all(r["w"] == pytest.approx(0.5 * plain_mask(mask, r["x"], r["y"], 7, 5)) for r in rows)
    assert spark.range(1).select(coefficients.mask_weight({"w": 9, "h": 9, "data": [1]}, 0.5, F.lit(0), F.lit(0), F.lit(1), F.lit(1)).alias("w")).first()["w"] == 0.5
    block = spark.createDataFrame([([100, -7, 5] + [3] * 61,)], "c array<int>")
    run = lambda w, mode: block.select(coefficients.brushed(F.col("c"), F.lit(w), mode).alias("c")).first()["c"]
    assert run(0.0, "zero") == run(0.0, "boost") == [100, -7, 5] + [3] * 61
    assert run(1.0, "zero") == [100] + [0] * 63 and run(1.0, "boost") == [100, -28, 20] + [12] * 61
    assert run(1.0, "harsh")[:3] == [100, 0, 0] and run(0.1, "harsh")[1:3] == [-8, 5]


def test_inspection_by_hand():
    fill = bytes.fromhex("FFD8FFFFFFFE000301FFD9")
    assert markers.inspected(fill)[-5:] == (0, 0, 0, 0, 9)
    odd = bytes.fromhex("0012FFD8FFFE00040102FFD90909")
    assert markers.inspected(odd)[-5:] == (0, 0, 2, 2, 10) and markers.inspected(odd)[1] is None
    assert markers.inspected(b"") == (0, *[None] * 9, 0, 0, 0, 0, None)
    assert markers.inspected(bytes.fromhex("FFD8FF05ABCD"))[-2:] == (3, None)
    photo = markers.fake_photo(1, 300)
    assert markers.inspected(photo)[1:10] == (16, 16, 192, False, 3, 16, 16, 1, 1)
