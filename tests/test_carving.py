"""Carving and directory walks against plain readers that go over a card from its first byte to its last."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from shardmend.operators import carving, directories
from shardmend.sources import markers

KNOWN = (b"\xff\xd8\xff", b"RIFF", b"\xd0\xcf\x11\xe0", b"\x00\x05\x16\x07")


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path))


def plain_scan(buffer):
    at = 2
    while at + 4 <= len(buffer):
        if buffer[at] != 0xFF:
            return None
        if buffer[at + 1] == 0xFF:
            at += 1
            continue
        size = int.from_bytes(buffer[at + 2 : at + 4])
        if buffer[at + 1] == 0xDA:
            return min(at + 2 + size, len(buffer))
        at += 2 + size
    return None


def plain_carve(image, cb, most):
    """(start, bytes, first, complete) of files, a cluster at a time."""
    out, c = [], 0
    while c * cb < len(image):
        cl = image[c * cb : (c + 1) * cb]
        if not any(cl):
            c += 1
            continue
        if cl[:4] == b"RIFF" and cl[8:12] == b"AVI ":
            size = min(int.from_bytes(cl[4:8], "little") + 8, most)
            out.append((c * cb, image[c * cb : c * cb + size], c + 2, "clip"))
            c += max(-(-size // cb), 1)
            continue
        start = c * cb if cl[:3] == b"\xff\xd8\xff" else next((c * cb + s for s in range(512, cb, 512) if cl[s : s + 3] == b"\xff\xd8\xff"), None)
        if start is None:
            c += 1
            continue
        buffer, at, scan, end = b"", start, None, None
        while at < len(image) and len(buffer) < most:
            block = image[at : at + cb]
            if at > start and (not any(block) or block.startswith(KNOWN)):
                break
            before, buffer = len(buffer), buffer + block
            scan = plain_scan(buffer) if scan is None else scan
            if scan is not None and (p := buffer.find(b"\xff\xd9", max(scan, before - 1))) >= 0:
                end = p + 2
                break
            at += cb
        data = buffer if end is None else buffer[:end]
        out.append((start, data, c + 2, "whole" if end else "open"))
        used = (start + len(data) - 1) // cb - c + 1
        c += used if start == c * cb else max(used - 1, 1)
    return out


def photo(r, size, header=0, ended=True):
    """A photo with a long note in its header, so that scans begin clusters away."""
    note = b"".join(b"\xff\xe1" + (len(p) + 2).to_bytes(2) + p for p in [bytes(r.randrange(1, 250) for _ in range(header // 3)) for _ in range(3)]) if header else b""
    fill = b"\xff" * r.randrange(3)
    return b"\xff\xd8" + note + fill + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + bytes(r.randrange(1, 250) for _ in range(size)) + (b"\xff\xd9" if ended else b"")


def random_image(r, cb):
    image = bytearray()
    for _ in range(14):
        kind = r.randrange(8)
        if kind == 0:
            image += bytes(r.randrange(1, 4) * 512)
        elif kind == 1:
            image += bytes(-len(image) % cb) + b"RIFF" + struct.pack("<I", r.randrange(100, 3 * cb)) + b"AVI " + bytes(r.randrange(256) for _ in range(r.randrange(2 * cb)))
        elif kind == 2:
            image += bytes(-len(image) % 512) + r.choice(KNOWN) + bytes(r.randrange(256) for _ in range(r.randrange(600)))
        elif kind == 3:
            image += bytes(r.randrange(256) for _ in range(r.randrange(2 * cb)))
        else:
            image += bytes(-len(image) % r.choice([512, cb])) + photo(r, r.randrange(3 * cb), r.choice([0, 0, 30, 3 * cb]), r.random() < 0.7)
    return bytes(image) + bytes(-len(image) % cb)


def cut(image, card, cb):
    rows = [(card, k + 2, image[k * cb : (k + 1) * cb]) for k in range(len(image) // cb)]
    return [(c, k, b.rstrip(b"\0") if k % 3 else b) for c, k, b in rows if any(b)]  # blank clusters aren't stored, some lack their zeros


def test_files_by_a_plain_carver(spark):
    r, cb, most = random.Random(31), 1024, 6000
    images = {card: random_image(r, cb) for card in range(40)}
    stored = spark.createDataFrame([row for card, image in images.items() for row in cut(image, card, cb)], "card_id long, cluster long, bytes binary").repartition(5)
    ends = spark.createDataFrame([(card, len(image) // cb + 1) for card, image in images.items()], "card_id long, last long")
    got = carving.carve_files(stored, ends, cb, most).collect()
    kinds = {"c": "whole", "n": "open", "A": "clip"}
    found = sorted((x["card_id"], x["start"], bytes(x["bytes"]), x["first"], kinds[x["note"][0]]) for x in got)
    expect = sorted((card, *f) for card, image in images.items() for f in plain_carve(image, cb, most))
    assert [x[:2] for x in found] == [x[:2] for x in expect]
    assert found == expect and {x[4] for x in found} == {"whole", "open", "clip"}
    assert all(x["name"] == f"f{x['start'] // 512:07d}." + ("avi" if x["note"][0] == "A" else "jpg") for x in got)
    assert carving.carve_files(stored.limit(0), ends, cb).collect() == []


def plain_small(image, cb):
    out, seen = [], 0
    at = image.find(b"\xff\xd8\xff")
    while at >= 0:
        if at >= seen:
            end = markers.strict_end((image + bytes(carving.WINDOW))[at : at + carving.WINDOW])
            if end is not None and 1024 <= end < 160 * 1024 and (at % cb or end < 64 * 1024):
                out.append((at, end))
                seen = at + end
        at = image.find(b"\xff\xd8\xff", at + 1)
    return out


def test_small_photos_by_a_plain_search(spark):
    r, cb = random.Random(32), 1024
    images = {}
    for card in range(6):
        image = b""
        for _ in range(8):
            image += bytes(r.randrange(1, 250) for _ in range(r.randrange(1500)))
            inner = photo(r, r.randrange(500, 4000))
            image += b"\xff\xd8\xff\xe1" + (len(inner) + 2).to_bytes(2) + inner + photo(r, 2000)[2:] if r.random() < 0.4 else inner
        images[card] = image + bytes(-len(image) % cb)
    stored = spark.createDataFrame([row for card, image in images.items() for row in cut(image, card, cb)], "card_id long, cluster long, bytes binary").repartition(3)
    got = carving.small_photos(stored, cb).collect()
    assert sorted((x["card_id"], x["start"]) for x in got) == sorted((card, at) for card, image in images.items() for at, _ in plain_small(image, cb))
    for x in got:
        assert x["note"] == carving.SMALL_NOTES["movie"] and bytes(x["bytes"]).count(markers.STANDARD_TABLES) == 1


def test_small_photos_move_their_bytes_once(spark, monkeypatch):
    """Photos across edges of blocks and ghosts without an end: what is joined is no more than the card, however many starts it has."""
    r, cb, asked, joined = random.Random(33), 1024, [], carving.span_bytes
    monkeypatch.setattr(carving, "WINDOW", 8192)
    monkeypatch.setattr(carving, "MOST_SMALL", 6000)
    monkeypatch.setattr(carving, "span_bytes", lambda spans, *rest: asked.append(spans) or joined(spans, *rest))
    image = b""
    while len(image) < 5 * 32768:
        cache = r.random() < 0.3
        inner = photo(r, r.randrange(900, 5000))
        image += bytes(r.randrange(1, 250) for _ in range(r.randrange(300))) + (b"\x0c" + bytes(7) + len(inner).to_bytes(4, "little") if cache else b"") + inner + b"\xff\xd8\xff\xfe" * r.randrange(6)
    image += bytes(-len(image) % cb)
    stored = spark.createDataFrame(cut(image, 7, cb), "card_id long, cluster long, bytes binary").repartition(3)
    got = {x["start"]: bytes(x["bytes"]) for x in carving.small_photos(stored, cb).collect()}
    assert sum(x["end"] - x["begin"] for spans in asked for x in spans.collect()) <= len(image)
    expect, at = [], 0
    while (at := image.find(b"\xff\xd8\xff", at)) >= 0:
        end = markers.strict_end(image[at : at + 8192])
        if end is not None and 1024 <= end < 6000:
            expect.append((at, markers.with_standard_tables(image[at : at + end])))
        at += end if expect and expect[-1][0] == at else 1
    assert sorted(got.items()) == expect and len({s // 32768 for s in got}) > 3


def set_of(name, folder, first, size, contiguous=False, gone=False):
    """A set of entries of a long name."""
    used = 0 if gone else 0x80
    units = name.encode("utf-16-le")
    pieces = [units[k : k + 30].ljust(30, b"\0") for k in range(0, len(units), 30)]
    head = bytes([5 | used, 1 + len(pieces)]) + b"\0\0" + struct.pack("<H", 16 if folder else 32) + bytes(26)
    stream = bytes([0x40 | used, 3 if contiguous else 1, 0, len(name)]) + bytes(4) + struct.pack("<Q4xIQ", size, first, size)
    return head + stream + b"".join(bytes([0x41 | used, 0]) + p for p in pieces)


def test_trees_with_sets_across_clusters_and_loops(spark):
    cb = 96  # three entries to a cluster, so that every set crosses an edge
    root = set_of("a folder with a long name", True, 20, 0) + set_of("whole.bin", False, 30, 200, contiguous=True) + set_of("gone kept.bin", False, 40, 150, gone=True)
    below = set_of("up again", True, 2, 0) + set_of("ünder.bin", False, 50, 100) + set_of("outside.bin", False, 9999, 10, gone=True) + set_of("empty", False, 0, 0)
    clusters, chains = {}, []

    def put(data, places):
        for k, p in enumerate(places):
            clusters[p] = data[k * cb : (k + 1) * cb]
        chains.append(places)

    put(root, [2, 9, 5, 7, 12][: -(-len(root) // cb)])
    put(below, [20, 16, 22, 14, 25][: -(-len(below) // cb)])
    whole, kept, under = bytes(range(200)), bytes(range(50, 200)), bytes(range(100))
    put(kept, [40, 44])
    put(under, [50, 48])
    for k in range(3):
        clusters[30 + k] = whole[k * cb : (k + 1) * cb]
    stored = spark.createDataFrame([(1, c, b) for c, b in clusters.items()], "card_id long, cluster long, bytes binary")
    table = spark.createDataFrame([(1, a, b) for c in chains for a, b in zip(c, [*c[1:], None], strict=True)], "card_id long, cluster long, next long")
    volumes = spark.createDataFrame([(1, "exfat", 2, 60)], "card_id long, fs string, root long, last long")
    in_use = spark.createDataFrame([(1, c) for c in (*clusters,) if c not in (40, 44)], "card_id long, cluster long")
    files = directories.walk(volumes, table, stored)
    live = {x["name"]: bytes(x["bytes"]) for x in directories.read_files(files, table, stored, in_use, cb).collect()}
    assert live == {"whole.bin": whole, "a folder with a long name/ünder.bin": under}
    lost = {x["name"]: (bytes(x["bytes"]), x["note"]) for x in directories.read_files(files, table, stored, in_use, cb, "skipping").collect()}
    assert lost["gone kept.bin"] == (kept, directories.NOTES["kept"])
    assert lost["a folder with a long name/outside.bin"] == (b"", "start cluster 9999 is outside the card: can't recover")
    assert lost["a folder with a long name/empty"] == (b"", directories.NOTES["empty"])
    run = {x["name"]: bytes(x["bytes"]) for x in directories.read_files(files, table, stored, in_use, cb, "run").collect()}
    assert run["gone kept.bin"] == kept[:cb] + bytes(150 - cb) and run["whole.bin"] == whole
    assert directories.walk(volumes.limit(0), table, stored).count() == 0


def short(name, attributes, first, size):
    return name.encode().ljust(11) + bytes([attributes]) + bytes(8) + struct.pack("<H4xHI", first >> 16, first & 0xFFFF, size)


def test_short_entries():
    data = short("CARD", 8, 0, 0) + short(".", 16, 2, 0) + b"\x41" + bytes(10) + b"\x0f" + bytes(20) + short("IMG_0001JPG", 32, 70_000, 5) + short("\x05OLD    TXT", 32, 4, 6).replace(b"\x05", b"\xe5", 1) + short("DCIM", 16, 3, 0) + bytes(32) + short("AFTER", 32, 9, 9)
    assert list(directories.short_entries(data, True)) == [("IMG_0001.JPG", 70_000, 5, False, False, False, 3), ("_OLD.TXT", 4, 6, False, True, False, 4), ("DCIM", 3, 0, True, False, False, 5)]
    assert next(directories.short_entries(data, False))[1] == 70_000 & 0xFFFF
    assert list(directories.set_entries(set_of("cut off", False, 5, 5)[:-32])) == []


def test_standard_tables_are_whole():
    data, at = markers.STANDARD_TABLES, 0
    for kind, most in ((0x00, 11), (0x10, 0xFA), (0x01, 11), (0x11, 0xFA)):
        counts = data[at + 1 : at + 17]
        symbols = data[at + 17 : at + 17 + sum(counts)]
        assert data[at] == kind and len(set(symbols)) == len(symbols) == (12 if most == 11 else 162) and max(symbols) == most
        code = 0
        for n in counts:  # codes of each length, none of them all ones
            code = (code + n) * 2
        assert code <= 2**17 - 2
        at += 17 + len(symbols)
    assert at == len(data)
    assert markers.with_standard_tables(b"no photo") == b"no photo"


def test_open_photos_read_past_second_pictures_to_the_blank(spark, tmp_path):
    """Photos with noise in their header and a second picture at a sector or block behind them, against the SQL twin."""
    import duckdb

    from shardmend import carving_queries, catalogue, photo_queries

    for i in (143, 286, 572, 144):
        spark.createDataFrame([(i, "")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/empty/documents.parquet")
    sizes = {r["photo_id"]: len(r["bytes"]) - (5 if r["photo_id"] != 144 else 0) for r in photo_queries.photos(spark, f"{tmp_path}/empty").collect()}
    rows = [(i, "a" * ((-n - 512 * (i % 4)) % 2048 + more)) for (i, n), more in zip(sorted(sizes.items()), (4096, 2048, 512, 2048), strict=True)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/full/documents.parquet")
    got = carving_queries.card_carve_sectors(spark, f"{tmp_path}/full").collect()
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/full/documents.parquet/*.parquet')")
        assert sorted(map(tuple, got)) == sorted(db.execute(catalogue.ORACLE_SQL["card_carve_sectors"]).fetchall())
