"""Steps on the segments of JPEG files: drops, overlays and grafts that need no decoded picture.

They are kernels like the seeded steps, ``step(bytes, generator, [other,] **params) -> bytes``, so that recipes fuse them.
What a step cannot be applied to, it refuses with ValueError, and the payload stays as it is.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardmend.functions.prng import Pcg32
from shardmend.operators.coefficients import zigzag
from shardmend.operators.seeded_steps import step
from shardmend.sources import exif
from shardmend.sources.markers import DHT, DQT, DRI, EOI, FRAMES, SOI, SOS, STANDARD_TABLES, neutralised, segments, with_standard_tables

APP0, APP1, APP2, APP13, APP14, COM, PROGRESSIVE = 0xE0, 0xE1, 0xE2, 0xED, 0xEE, 0xFE, 0xC2
EXIF = b"Exif\0\0"
ORIENTATION = 0x0112


def first_of(data: bytes, *markers: int) -> dict:
    """The first segment with one of the markers."""
    for s in segments(data):
        if s["marker"] in markers:
            return s
    raise ValueError("no such segment")


def without(data: bytes, drop: Callable[[int, bytes], bool]) -> bytes:
    """``data`` less the segments before its first scan that ``drop(marker, payload)`` picks."""
    out, at = [], 0
    for s in segments(data):
        if s["marker"] == SOS:
            break
        if drop(s["marker"], data[s["start"] : s["end"]]):
            out.append(data[at : s["offset"]])
            at = s["offset"] + s["length"]
    return b"".join(out) + data[at:]


def segment(marker: int, payload: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(payload) + 2) + payload


@step
def strip_exif(data: bytes, g: Pcg32, mode: str = "private") -> bytes:
    """Without what tells a person, a device or a place; or, if ``all``, without Exif, comments, editor notes and what else APP2 holds besides a colour profile.

    The rest of the Exif block is written anew. A block that can't be read goes whole, as do other kinds of notes.
    """
    if mode == "all":
        return without(data, lambda m, p: m in (APP1, APP13, COM) or m == APP2 and not p.startswith(b"ICC_PROFILE"))
    block = exif_block(data)
    if block is not None:
        tree = exif.parsed(data[block["start"] : block["end"]])
        if tree is not None:
            tree.gps = []
            tree.main = [e for e in tree.main if e.tag not in exif.PRIVATE]
            tree.exif = [e for e in tree.exif if e.tag not in exif.PRIVATE]
        data = with_exif(data, None if tree is None else exif.written(tree))
    return without(data, lambda m, p: m == APP1 and not p.startswith(EXIF) or m == APP13)


def with_exif(data: bytes, payload: bytes | None) -> bytes:
    """``data`` with another Exif block, or without one; a new block comes behind the start, and a JFIF header there."""
    new, block = b"" if payload is None else segment(APP1, payload), exif_block(data)
    if block is not None:
        return data[: block["offset"]] + new + data[block["offset"] + block["length"] :]
    at = 2 if data[:2] == b"\xff\xd8" else 0
    first = next((s for s in segments(data) if s["offset"] == at and s["marker"] == APP0), None)
    at = first["end"] if first else at
    return data[:at] + new + data[at:]


@step
def icc_loss(data: bytes, g: Pcg32, mode: str = "strip") -> bytes:
    """Without its colour profile."""
    if mode != "strip":
        raise ValueError("other modes need the decoded picture")
    return without(data, lambda m, p: m == APP2 and p.startswith(b"ICC_PROFILE\0"))


@step
def mjpeg_no_dht(data: bytes, g: Pcg32, mode: str = "insert_std", tables: str = "") -> bytes:
    """Without Huffman tables of its own, as in frames of a clip: ``none``, or the standard ones, or ``tables``, in hex, before the scan."""
    bare = without(data, lambda m, p: m == DHT)
    if mode == "none":
        return bare
    if not tables:
        return with_standard_tables(bare)
    at = first_of(bare, SOS)["offset"]
    return bare[:at] + segment(DHT, bytes.fromhex(tables)) + bare[at:]


@step
def huffman_swap(data: bytes, g: Pcg32, other: bytes, source: str = "photo") -> bytes:
    """The Huffman tables of another photo, or the standard ones, just before the first scan, in place of its own."""
    tables = b"" if source == "standard" else b"".join(other[s["offset"] : s["offset"] + s["length"]] for s in segments(other) if s["marker"] == DHT)
    tables = tables or segment(DHT, STANDARD_TABLES)
    bare = without(data, lambda m, p: m == DHT)
    at = first_of(bare, SOS)["offset"]
    return bare[:at] + tables + bare[at:]


@step
def color_matrix(data: bytes, g: Pcg32, mode: str = "ycc_as_rgb") -> bytes:
    """The flag that tells how colours are stored, set to none or flipped; a JFIF header, which would overrule it, goes."""
    if mode not in ("ycc_as_rgb", "adobe_flag_flip"):
        raise ValueError("other modes need the decoded picture")
    flag = 0
    if mode == "adobe_flag_flip":
        known = [data[s["start"] : s["end"]] for s in segments(data) if s["marker"] == APP14 and data[s["start"] : s["end"]].startswith(b"Adobe")]
        now = known[0][11] if known and len(known[0]) > 11 else None
        frame = next((s for s in segments(data) if s["marker"] in FRAMES), None)
        four = frame is not None and data[frame["start"] + 5 : frame["start"] + 6] == b"\x04"
        flag = (0 if now == 2 else 2) if four else int(now == 0)
    bare = without(data, lambda m, p: m == APP14 and p.startswith(b"Adobe") or m == APP0 and p.startswith(b"JFIF"))
    at = 2 if bare[:2] == b"\xff\xd8" else 0
    return bare[:at] + segment(APP14, b"Adobe\0\x64\0\0\0\0" + bytes([flag])) + bare[at:]


@step
def cbcr_swap(data: bytes, g: Pcg32) -> bytes:
    """The second and third component of the frame change names, so that their colours change places."""
    at = first_of(data, *FRAMES)["offset"] + 10
    if data[at - 1] < 3:
        raise ValueError("no colour components")
    out = bytearray(data)
    out[at + 3], out[at + 6] = out[at + 6], out[at + 3]
    return bytes(out)


@step
def sof_dims(data: bytes, g: Pcg32, width: int = 0, height: int = 0, width_delta: int = 16, height_delta: int = 0) -> bytes:
    """A frame header that claims another size: a given one, or its own and a difference."""
    at = first_of(data, *FRAMES)["offset"] + 5
    if at + 4 > len(data):
        raise ValueError("the frame header is cut short")
    h, w = struct.unpack_from(">HH", data, at)
    w, h = width if width > 0 else w + width_delta, height if height > 0 else h + height_delta
    return data[:at] + struct.pack(">HH", *(min(max(x, 1), 65535) for x in (h, w))) + data[at + 4 :]


@step
def progressive_cut(data: bytes, g: Pcg32, scans: int = 2) -> bytes:
    """A progressive file that ends after its first scans."""
    first_of(data, PROGRESSIVE)
    found = [s for s in segments(data) if s["marker"] == SOS]
    if not found:
        raise ValueError("no scan")
    return data[: found[: min(max(scans, 1), 100)][-1]["scan_end"]] + b"\xff\xd9"


@step
def progressive_drop_dc(data: bytes, g: Pcg32) -> bytes:
    """A progressive file without the scans that hold its coarse picture: those of a band from 0 on."""
    first_of(data, PROGRESSIVE)
    out, at = [], 0
    for s in segments(data):
        if s["marker"] == SOS and s["end"] > s["start"]:
            low = s["start"] + 1 + 2 * data[s["start"]]
            if low < s["end"] and data[low] == 0:
                out.append(data[at : s["offset"]])
                at = s["scan_end"]
    return b"".join(out) + data[at:]


def strips(data: bytes) -> list[tuple[int, int]]:
    """Bytes of each stretch of the first scan that a restart marker ends, with that marker."""
    scan = first_of(data, SOS)
    out, low, at = [], scan["end"], scan["end"]
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < scan["scan_end"]:
        if 0xD0 <= data[at + 1] <= 0xD7:
            out.append((low, at + 2))
            low = at + 2
            at += 2
        else:
            at += 1
    return out


def drawn(g: Pcg32, n: int, k: int) -> list[int]:
    """``k`` of 0 to n - 1 without repeats, in the order of a seeded shuffle from the end."""
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        j = g.below(i + 1)
        order[i], order[j] = order[j], order[i]
    return order[:k]


@step
def rst_strip_loss(data: bytes, g: Pcg32, count: int = 3, behaviour: str = "collapse") -> bytes:
    """Some strips between restart markers are lost, never the first; what is left is numbered anew unless it shows gaps."""
    first_of(data, DRI)
    found = strips(data)
    if len(found) < 2:
        raise ValueError("not enough strips")
    lost = sorted(1 + i for i in drawn(g, len(found) - 1, min(max(count, 1), len(found) - 1)))
    out, at = [], 0
    for i in lost:
        out.append(data[at : found[i][0]])
        at = found[i][1]
    whole = bytearray(b"".join(out) + data[at:])
    if behaviour != "gaps":
        for n, (_, end) in enumerate(strips(bytes(whole))):
            whole[end - 1] = 0xD0 + n % 8
    return bytes(whole)


@step
def mpf_ghost(data: bytes, g: Pcg32) -> bytes:
    """The second picture of a file, which follows the end of the first."""
    end = first_of(data, EOI)["end"]
    at = data.find(b"\xff\xd8\xff", end)
    if at < 0:
        raise ValueError("no second picture")
    return data[at:]


def header_of(data: bytes, keep_exif: bool) -> bytes:
    """All segments up to the first scan's header, without noise between them."""
    scan = first_of(data, SOS)["offset"]
    kept = [s for s in segments(data) if s["offset"] <= scan and s["marker"] != SOI and (keep_exif or s["marker"] != APP1)]
    return b"\xff\xd8" + b"".join(data[s["offset"] : s["offset"] + s["length"]] for s in kept)


def bare_header(data: bytes) -> bytes:
    """All segments up to the first scan's header, without application notes but for the flag that tells how colours are stored."""
    scan = first_of(data, SOS)["offset"]
    kept = [s for s in segments(data) if s["offset"] <= scan and s["marker"] != SOI and not (APP0 <= s["marker"] <= APP0 + 15 and s["marker"] != APP14)]
    return b"\xff\xd8" + b"".join(data[s["offset"] : s["offset"] + s["length"]] for s in kept)


def plausible_scan(data: bytes, at: int) -> bool:
    """Whether a scan header at a place is as long as its number of components asks."""
    if at + 5 > len(data) or data[at : at + 2] != b"\xff\xda":
        return False
    length, n = int.from_bytes(data[at + 2 : at + 4]), data[at + 4]
    return 1 <= n <= 4 and length == 6 + 2 * n and at + 2 + length <= len(data)


def last_plausible_scan(data: bytes) -> int | None:
    at = len(data)
    while (at := data.rfind(b"\xff\xda", 0, at)) >= 0:
        if plausible_scan(data, at) and at < len(data) - 5:
            return at
    return None


def own_body(data: bytes) -> int | None:
    """Where the body begins under a header that is intact."""
    if data[:2] != b"\xff\xd8":
        return None
    found = list(segments(data))
    scan = next((s for s in found if s["marker"] == SOS), None)
    frame = next((s for s in found if s["marker"] in FRAMES), None)
    return scan["end"] if scan and frame and frame["offset"] < scan["offset"] and plausible_scan(data, scan["offset"]) else None


@step
def header_graft(data: bytes, g: Pcg32, other: bytes, skip: int = 0, keep_exif: bool = False, neutralise_markers: bool = True) -> bytes:
    """The body of a file, from ``skip`` bytes on, under another photo's header; stray markers in it made harmless.

    A destroyed header is skipped up to its last plausible scan header, or from the first byte on if ``skip`` is given.
    """
    header = header_of(other, keep_exif)
    own, last = own_body(data), last_plausible_scan(data)
    start = own if own is not None else 0 if skip > 0 or last is None else last + 2 + int.from_bytes(data[last + 2 : last + 4])
    body = data[min(start + max(skip, 0), len(data)) :]
    if neutralise_markers:
        restarts = next((s for s in segments(header) if s["marker"] == DRI), None)
        if restarts is None or not int.from_bytes(header[restarts["start"] : restarts["start"] + 2]):
            until = len(body)
        else:
            until = 0 if own is not None else last_plausible_scan(body) or 0
        b = np.frombuffer(body, np.uint8).copy()
        n = max(0, min(until, len(b) - 1))
        b[:n][(b[:n] == 0xFF) & (b[1 : n + 1] >= 0xD0) & (b[1 : n + 1] <= 0xD7)] = 0xFE
        body = neutralised(b.tobytes())
    return header + body


def exif_block(data: bytes) -> dict | None:
    """The Exif segment before the first scan."""
    for s in segments(data):
        if s["marker"] == SOS:
            return None
        if s["marker"] == APP1 and data[s["start"] : s["end"]].startswith(EXIF):
            return s
    return None


def exif_entries(data: bytes) -> list[dict]:
    """Entries of the first directory of the Exif block: tag, kind, count, value (of one short or long) and its place."""
    block = exif_block(data)
    if block is None:
        return []
    low, high = block["start"] + 6, block["end"]
    order = {b"II": "<", b"MM": ">"}.get(data[low : low + 2])
    if order is None or high - low < 10:
        return []
    at = low + struct.unpack_from(order + "I", data, low + 4)[0]
    if at + 2 > high:
        return []
    out = []
    for i in range(min(struct.unpack_from(order + "H", data, at)[0], 512)):
        e = at + 2 + 12 * i
        if e + 12 > high:
            break
        tag, kind, count = struct.unpack_from(order + "HHI", data, e)
        value = struct.unpack_from(order + {3: "H", 4: "I"}[kind], data, e + 8)[0] if count == 1 and kind in (3, 4) else None
        out.append({"tag": tag, "kind": kind, "count": count, "value": value, "place": e + 8, "order": order})
    return out


@step
def exif_orientation(data: bytes, g: Pcg32, value: int = 6) -> bytes:
    """Another rotation in the Exif block, a wrong one for values that mean nothing. The block is written anew; files without one get one."""
    value = value if 1 <= value <= 8 else 0x5A5A
    block = exif_block(data)
    tree = (exif.parsed(data[block["start"] : block["end"]]) if block else None) or exif.Tree()
    tree.main = sorted([e for e in tree.main if e.tag != ORIENTATION] + [exif.Entry(ORIENTATION, 3, 1, struct.pack(tree.order + "H", value))], key=lambda e: e.tag)
    return with_exif(data, exif.written(tree))


@step
def exif_corrupt(data: bytes, g: Pcg32, rate: float = 0.05) -> bytes:
    """Random bytes over a share of the Exif block, and from a fifth on its directory follows itself."""
    if exif_block(data) is None:
        data = exif_orientation(data, g, 1)
    block, rate = exif_block(data), min(max(rate, 0.0), 1.0)
    low, high = block["start"] + 14, block["end"]
    if high <= low:
        raise ValueError("the Exif block is too small")
    out = bytearray(data)
    for _ in range(int(np.ceil((high - low) * rate))):
        at = low + g.below(high - low)
        out[at] = g.one() & 255
    head = block["start"] + 6
    if rate >= 0.2 and head + 10 <= high:
        order = "<" if data[head : head + 2] == b"II" else ">"
        after = head + 10 + 12 * struct.unpack_from(order + "H", data, head + 8)[0]
        if after + 4 <= high:
            struct.pack_into(order + "I", out, after, 8)
    return bytes(out)



# Quantisation tables of the JPEG standard (ITU T.81, K.1 and K.2) by rows.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, *[99] * 38]


def quality_table(number: int, quality: int) -> list[int]:
    """The standard table of a number at a quality of 1 to 100, in the order of files."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    natural, place = LUMA if number == 0 else CHROMA, zigzag()
    return [min(max((natural[k] * scale + 50) // 100, 1), 255) for k in sorted(range(64), key=place.__getitem__)]


def quantisation(data: bytes) -> list[tuple[int, int, list[int]]]:
    """(precision, number, values in the order of files) of all quantisation tables; values that are cut off count as 1."""
    out = []
    for s in segments(data):
        at, payload = 0, data[s["start"] : s["end"]]
        while s["marker"] == DQT and at < len(payload):
            wide, width = payload[at] >> 4, 2 if payload[at] >> 4 else 1
            body = payload[at + 1 : at + 1 + 64 * width]
            values = [int.from_bytes(body[k : k + width]) if k + width <= len(body) else 1 for k in range(0, 64 * width, width)]
            out.append((wide, payload[at] & 15, values))
            at += 1 + 64 * width
    return out


@step
def qtable_decode_swap(data: bytes, g: Pcg32, mode: str = "scale", factor: float = 2.0, quality: int = 10) -> bytes:
    """Other quantisation tables in the header, while the data stays: scaled ones, the first two swapped, or those of a quality.

    The first segment of tables takes all of them; later ones go.
    """
    tables = quantisation(data)
    if not tables:
        raise ValueError("no quantisation tables found")
    if mode == "swap":
        place = {number: k for k, (_, number, _) in reversed(list(enumerate(tables)))}
        if 0 in place and 1 in place:
            (a, b), own = (place[0], place[1]), [t[2] for t in tables]
            own[a], own[b] = own[b], own[a]
            tables = [(w, n, v) for (w, n, _), v in zip(tables, own, strict=True)]
    elif mode == "table":
        tables = [(w, n, quality_table(n, min(max(quality, 1), 100))) for w, n, _ in tables]
    else:
        factor = min(max(factor, 0.01), 100.0)
        tables = [(w, n, [int(min(max(float(int(v * factor + 0.5)), 1), 65535 if w else 255)) for v in values]) for w, n, values in tables]
    payload = b"".join(bytes([w << 4 | n]) + b"".join(v.to_bytes(2) if w else bytes([v & 255]) for v in values) for w, n, values in tables)
    out, at, new = [], 0, segment(DQT, payload)
    for s in segments(data):
        if s["marker"] == DQT:
            out += [data[at : s["offset"]], new]
            at, new = s["offset"] + s["length"], b""
    return b"".join(out) + data[at:]


def plausible_frame(data: bytes, at: int) -> int:
    """The area that a frame header at a place tells, if it is one of 8 bits whose length fits its components; else 0."""
    if at + 10 >= len(data) or data[at + 1] not in (0xC0, 0xC1, 0xC2) or data[at + 4] != 8:
        return 0
    (length,), (high, wide), n = struct.unpack_from(">H", data, at + 2), struct.unpack_from(">HH", data, at + 5), data[at + 9]
    return high * wide if n in (1, 3, 4) and length == 8 + 3 * n else 0


@step
def repair_header(data: bytes, g: Pcg32) -> bytes:
    """A file whose headers the walk doesn't find, from the largest plausible frame in it on, with the tables up to 4 KB before it.

    As when a wrong length makes a note swallow them; the largest frame, so that a small picture in a note loses.
    """
    if any(s["marker"] in FRAMES for s in segments(data)):
        raise ValueError("the header is whole")
    best, area, at = -1, 0, data.find(b"\xff", 2)
    while at >= 0:
        if (here := plausible_frame(data, at)) > area:
            best, area = at, here
        at = data.find(b"\xff", at + 1)
    if best < 0:
        raise ValueError("no frame header in the file")
    start = best
    at = data.find(b"\xff\xdb", max(best - 4096, 0), best)
    while at >= 0:
        length = int.from_bytes(data[at + 2 : at + 4])
        if length >= 67 and (length - 2) % 65 == 0 and at + 2 + length <= best + 2:
            start = at
            break
        at = data.find(b"\xff\xdb", at + 1, best)
    return b"\xff\xd8" + data[start:]


def signature_table(photos: DataFrame, key: str = "photo_id", column: str = "bytes") -> DataFrame:
    """(key, frame, tables): what tells the camera's mode of a photo, as hashes: its frame header, and its quantisation and Huffman tables.

    Photos without a frame before their scan have nulls.
    """
    kind = dict(photos.dtypes)[key]

    def look(data: bytes | None) -> tuple[str | None, str | None]:
        frame, tables = None, hashlib.sha256()
        for wanted in (DQT, DHT):
            tables.update(b"|")
            for s in segments(data or b""):
                if s["marker"] == SOS:
                    break
                if s["marker"] == wanted:
                    tables.update(data[s["start"] : s["end"]])
                if s["marker"] in FRAMES and frame is None:
                    frame = hashlib.sha256(data[s["start"] : s["end"]]).hexdigest()
        return frame, tables.hexdigest() if frame else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [look(b) for b in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([f[k] for f in found], pa.string()) for k in (0, 1))], names=[key, "frame", "tables"])

    return photos.select(key, column).mapInArrow(run, f"{key} {kind}, frame string, tables string")
