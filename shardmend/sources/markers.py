"""JPEG structure as rows: segments, the range of entropy-coded data, marker-level edits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SOI, EOI, SOS, DQT, DHT, DRI, SOF0 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0
# Names of the markers that files are made of.
NAMES = {0x01: "TEM", 0xFE: "COM"} | {0xC0 + i: f"SOF{i}" for i in range(16)} | {0xD0 + i: "RST" for i in range(8)} | {0xE0 + i: f"APP{i}" for i in range(16)}
NAMES |= {0xC4: "DHT", 0xC8: "JPG", 0xCC: "DAC", 0xD8: "SOI", 0xD9: "EOI", 0xDA: "SOS", 0xDB: "DQT", 0xDC: "DNL", 0xDD: "DRI", 0xDE: "DHP", 0xDF: "EXP"}
FRAMES = frozenset(0xC0 + i for i in range(16)) - {0xC4, 0xC8, 0xCC}
#: Headers up to the first scan are about this long where a payload has none.
HEADER_GUESS = 624
SEGMENT_SCHEMA = "seq int, offset int, marker int, name string, length int, start int, end int, truncated boolean, scan_end int"


def scan_end(data: bytes, at: int) -> int:
    """Where entropy-coded data ends: at the first marker other than a restart, or with the payload."""
    while (at := data.find(b"\xff", at)) >= 0 and at + 1 < len(data):
        code = data[at + 1]
        if code == 0xFF:
            at += 1
        elif code == 0 or 0xD0 <= code <= 0xD7:
            at += 2
        else:
            return at
    return len(data)


def segments(data: bytes) -> Iterator[dict]:
    """Segments of a JPEG file: bytes that are no known marker are skipped, as are fill bytes; a file ends at its end marker.

    ``length`` counts the marker and its length field too, and is cut to what the payload holds.
    """
    at, seq, size = data.find(b"\xff"), 0, len(data)
    while 0 <= at < size - 1:
        code = data[at + 1]
        if code not in NAMES:
            at = data.find(b"\xff", at + 1)
            continue
        alone = code in (SOI, EOI, 1) or 0xD0 <= code <= 0xD7
        declared = 0 if alone else max(2, int.from_bytes(data[at + 2 : at + 4])) if at + 3 < size else 2
        end = min(at + 2 + declared, size)
        yield {
            "seq": seq, "offset": at, "marker": code, "name": NAMES[code], "length": end - at, "start": end if alone else min(at + 4, size), "end": end,
            "truncated": at + 2 + declared > size, "scan_end": (scan := scan_end(data, end)) if code == SOS else None,
        }
        if code == EOI:
            return
        seq += 1
        at = data.find(b"\xff", scan if code == SOS else end)


def scan_range(data: bytes) -> tuple[int, int]:
    """Bytes of entropy-coded data, from the first scan to the end of the last; without one, all that follows the headers."""
    found = list(segments(data))
    scans = [s for s in found if s["marker"] == SOS]
    if scans:
        low, high = scans[0]["end"], scans[-1]["scan_end"]
        return low, high if high > low else len(data)
    return max((s["offset"] + s["length"] for s in found if s["marker"] != EOI), default=0), len(data)


def scan_start(data: bytes) -> int | None:
    """Where the first scan begins, if nothing but segments comes before it."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        if data[at + 1] == 0xFF:
            at += 1
            continue
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4])
        if data[at + 1] == SOS:
            return min(end, len(data))
        at = end
    return None


def body_start(data: bytes, protect: bool = True) -> int:
    """Where damage may begin if headers are spared."""
    if not protect:
        return 0
    start = scan_start(data)
    return min(len(data), HEADER_GUESS) if start is None else start


def segment_table(photos: DataFrame, key: str = "photo_id", column: str = "bytes") -> DataFrame:
    """One row for each segment of each payload."""
    kind = dict(photos.dtypes)[key]
    fields = [x.split()[0] for x in SEGMENT_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(key)
            rows = [(i, s) for i, b in enumerate(batch.column(column).to_pylist()) for s in segments(b or b"")]
            types = {"name": pa.string(), "truncated": pa.bool_()}
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([i for i, _ in rows], pa.int64())), *(pa.array([s[f] for _, s in rows], types.get(f, pa.int32())) for f in fields)], names=[key, *fields])

    return photos.select(key, column).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"`{x.split()[0]}` {x.split()[1]}" for x in SEGMENT_SCHEMA.split(", ")))


FRAME_SCHEMA = "size long, width int, height int, sof int, progressive boolean, components int, mcu_width int, mcu_height int, mcu_cols int, mcu_rows int, restart_interval int, scans int, trailing_bytes long, garbage_bytes long, eoi_offset long"


def inspected(data: bytes) -> tuple:
    """What the headers of a photo tell, and what of it is no part of a segment, in the order of FRAME_SCHEMA.

    Bytes between segments are garbage but for fill bytes; those behind the end marker are trailing. A photo without a
    frame has nulls for it.
    """
    found, size = list(segments(data)), len(data)
    frame = next((s for s in found if s["marker"] in FRAMES), None)
    told: tuple = (None,) * 9
    if frame is not None:
        payload = data[frame["start"] : frame["end"]]
        high, wide = int.from_bytes(payload[1:3]), int.from_bytes(payload[3:5])
        parts = [payload[b : b + 3] for b in range(6, 6 + 3 * min(payload[5] if len(payload) > 5 else 0, 4), 3)]
        factors = [(min(max(p[1] >> 4, 1), 4), min(max(p[1] & 15, 1), 4)) for p in parts if len(p) == 3]
        x, y = (8, 8) if len(factors) == 1 else (8 * max((f[0] for f in factors), default=1), 8 * max((f[1] for f in factors), default=1))
        told = wide, high, frame["marker"], frame["marker"] in (0xC2, 0xC6, 0xCA, 0xCE), len(factors), x, y, max(-(-wide // x), 1), max(-(-high // y), 1)
    ended = bool(found) and found[-1]["marker"] == EOI
    garbage, at = 0, 0
    for low, high in [*((s["offset"], s["scan_end"] or s["end"]) for s in found), *([] if ended else [(size - 1, size)])]:
        gap = data[at : low + 1]
        garbage += max(low - at, 0) - sum(gap[k] == 0xFF == gap[k + 1] for k in range(max(low - at, 0)))
        at = max(at, high)
    restart = next((int.from_bytes(data[s["start"] : s["start"] + 2]) for s in found if s["marker"] == DRI), 0)
    return size, *told, restart, sum(s["marker"] == SOS for s in found), size - found[-1]["end"] if ended else 0, garbage, found[-1]["offset"] if ended else None


def frame_table(photos: DataFrame, key: str = "photo_id", column: str = "bytes") -> DataFrame:
    """One row of FRAME_SCHEMA for each payload; null payloads are like empty ones."""
    fields = [x.split() for x in FRAME_SCHEMA.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [inspected(b or b"") for b in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields))], names=[key, *(n for n, _ in fields)])

    return photos.select(key, column).mapInArrow(run, f"{key} {dict(photos.dtypes)[key]}, {FRAME_SCHEMA}")


def photo_end(data: bytes) -> int | None:
    """Where a photo ends, after the end marker that follows its scans; None if it is cut short."""
    last = list(segments(data))[-1:]
    return last[0]["end"] if last and last[0]["marker"] == EOI else None


def strict_end(data: bytes) -> int | None:
    """Where a photo ends, if nothing but segments and scans comes before its end marker."""
    at = 2
    if data[:2] != b"\xff\xd8" or len(data) < 4:
        return None
    while at + 4 <= len(data):
        scanned = data[at] != 0xFF
        while not scanned and at + 4 <= len(data) and data[at] == 0xFF:
            code = data[at + 1]
            if code == EOI:
                return at + 2
            at += 1 if code == 0xFF else 2 + int.from_bytes(data[at + 2 : at + 4])
            scanned = code == SOS
        at = scan_end(data, at)
        if at + 1 >= len(data):
            return None
        if data[at + 1] == EOI:
            return at + 2
    return None


def has_tables(data: bytes) -> bool:
    """Whether Huffman tables come before the first scan."""
    for s in segments(data):
        if s["marker"] in (DHT, SOS):
            return s["marker"] == DHT
    return False


def _values(first: str, most: int = 10) -> bytes:
    """The symbols of a table of standard codes: those of short codes, then the rest in order."""
    short = bytes.fromhex(first)
    every = {0x00, 0xF0} | {16 * run + size for run in range(16) for size in range(1, most + 1)}
    return short + bytes(sorted(every - set(short)))


# Standard Huffman tables of the JPEG standard (ITU T.81, K.3): class and number, codes of each length, symbols.
STANDARD_TABLES = b"".join(
    (
        bytes.fromhex("00 00010501010101010100000000000000") + bytes(range(12)),
        bytes.fromhex("10 0002010303020403050504040000017D")
        + _values("01020300041105122131410613516107227114328191A1082342B1C11552D1F02433627282"),
        bytes.fromhex("01 00030101010101010101010000000000") + bytes(range(12)),
        bytes.fromhex("11 00020102040403040705040400010277")
        + _values("0001020311040521310612415107617113223281081442 91A1B1C109233352F0156272D10A162434E125F1"),
    )
)


def with_standard_tables(data: bytes) -> bytes:
    """A photo with the standard tables before its first scan, where it has none of its own."""
    at = None
    for s in segments(data):
        if s["marker"] == DHT:
            return data
        if s["marker"] == SOS and at is None:
            at = s["offset"]
    if at is None:
        return data
    return data[:at] + b"\xff\xc4" + (len(STANDARD_TABLES) + 2).to_bytes(2) + STANDARD_TABLES + data[at:]


def neutralised(data: bytes) -> bytes:
    """Every FF that starts a marker other than a restart becomes FE; the last three bytes stay."""
    b = np.frombuffer(data, np.uint8).copy()
    if len(b) > 3:
        after = b[1:-2]
        bad = (b[:-3] == 0xFF) & (after != 0) & ((after < 0xD0) | (after > 0xD7))
        b[:-3][bad] = 0xFE
    return b.tobytes()


def fake_photo(seed: int, length: int) -> bytes:
    """A JPEG file of about ``length`` bytes with one table, one frame and a scan of seeded noise."""
    from shardmend.functions.prng import Pcg32

    table = bytes.fromhex("ffdb004300") + bytes(range(1, 65))
    frame = bytes.fromhex("ffc00011 08 0010 0010 03 012200 021100 031100")
    head = b"\xff\xd8" + table + frame + bytes.fromhex("ffda000c 03 0100 0200 0300 003f00")
    noise = (Pcg32(seed, 1).draw(max(length - len(head) - 2, 0)) & np.uint64(255)).astype(np.uint8).tobytes().replace(b"\xff", b"\xff\x00")
    return head + noise[: max(length - len(head) - 2, 0)].rstrip(b"\xff") + b"\xff\xd9"
