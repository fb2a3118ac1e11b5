"""Byte-level damage that draws from a seed: ``step(bytes, generator, **params) -> bytes``.

Each row has its own generator, so results do not depend on partitions. Kernels get the payload and the range of bytes
that may be damaged, and Spark runs them over Arrow batches.
"""

from __future__ import annotations

import base64
import inspect
import re
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shardmend.functions.batches import small
from shardmend.functions.prng import STEP_STREAM, Pcg32
from shardmend.sources.markers import body_start, scan_range

STEPS: dict[str, Callable] = {}
#: Other names of steps, and of parameters, that recipes may use.
ALIASES = {"ransomware_partial": "ransomware"}
PARAMETERS = {"hex": "hexed", "sectors": "sectors_each"}


def step(f: Callable) -> Callable:
    STEPS[f.__name__] = f
    return f


@cache
def _takes(kernel: Callable) -> dict[str, object]:
    return {n: p.default for n, p in list(inspect.signature(kernel).parameters.items())[2:]}


def takes_other(name: str) -> bool:
    """Whether a step needs another payload."""
    return "other" in _takes(STEPS[ALIASES.get(name, name)])


def run_step(name: str, data: bytes, g: Pcg32, params: dict, other: bytes | None = None) -> bytes:
    """One step. Parameters that it doesn't know are ignored, and a payload that it cannot be applied to stays as it is."""
    return try_step(name, data, g, params, other)[0]


def try_step(name: str, data: bytes, g: Pcg32, params: dict, other: bytes | None = None) -> tuple[bytes, str | None]:
    """What a step makes, and why it could not be applied; then the payload is what it was.

    A step refuses a payload by ValueError, or by reaching past its end. Anything else is a fault of the step and is raised.
    """
    kernel = STEPS.get(ALIASES.get(name, name))
    if kernel is None:
        return data, f'step "{name}" is not available yet'
    takes, given = _takes(kernel), {}
    for k, v in params.items():
        k = PARAMETERS.get(k, k)
        if k in takes and k != "other":
            try:
                given[k] = type(takes[k])(v) if isinstance(takes[k], (int, float)) and not isinstance(takes[k], bool) else v
            except (TypeError, ValueError):
                return data, f"parameter {k} can't be {v!r}"
    if "other" in takes:
        if other is None:
            return data, "no other payload to take from"
        given["other"] = other
    try:
        return kernel(data, g, **given), None
    except (ValueError, IndexError) as refused:
        return data, str(refused)


def cut(data: bytes, start: float, end: float) -> tuple[int, int]:
    """The part of the scan between two percentages."""
    a, b = scan_range(data)
    low, high = sorted((min(max(x, 0.0), 100.0) for x in (start, end)))
    return a + int((b - a) * low / 100), a + int((b - a) * high / 100)


def places(g: Pcg32, a: int, b: int, n: int) -> list[int]:
    """Sorted random places in [a, b)."""
    return sorted((a + g.draw(n).astype(np.int64) % (b - a)).tolist()) if b > a else []


@step
def bitflip(data: bytes, g: Pcg32, rate: float = 3.0, start: float = 0, end: float = 100) -> bytes:
    """About ``rate`` flipped bits in 100 KB, at least one."""
    a, b = cut(data, start, end)
    expect = (b - a) * rate / 102400
    n = int(expect) + (g.unit() < expect - int(expect))
    out = bytearray(data)
    at = places(g, a, b, max(n, 1) if rate > 0 else n)
    # Eight divides the range of a draw, so that none is thrown away.
    for p, bit in zip(at, (g.draw(len(at)) & np.uint64(7)).tolist(), strict=True):
        out[p] ^= 1 << bit
    return bytes(out)


@step
def byte_delete(data: bytes, g: Pcg32, count: int = 1, length: int = 1, start: float = 20, end: float = 80) -> bytes:
    """Stretches taken out at random places, the last first."""
    out = bytearray(data)
    for p in reversed(places(g, *cut(data, start, end), min(max(count, 1), 1000))):
        del out[p : p + min(max(length, 1), 1 << 20)]
    return bytes(out)


@step
def byte_insert(data: bytes, g: Pcg32, count: int = 1, length: int = 4, hexed: str = "", start: float = 20, end: float = 80) -> bytes:
    """Given or random bytes put in at random places; those of the last place are drawn first."""
    out, digits = bytearray(data), re.sub("[^0-9A-Fa-f]", "", hexed)
    given = bytes.fromhex(digits[: len(digits) // 2 * 2])[: 1 << 16]
    for p in reversed(places(g, *cut(data, start, end), min(max(count, 1), 1000))):
        out[p:p] = given if given else (g.draw(min(max(length, 1), 1 << 16)) & np.uint64(255)).astype(np.uint8).tobytes()
    return bytes(out)


@step
def fake_marker(data: bytes, g: Pcg32, marker: str = "rst", count: int = 1, start: float = 10, end: float = 90) -> bytes:
    """Stray markers put in at random places, the last first."""
    fixed = {"eoi": 0xD9, "sos": 0xDA, "soi": 0xD8, "dht": 0xC4}
    out = bytearray(data)
    for p in reversed(places(g, *cut(data, start, end), min(max(count, 1), 10_000))):
        code = fixed[marker] if marker in fixed else 1 + g.one() % 254 if marker == "random" else 0xD0 + g.below(8)
        out[p:p] = bytes((0xFF, code))
    return bytes(out)


@step
def zero_run(data: bytes, g: Pcg32, count: int = 3, length: int = 4096, start: float = 0, end: float = 100) -> bytes:
    """Runs of zeros at random places, up to the end of the range."""
    a, b = cut(data, start, end)
    out = np.frombuffer(data, np.uint8).copy()
    for p in places(g, a, b, min(max(count, 1), 100)):
        out[p : min(p + min(max(length, 1), 1 << 20), b)] = 0
    return out.tobytes()


@step
def ransomware(data: bytes, g: Pcg32, kb: int = 64) -> bytes:
    """The first kilobytes covered by a key stream, four bytes to a draw, low byte first."""
    n = min(kb * 1024, len(data))
    key = g.draw(-(-n // 4)).astype("<u4").view(np.uint8)[:n]
    return (np.frombuffer(data[:n], np.uint8) ^ key).tobytes() + data[n:]


def sectors(data: bytes | bytearray, first: int, size: int) -> int:
    return max(len(data) - first, 0) // size


@step
def stutter_read(data: bytes, g: Pcg32, count: int = 2, cluster_kb: int = 8, protect_header: bool = True) -> bytes:
    """Random clusters read twice."""
    first, size, out = body_start(data, protect_header), cluster_kb * 1024, bytearray(data)
    for _ in range(min(max(count, 1), 32)):
        if (n := sectors(out, first, size)) < 2:
            break
        k = first + g.below(n) * size
        out[k:k] = out[k : k + size]
    return bytes(out)


@step
def dropped_sectors(data: bytes, g: Pcg32, count: int = 6, protect_header: bool = True) -> bytes:
    """Random sectors of 512 bytes that never arrived."""
    first, out = body_start(data, protect_header), bytearray(data)
    for _ in range(min(max(count, 1), 256)):
        if (n := sectors(out, first, 512)) < 2:
            break
        k = first + g.below(n) * 512
        del out[k : k + 512]
    return bytes(out)


# What recovery tools write over sectors that they could not read.
FILLS = {"zeros": b"\x00", "ff": b"\xff", "deadbeef": b"\xde\xad\xbe\xef", "text": b"BAD SECTOR "}


@step
def tool_fill_pattern(data: bytes, g: Pcg32, tool: str = "text", count: int = 3, sectors_each: int = 8, protect_header: bool = True) -> bytes:
    """Stretches of sectors that carry a tool's pattern."""
    first, out, fill = body_start(data, protect_header), bytearray(data), FILLS.get(tool, FILLS["text"])
    if (n := sectors(out, first, 512)) < 1:
        return data
    for _ in range(min(max(count, 1), 64)):
        k = first + g.below(n) * 512
        size = min(min(max(sectors_each, 1), 64) * 512, len(out) - k)
        out[k : k + size] = (fill * (size // len(fill) + 1))[:size]
    return bytes(out)


@step
def flash_fault(data: bytes, g: Pcg32, mode: str = "erased", count: int = 2, page_kb: int = 8, protect_header: bool = True) -> bytes:
    """Flash pages that are erased, zero, overwritten by a burst of noise, or have a bit stuck at one."""
    first, page = body_start(data, protect_header), min(max(page_kb, 2), 16) * 1024
    out = np.frombuffer(data, np.uint8).copy()
    if (n := sectors(data, first, page)) < 1:
        return data
    for _ in range(min(max(count, 1), 64)):
        k = first + g.below(n + 1) * page
        size = min(page, len(out) - k)
        if size <= 0:
            continue
        if mode == "burst":
            length = min(g.below(page // 4) + 64, size)
            at = k + g.below(size - length + 1)
            out[at : at + length] = (g.draw(length) & np.uint64(255)).astype(np.uint8)
        elif mode == "stuck_bit":
            out[k : k + size] |= np.uint8(1 << g.below(8))
        else:
            out[k : k + size] = 0 if mode == "zero" else 255
    return out.tobytes()


@step
def ftp_stretch(data: bytes, g: Pcg32, portion: float = 0.5, direction: str = "lf_to_crlf") -> bytes:
    """Line ends of one random stretch of the scan rewritten as a text-mode transfer does."""
    a, b = scan_range(data)
    if b <= a:
        return data
    size = min(max(int((b - a) * min(max(portion, 0.02), 1.0) + 0.5), 1), b - a)
    low = a + g.below(b - a - size + 1)
    # One byte of context on each side tells what an LF follows and what a CR precedes.
    if direction == "crlf_to_lf":
        part = re.sub(rb"\r(?=\n)", b"", data[low : low + size + 1])
        tail = data[low + size : low + size + 1]
        return data[:low] + (part[: len(part) - len(tail)] if tail else part) + data[low + size :]
    before = data[max(low - 1, 0) : low]
    return data[:low] + re.sub(rb"(?<!\r)\n", b"\r\n", before + data[low : low + size])[len(re.sub(rb"(?<!\r)\n", b"\r\n", before)) :] + data[low + size :]


_LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@step
def base64_damage(data: bytes, g: Pcg32, lines: int = 2, mode: str = "drop") -> bytes:
    """A mail attachment that lost or garbled lines of 76 letters after its header, read by a lenient reader."""
    whole = base64.b64encode(data)
    rows = [bytearray(whole[i : i + 76]) for i in range(0, len(whole), 76)]
    first = scan_range(data)[0] * 4 // 3 // 76 + 1
    if first >= len(rows):
        raise ValueError("too small to damage a line")
    for i in sorted({first + g.below(len(rows) - first) for _ in range(min(max(lines, 1), 10_000))}, reverse=True):
        if mode == "drop":
            del rows[i]
            continue
        for _ in range(1 + g.below(8)):
            j = g.below(len(rows[i]))
            rows[i][j] = _LETTERS[g.below(64)]
    letters = bytes(c for row in rows for c in row if c != 61)
    # A single letter left over carries no byte.
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    return base64.b64decode(letters + b"=" * (-len(letters) % 4))


@step
def chipoff_xor(data: bytes, g: Pcg32, key_len: int = 512, page_kb: int = 4, strength: float = 30, start: float = 40, shuffle: bool = False, protect_header: bool = True) -> bytes:
    """Pages of a raw chip dump that are still scrambled with the controller's key, which has a generator of its own.

    With ``shuffle``, the first two whole pages of some blocks of four change places, as under a wrong map of the chip.
    """
    first = body_start(data, protect_header)
    first += int((len(data) - first) * min(max(start, 0.0), 100.0) / 100)
    key_len = min(max(key_len, 1), 4096)
    key = (Pcg32(0x5C4A3B1E ^ g.seed, 7).draw(key_len) & np.uint64(255)).astype(np.uint8)
    out, page, share = np.frombuffer(data, np.uint8).copy(), min(max(page_kb, 2), 16) * 1024, min(max(strength, 0.0), 100.0) / 100
    starts = range(first, len(out), page)
    for at in starts:
        if g.unit() < share:
            size = min(page, len(out) - at)
            out[at : at + size] ^= np.resize(key, size)
    if shuffle and len(starts) > 2:
        for at in starts[:-1:4]:
            if g.unit() < max(share, 0.2) and at + 2 * page <= len(out):
                out[at : at + 2 * page] = np.roll(out[at : at + 2 * page], page)
    return out.tobytes()


@step
def splice(data: bytes, g: Pcg32, other: bytes, at: float = 50.0, clusters: int = 4, cluster_kb: int = 8, mode: str = "replace") -> bytes:
    """Clusters of another payload's scan put in, or over what is there, at a cluster-aligned place."""
    size = min(max(cluster_kb, 1), 64) * 1024
    want = min(max(clusters, 1), 256) * size
    (da, db), (a, b) = scan_range(other), scan_range(data)
    if db <= da:
        raise ValueError("the other payload has no data")
    low = da + g.one() % (db - da - want + 1) // size * size if db - da > want else da
    piece = other[low : min(low + want, db)]
    piece = (piece * (want // len(piece) + 1))[:want]
    place = min(max((a + int((b - a) * min(max(at, 0.0), 100.0) / 100)) // size * size, a), b)
    return data[:place] + piece + data[place + (0 if mode == "insert" else len(piece)) :]


def spliced(df: DataFrame, column: str = "bytes", other: str = "other", seed: str = "seed", **params) -> DataFrame:
    """``df`` with clusters of the payload in ``other`` spliced in; what fails passes its input on."""
    return seeded(df, "splice", column, seed, other=other, **params)


def seeded(df: DataFrame, name: str, column: str = "bytes", seed: str = "seed", stream: int = STEP_STREAM, other: str | None = None, **params) -> DataFrame:
    """``df`` with ``column`` damaged by a step; ``seed`` and ``other`` name columns. Null payloads stay null, and one that a step cannot be applied to stays as it is."""

    def run(batches):
        for batch in small(batches):
            donors = batch.column(other).to_pylist() if other else [None] * batch.num_rows
            rows = zip(batch.column(column).to_pylist(), batch.column(seed).to_pylist(), donors, strict=True)
            done = [None if b is None else run_step(name, b, Pcg32(s or 0, stream), params, o) for b, s, o in rows]
            i = batch.schema.get_field_index(column)
            yield batch.set_column(i, column, pa.array(done, pa.binary()))

    return df.mapInArrow(run, df.schema)
