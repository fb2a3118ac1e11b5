"""Exif blocks as trees of directories: read by their pointers, shown as rows, written anew with all places moved."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

PREFIX = b"Exif\0\0"
# Sizes of kinds of values; entries that point to directories; entries of the small picture in the second one.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
POINTERS = {0x8769: "exif", 0x8825: "gps"}
INTEROP, THUMB_AT, THUMB_SIZE, COMPRESSION, ORIENTATION = 0xA005, 0x0201, 0x0202, 0x0103, 0x0112
# Entries that can tell a person, a device or a place.
PRIVATE = frozenset(
    (
        0x010E, 0x013B, 0x013C, 0x8298, 0x9286, 0x927C, 0x9C9B, 0x9C9C, 0x9C9D, 0x9C9E,
        0x9C9F, 0xA420, 0xA430, 0xA431, 0xA432, 0xA433, 0xA435, 0xA437, 0xA438, 0xC62F,
    )
)
#: Entries that are read of a directory, and bytes of one value, at most.
MOST_ENTRIES, MOST_VALUE = 512, 1 << 20


@dataclass
class Entry:
    tag: int
    kind: int
    count: int
    data: bytes


@dataclass
class Tree:
    """Directories by name: main, exif, gps and second, which is that of the small picture."""

    order: str = "<"
    main: list[Entry] = field(default_factory=list)
    exif: list[Entry] = field(default_factory=list)
    gps: list[Entry] = field(default_factory=list)
    second: list[Entry] = field(default_factory=list)
    thumb: bytes | None = None


def parsed(payload: bytes) -> Tree | None:
    """The tree of an Exif payload; None if it has no header. Each directory is read once, so that circles end."""
    block = payload[len(PREFIX) :] if payload.startswith(PREFIX) else b""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return None
    left = 2 * len(block)  # honest values lie inside the block, so that is enough for all of them
    seen: set[int] = set()

    def directory(at: int) -> tuple[list[Entry], int]:
        nonlocal left
        out: list[Entry] = []
        if at in seen or at + 2 > len(block):
            return out, 0
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", block, at)
        for e in range(at + 2, at + 2 + 12 * min(n, MOST_ENTRIES), 12):
            if e + 8 > len(block):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", block, e)
            size = SIZES.get(kind, 1) * count
            if size > MOST_VALUE or size > left:
                continue
            place = e + 8 if size <= 4 else struct.unpack_from(order + "I", block, e + 8)[0] if e + 12 <= len(block) else len(block)
            if place + size <= len(block):
                left -= size
                out.append(Entry(tag, kind, count, block[place : place + size]))
        after = at + 2 + 12 * n
        return out, struct.unpack_from(order + "I", block, after)[0] if after + 4 <= len(block) else 0

    def number(entries: list[Entry], tag: int) -> int | None:
        found = next((e.data for e in entries if e.tag == tag), b"")
        return struct.unpack_from(order + "I", found)[0] if len(found) >= 4 else struct.unpack_from(order + "H", found)[0] if len(found) >= 2 else None

    tree = Tree(order)
    tree.main, following = directory(struct.unpack_from(order + "I", block, 4)[0])
    for tag, name in POINTERS.items():
        if (at := number(tree.main, tag)) is not None:
            setattr(tree, name, directory(at)[0])
    if following and following not in seen:
        tree.second = directory(following)[0]
        at, size = number(tree.second, THUMB_AT), number(tree.second, THUMB_SIZE)
        if at is not None and size is not None and at + size <= len(block):
            tree.thumb = block[at : at + size]
    return tree


def written(tree: Tree) -> bytes:
    """The payload of a tree: directories one after another, each followed by its longer values, then the small picture."""
    order = tree.order
    long_ = lambda tag, value: Entry(tag, 4, 1, struct.pack(order + "I", value))
    parts = {"main": [e for e in tree.main if e.tag not in POINTERS], "exif": [e for e in tree.exif if e.tag != INTEROP], "gps": list(tree.gps), "second": [e for e in tree.second if e.tag not in (THUMB_AT, THUMB_SIZE)]}
    parts["main"] += [long_(tag, 0) for tag, name in POINTERS.items() if parts[name]]
    parts["main"].sort(key=lambda e: e.tag)
    if tree.thumb is not None:
        parts["second"] += [long_(THUMB_AT, 0), long_(THUMB_SIZE, len(tree.thumb))]
        if not any(e.tag == COMPRESSION for e in parts["second"]):
            parts["second"].append(Entry(COMPRESSION, 3, 1, struct.pack(order + "H", 6) + b"\0\0"))
        parts["second"].sort(key=lambda e: e.tag)
    even = lambda data: data + b"\0" * (len(data) % 2)
    places, at = {}, 8
    for name, entries in parts.items():
        places[name] = at
        at += 6 + 12 * len(entries) + sum(len(even(e.data)) for e in entries if len(e.data) > 4) if entries or name == "main" else 0
    moved = {tag: places[name] for tag, name in POINTERS.items()} | {THUMB_AT: at}
    out = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    for name, entries in parts.items():
        if not entries and name != "main":
            continue
        following = places["second"] if name == "main" and parts["second"] else 0
        table, values, behind = struct.pack(order + "H", len(entries)), b"", places[name] + 6 + 12 * len(entries)
        for e in entries:
            data = struct.pack(order + "I", moved[e.tag]) if (name == "main" and e.tag in POINTERS) or (name == "second" and e.tag == THUMB_AT) else e.data
            table += struct.pack(order + "HHI", e.tag, e.kind, e.count)
            if len(data) <= 4:
                table += data.ljust(4, b"\0")
            else:
                table += struct.pack(order + "I", behind + len(values))
                values += even(data)
        out += table + struct.pack(order + "I", following) + values
    return PREFIX + out + (tree.thumb or b"")


def shown(entry: Entry, order: str) -> str:
    """A value as text: text, a number, a fraction, or how many bytes it has."""
    if entry.kind == 2:
        return entry.data.decode("utf-8", "replace").rstrip("\0").strip()
    if entry.kind in (3, 4):
        width = 4 if len(entry.data) >= 4 and entry.kind == 4 else 2
        return str(struct.unpack_from(order + "HI"[width // 4], entry.data)[0]) if len(entry.data) >= width else ""
    if entry.kind in (5, 10) and len(entry.data) >= 8:
        return "/".join(map(str, struct.unpack_from(order + ("II" if entry.kind == 5 else "ii"), entry.data)))
    return f"({len(entry.data)} bytes)"


def entry_table(photos: DataFrame, key: str = "photo_id", column: str = "bytes") -> DataFrame:
    """(key, directory, place, tag, kind, count, value): a row for each entry of every directory of the Exif block of each photo."""
    from shardmend.operators.marker_steps import exif_block

    def rows(data: bytes | None) -> Iterator[tuple]:
        block = exif_block(data or b"")
        tree = parsed(data[block["start"] : block["end"]]) if block else None
        for name in ("main", "exif", "gps", "second") if tree else ():
            for k, e in enumerate(getattr(tree, name)):
                yield name, k, e.tag, e.kind, e.count, shown(e, tree.order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"directory": pa.string(), "place": pa.int32(), "tag": pa.int32(), "kind": pa.int32(), "count": pa.int64(), "value": pa.string()}
        for batch in batches:
            found = [(i, *r) for i, b in enumerate(batch.column(column).to_pylist()) for r in rows(b)]
            whose = batch.column(key).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([whose, *(pa.array([f[k] for f in found], t) for k, t in enumerate(types.values(), 1))], names=[key, *types])

    return photos.select(key, column).mapInArrow(run, f"{key} {dict(photos.dtypes)[key]}, directory string, place int, tag int, kind int, count long, value string")
