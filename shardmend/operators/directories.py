"""Directory trees of memory cards: entries read out of cluster bytes, and a walk over them level by level.

A level's directories get their chains by the allocation table, their clusters by a join, and their entries by a scan of
the joined bytes, so that sets of entries may cross clusters that lie anywhere. Directories found are the next level. A
level is one set of joins over all cards; nothing holds a card. A directory is one row, bounded by what a file system
allows it; names are read as two kinds of file system write them: 32-byte entries with short names, and sets of entries
with long ones.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.operators import cards

#: Levels below the root that are looked into, and bytes of a file that are read at most.
DEPTH, MOST = 6, 48 << 20
ENTRY = "name string, first long, size long, is_dir boolean, deleted boolean, contiguous boolean, slot int"
# Attributes of entries, and types of the members of a set; a type without its top bit is deleted.
VOLUME, FOLDER, LONG_NAME, DELETED = 0x08, 0x10, 0x0F, 0xE5
FILE_SET, IN_USE, NO_CHAIN = 0x05, 0x80, 0x02


def short_entries(data: bytes, wide: bool) -> Iterator[tuple]:
    """Entries of 32 bytes with names of 8 and 3 characters; volume labels, pieces of long names and dots are passed over."""
    for slot, at in enumerate(range(0, len(data) - 31, 32)):
        raw, attributes, high, low, size = struct.unpack_from("<11sB8xH4xHI", data, at)
        if raw[0] == 0:
            return
        if attributes & VOLUME or attributes == LONG_NAME or raw[0] == 0x2E:
            continue
        deleted = raw[0] == DELETED
        shown = "".join(chr(b) if 32 <= b < 127 else "_" for b in (b"_" + raw[1:] if deleted else raw))
        stem, suffix = shown[:8].rstrip(), shown[8:].rstrip()
        yield f"{stem}.{suffix}" if suffix else stem, (high << 16 if wide else 0) | low, size, bool(attributes & FOLDER), deleted, False, slot


def set_entries(data: bytes) -> Iterator[tuple]:
    """Sets of a file entry, a stream entry and name entries of 15 characters each; a set that the directory cuts off is none."""
    slot, slots = 0, len(data) // 32
    while slot < slots and (kind := data[32 * slot]):
        if kind & ~IN_USE != FILE_SET:
            slot += 1
            continue
        others, (attributes,) = data[32 * slot + 1], struct.unpack_from("<H", data, 32 * slot + 4)
        if others >= 2 and slot + others < slots:
            stream = 32 * (slot + 1)
            flags, length, size, first = data[stream + 1], data[stream + 3], *struct.unpack_from("<Q4xI", data, stream + 8)
            name = b"".join(data[at + 2 : at + 32] for at in range(stream + 32, 32 * (slot + others) + 1, 32))[: 2 * length]
            yield name.decode("utf-16-le", "replace"), first, min(size, (1 << 63) - 1), bool(attributes & FOLDER), not kind & IN_USE, bool(flags & NO_CHAIN), slot
        slot += 1 + others


def entries(directories: DataFrame) -> DataFrame:
    """Every entry of ``directories`` (.., fs, bytes), with their other columns. ``fs``: fat16, fat32 or exfat."""
    carried = [c for c in directories.columns if c not in ("fs", "bytes")]
    kinds = dict(directories.dtypes)
    fields = [x.split() for x in ENTRY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}
        for batch in batches:
            both = zip(batch.column("fs").to_pylist(), batch.column("bytes").to_pylist(), strict=True)
            rows = [(i, *e) for i, (fs, data) in enumerate(both) for e in (set_entries(data or b"") if fs == "exfat" else short_entries(data or b"", fs == "fat32"))]
            whose = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            own = [pa.array([r[k] for r in rows], types[t]) for k, (_, t) in enumerate(fields, 1)]
            yield pa.RecordBatch.from_arrays([*(whose.column(c) for c in carried), *own], names=[*carried, *(n for n, _ in fields)])

    return directories.select(*carried, "fs", "bytes").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), ENTRY]))


def walk(volumes: DataFrame, table: DataFrame, stored: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(card_id, fs, last, dir, slot, name, first, size, deleted, contiguous): every file that the trees of ``volumes`` name.

    ``volumes``: (card_id, fs, root, last), the first cluster of the root and the last of the card. ``table``: (card_id,
    cluster, next). ``stored``: (card_id, cluster, bytes). Names hold the path; a file in a deleted directory is deleted.
    Each directory is read once, at the level that is nearest to the root and, there, under the first of its paths, so
    loops end. Directories that begin outside the card are passed over.
    """
    jumps = cards.Jumps(table)
    level = volumes.select("card_id", "fs", "last", F.col("root").cast("long").alias("dir"), F.lit("").alias("path"), F.lit(False).alias("gone")).checkpoint()
    seen, found = level.select("card_id", "dir"), None
    for _ in range(depth + 1):
        heads = level.select("card_id", F.col("dir").alias("head"))
        clusters = cards.follow_chains(table, heads, jumps).withColumnRenamed("head", "dir")
        data = clusters.join(stored, ["card_id", "cluster"]).groupBy("card_id", "dir").agg(cards.in_order("bytes", "pos").alias("bytes"))
        every = entries(level.join(data, ["card_id", "dir"])).checkpoint()
        inside = every.withColumn("name", F.concat("path", "name")).withColumn("deleted", F.col("deleted") | F.col("gone"))
        kinds = volumes.select("card_id", "fs")
        files = inside.where("NOT is_dir").join(kinds, "card_id").select("card_id", "fs", "last", "dir", "slot", "name", "first", "size", "deleted", "contiguous")
        found = files if found is None else found.unionByName(files)
        below = inside.where("is_dir AND first >= 2 AND first <= last").select("card_id", "last", F.col("first").alias("dir"), F.concat("name", F.lit("/")).alias("path"), F.col("deleted").alias("gone"))
        first = below.groupBy("card_id", "dir").agg(F.min(F.struct("path", "gone", "last")).alias("p")).join(seen, ["card_id", "dir"], "left_anti")
        level = first.join(kinds, "card_id").select("card_id", "fs", "p.last", "dir", "p.path", "p.gone").checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level.select("card_id", "dir"))
    return found


# What is said of a file by the way that it was read.
NOTES = {
    "chain": "read through the FAT chain",
    "kept": "undeleted along the FAT chain exFAT kept",
    "skipping": "undeleted from the start cluster on, skipping clusters in use by other files",
    "run": "undeleted assuming contiguous clusters",
    "cleared": "undeleted assuming contiguous clusters (FAT32 cleared the high start-cluster bits)",
    "contiguous": "contiguous file (exFAT NoFatChain)",
    "empty": "0 bytes in directory entry (interrupted write?)",
    "outside": "start cluster # is outside the card: can't recover",
}


def way(undelete: str) -> Column:
    """How a file of ``walk`` is read; null for those that are left out. ``undelete``: none, skipping or run."""
    exfat, deleted, contiguous = F.col("fs") == "exfat", F.col("deleted"), F.col("contiguous")
    some = undelete != "none"
    lost = F.when(exfat & ~contiguous, "kept").otherwise("skipping") if undelete == "skipping" else F.when(F.col("fs") == "fat32", "cleared").otherwise("run")
    return (
        F.when(deleted & F.lit(not some), None).when(F.col("size") == 0, "empty" if some else None)
        .when((F.col("first") < 2) | (F.col("first") > F.col("last")), "outside" if some else None)
        .when(deleted, lost).when(exfat & contiguous, "skipping" if undelete == "skipping" else "contiguous").otherwise("chain")
    )


def read_files(files: DataFrame, table: DataFrame, stored: DataFrame, in_use: DataFrame, cluster: int, undelete: str = "none") -> DataFrame:
    """(card_id, name, size, note, bytes) of files that ``walk`` found, deleted ones too if asked for.

    ``in_use``: (card_id, cluster) that files hold by now. Deleted files are read along chains that the file system kept,
    past clusters in use (``skipping``), or as one run from their first cluster on (``run``). Clusters that aren't stored
    read as zeros; a file ends with its card, and after MOST bytes.
    """
    key = ["card_id", "dir", "slot"]
    files = files.withColumn("way", way(undelete)).where("way IS NOT NULL").withColumn("size", F.least("size", F.lit(MOST)))
    name = F.when(F.col("deleted") & (F.col("fs") != "exfat"), F.regexp_replace("name", "(?s)^(.*?)/_", "$1/~")).otherwise(F.col("name"))
    files = files.select("card_id", "dir", "slot", name.alias("name"), "first", "last", "size", "way").checkpoint()
    n = F.ceil(F.col("size") / cluster)
    chained = files.where("way IN ('chain', 'kept')")
    reached = cards.follow_chains(table, chained.select("card_id", F.col("first").alias("head")).distinct())
    by_chain = chained.join(reached.withColumnRenamed("head", "first"), ["card_id", "first"]).where(F.col("pos") < n).select(*key, "pos", "cluster")
    ends = F.least(F.col("first") + n - 1, F.col("last")).cast("long")
    by_run = files.where("way IN ('run', 'cleared', 'contiguous')").select(*key, F.posexplode(F.sequence("first", ends)).alias("pos", "cluster"))
    # The n-th free cluster from the start on; files of a card are told apart by where they stand.
    skipping = files.where("way = 'skipping'").select("card_id", F.struct("dir", "slot").alias("file_no"), "size", "first")
    last = files.groupBy("card_id").agg(F.max("last").alias("last"))
    by_free = cards.undelete_skipping(skipping, in_use, last, cluster).select("card_id", "file_no.dir", "file_no.slot", "pos", "cluster")
    chains = by_chain.unionByName(by_run.withColumn("pos", F.col("pos").cast("long"))).unionByName(by_free.withColumn("pos", F.col("pos").cast("long")))
    read = cards.read_chains(chains, stored, files.select(*key, "size"), key, cluster)
    note = F.replace(F.create_map(*[F.lit(x) for pair in NOTES.items() for x in pair])[F.col("way")], F.lit("#"), F.col("first").cast("string"))
    whole = files.join(read, key, "left").withColumn("bytes", F.coalesce("bytes", F.unhex(F.lit(""))))
    return whole.select("card_id", "name", F.length("bytes").cast("long").alias("size"), note.alias("note"), "bytes")
