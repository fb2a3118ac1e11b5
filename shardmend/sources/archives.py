"""Archives of stored files put together out of many rows, and taken apart by their directories.

Where an entry lies follows from running sums of sizes, taken in shards of an archive and over one row for each shard; so
do the places of its directory entries, behind the last of the files. An archive is then rows of (place, bytes), which are
gathered into parts of some megabytes by many tasks: no task holds an archive. Parts laid end to end are the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardmend.operators.cards import in_order

PART = 8 << 20
SHARD = 10_000
#: What the format can count without its extension for large archives.
MOST_ENTRIES, MOST_BYTES = 65_535, (1 << 32) - 1
# Fixed values, in hex: signatures; version 2.0 and names in UTF-8; stored, at noon of the first of January 2004.
LOCAL, CENTRAL, LAST = "504B0304", "504B0102", "504B0506"
NEEDS, STORED = "14000008", "0000" + "0060" + "2130"
LOCAL_SIZE, CENTRAL_SIZE, LAST_SIZE = 30, 46, 22


def little(n: Column, size: int) -> Column:
    """A number in hex of ``size`` bytes, low byte first."""
    whole = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(whole, 2 * k + 1, 2) for k in reversed(range(size))])


def running(rows: DataFrame, group: str, place: str, size: str, name: str) -> DataFrame:
    """``rows`` with the sum of the sizes of all before them in their group, by an integer ``place`` without repeats."""
    dealt = rows.withColumn("_shard", F.floor(F.col(place) / SHARD))
    inside = F.sum(size).over(W.partitionBy(group, "_shard").orderBy(place).rowsBetween(W.unboundedPreceding, 0)) - F.col(size)
    sums = dealt.groupBy(group, "_shard").agg(F.sum(size).alias("_sum"))
    before = sums.select(group, "_shard", (F.sum("_sum").over(W.partitionBy(group).orderBy("_shard")) - F.col("_sum")).alias("_before"))
    return dealt.withColumn("_inside", inside).join(before, [group, "_shard"]).withColumn(name, F.col("_inside") + F.col("_before")).drop("_shard", "_inside", "_before")


def archived(files: DataFrame, part: int = PART) -> DataFrame:
    """(archive, part, begin, bytes): archives of files (archive, place, name, bytes), each in parts of about ``part`` bytes.

    ``place`` orders the files of an archive. Null bytes are an empty file. Archives of more entries or bytes than the
    format counts are refused.
    """
    named = files.select("archive", "place", F.encode("name", "UTF-8").alias("name"), F.coalesce("bytes", F.unhex(F.lit(""))).alias("bytes"))
    sized = named.select("archive", "place", F.length("name").cast("long").alias("n"), F.length("bytes").cast("long").alias("size"))
    sized = sized.withColumn("local", F.col("n") + F.col("size") + LOCAL_SIZE).withColumn("central", F.col("n") + CENTRAL_SIZE)
    placed = running(running(sized, "archive", "place", "local", "at"), "archive", "place", "central", "central_at")
    totals = placed.groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.sum("local").alias("files"), F.sum("central").alias("directory"))
    fits = (F.col("entries") <= MOST_ENTRIES) & (F.col("files") + F.col("directory") + LAST_SIZE <= MOST_BYTES)
    totals = totals.where(F.when(fits, True).otherwise(F.raise_error(F.lit("more than an archive can hold")).cast("boolean")))
    whole = named.join(placed.select("archive", "place", "n", "size", "at", "central_at"), ["archive", "place"]).join(totals.select("archive", "files"), "archive")
    known = [F.lit(STORED), little(F.crc32("bytes"), 4), little(F.col("size"), 4), little(F.col("size"), 4), little(F.col("n"), 2), F.lit("0000")]
    local = F.concat(F.unhex(F.concat(F.lit(LOCAL + NEEDS), *known)), "name", "bytes")
    central = F.concat(F.unhex(F.concat(F.lit(CENTRAL + "1400" + NEEDS), *known, F.lit("0000" + "0000" + "0000" + "00000000"), little(F.col("at"), 4))), "name")
    both = F.array(F.struct(F.col("at").alias("at"), local.alias("bytes")), F.struct((F.col("files") + F.col("central_at")).alias("at"), central.alias("bytes")))
    last = F.unhex(F.concat(F.lit(LAST + "00000000"), little(F.col("entries"), 2), little(F.col("entries"), 2), little(F.col("directory"), 4), little(F.col("files"), 4), F.lit("0000")))
    rows = whole.select("archive", F.inline(both)).unionByName(totals.select("archive", (F.col("files") + F.col("directory")).alias("at"), last.alias("bytes")))
    return rows.groupBy("archive", F.floor(F.col("at") / part).alias("part")).agg(F.min("at").alias("begin"), in_order("bytes", "at").alias("bytes"))


def directory(parts: DataFrame) -> DataFrame:
    """(archive, name, at, size, crc): what the directories of archives (archive, part, begin, bytes) list.

    The end record is looked for in the last parts, which may be several small ones; entries that cross parts are read
    from the parts of the directory laid end to end, one row for each archive, bounded by the entries it may have.
    """
    ends = parts.withColumn("end", F.col("begin") + F.length("bytes"))
    last = ends.groupBy("archive").agg(F.max("end").alias("whole"))
    tail = ends.join(last, "archive").where(F.col("end") > F.col("whole") - MOST_ENTRIES - LAST_SIZE).groupBy("archive").agg(F.first("whole").alias("whole"), in_order("bytes", "begin").alias("bytes"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for data in batch.column("bytes").to_pylist():
                at = data.rfind(bytes.fromhex(LAST))
                size, begin = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (12, 16)) if at >= 0 else (0, 0)
                low.append(begin)
                high.append(begin + size)
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["archive", "low", "high"])

    kind = dict(parts.dtypes)["archive"]
    bounds = tail.select("archive", "bytes").mapInArrow(find, f"archive {kind}, low long, high long")
    held = ends.join(bounds, "archive").where((F.col("begin") < F.col("high")) & (F.col("end") > F.col("low")))
    whole = held.groupBy("archive", "low", "high").agg(F.min("begin").alias("begin"), in_order("bytes", "begin").alias("bytes"))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, (data, begin, low, high) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bytes", "begin", "low", "high")), strict=True)):
                at, stop = low - begin, high - begin
                while at + CENTRAL_SIZE <= stop and data[at : at + 4] == bytes.fromhex(CENTRAL):
                    crc, size, n, more, note, place = (int.from_bytes(data[at + k : at + k + w], "little") for k, w in ((16, 4), (20, 4), (28, 2), (30, 2), (32, 2), (42, 4)))
                    out.append((i, data[at + CENTRAL_SIZE : at + CENTRAL_SIZE + n].decode("utf-8", "replace"), place, size, crc))
                    at += CENTRAL_SIZE + n + more + note
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()), 1)]
            yield pa.RecordBatch.from_arrays([batch.column("archive").take(pa.array([r[0] for r in out], pa.int64())), *columns], names=["archive", "name", "at", "size", "crc"])

    return whole.mapInArrow(entries, f"archive {kind}, name string, at long, size long, crc long")


def extracted(parts: DataFrame, part: int = PART) -> DataFrame:
    """(archive, name, size, whole, bytes): the stored files of archives in parts; ``whole`` tells whether their sums are right.

    An entry meets the parts that its bytes lie in, by their numbers; parts begin where the first row of their number does.
    """
    listed = directory(parts)
    # A part holds what begins in it and may reach far beyond, so an entry's data can only lie in the part that it begins in.
    joined = listed.withColumn("part", F.floor(F.col("at") / part)).join(parts, ["archive", "part"])
    here = (F.col("at") - F.col("begin")).cast("int")
    two = lambda k: F.ascii(F.decode(F.substring("bytes", here + k + 1, F.lit(1)), "ISO-8859-1")) + 256 * F.ascii(F.decode(F.substring("bytes", here + k + 2, F.lit(1)), "ISO-8859-1"))
    data = F.substring("bytes", here + LOCAL_SIZE + two(26) + two(28) + 1, F.col("size").cast("int"))
    return joined.select("archive", "name", "size", "crc", data.alias("bytes")).select("archive", "name", "size", (F.crc32("bytes") == F.col("crc")).alias("whole"), "bytes")
