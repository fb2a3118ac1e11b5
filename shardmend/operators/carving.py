"""Carving across cluster edges: photos and clips by their headers at sectors, small photos anywhere.

A cluster meets only the head of the next one, and becomes a row of places: where it begins and ends to be blank, sectors
that start a known file, starts of photos, end markers. What a file is then follows from joins over those slim rows: the
walk over its header's segments goes from cluster to cluster as a frontier, the block where reading stops and the end
marker after its scan are the next ones at or after a place. Every start gets its span by itself; which of them count,
leftmost first and none inside another, is a chain from the first one along the next start behind each span, followed by
jumps that double. Bytes are joined for the chosen spans alone.

Places count bytes from the first cluster of the card on. Clusters that aren't stored, or are shorter, are zeros.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardmend.operators import cards
from shardmend.sources import markers

SECTOR, MOST = 512, 48 << 20
#: A small photo: its window, its least and most bytes, and the most where it begins with a cluster.
WINDOW, LEAST_SMALL, MOST_SMALL, MOST_SIDE = 256 << 10, 1 << 10, 160 << 10, 64 << 10
# What is said of a carved file.
WHOLE, OPEN, CLIP = "complete: header to end marker", "no end marker found: stopped at the next file header", "AVI carved by RIFF size (assumed contiguous)"
_PHOTO, _END = b"\xff\xd8\xff", b"\xff\xd9"
_KNOWN = tuple(bytes.fromhex(h) for h in cards.HEADERS)


def _every(data: bytes, what: bytes, limit: int) -> list[int]:
    """Places below ``limit`` where ``what`` stands."""
    out, at = [], data.find(what)
    while 0 <= at < limit:
        out.append(at)
        at = data.find(what, at + 1)
    return out


def with_next(stored: DataFrame, size: int) -> DataFrame:
    """``stored`` (card_id, cluster, bytes) with ``halo``: the first ``size`` bytes of the next cluster, null where there is none."""
    head = stored.select("card_id", (F.col("cluster") - 1).alias("cluster"), F.substring("bytes", 1, size).alias("halo"))
    return stored.select("card_id", "cluster", "bytes").join(head, ["card_id", "cluster"], "left")


def places(stored: DataFrame, cluster: int) -> DataFrame:
    """(card_id, cluster, lead, trail, known, photos, ends, clip): what a cluster holds, by places in it.

    Zeros at its begin and end; sectors that start a known file; starts of photos and end markers, which may reach into
    the next cluster; the size that the header of a clip at its begin tells.
    """

    def look(data: bytes | None, halo: bytes | None) -> tuple:
        data = (data or b"").ljust(cluster, b"\0")
        more = data + (halo or b"").ljust(2, b"\0")[:2]
        filled = np.flatnonzero(np.frombuffer(data, np.uint8))
        lead, trail = (int(filled[0]), cluster - 1 - int(filled[-1])) if len(filled) else (cluster, cluster)
        clip = int.from_bytes(data[4:8], "little") + 8 if data[:4] == b"RIFF" and data[8:12] == b"AVI " else None
        return lead, trail, [s for s in range(0, cluster, SECTOR) if data[s : s + 4].startswith(_KNOWN)], _every(more, _PHOTO, cluster), _every(more[:-1], _END, cluster), clip

    kind = dict(stored.dtypes)["card_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [look(d, h) for d, h in zip(batch.column("bytes").to_pylist(), batch.column("halo").to_pylist(), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [()] * 6
            types = [pa.int32(), pa.int32(), *[pa.list_(pa.int32())] * 3, pa.int64()]
            own = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("card_id"), batch.column("cluster"), *own], names=["card_id", "cluster", "lead", "trail", "known", "photos", "ends", "clip"])

    joined = with_next(stored, 2).select("card_id", F.col("cluster").cast("long").alias("cluster"), "bytes", "halo")
    return joined.mapInArrow(run, f"card_id {kind}, cluster long, lead int, trail int, known array<int>, photos array<int>, ends array<int>, clip long")


def next_from(rows: DataFrame, marks: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the first place of ``marks`` (keys.., at) at or after their own; null where none follows."""
    slim = rows.select(*keys, at).distinct().withColumn("_mark", F.lit(None).cast("long")).unionByName(marks.select(*keys, at, F.col(at).cast("long").alias("_mark")))
    after = W.partitionBy(*keys).orderBy(F.col(at).desc(), F.col("_mark").desc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    seen = slim.withColumn(name, F.last("_mark", ignorenulls=True).over(after)).where("_mark IS NULL").drop("_mark")
    return rows.join(seen, [*keys, at])


def scan_places(starts: DataFrame, stored: DataFrame, cluster: int) -> DataFrame:
    """(card_id, start, scan): where the first scan of each start begins, by its segments; null where they lead to none.

    ``starts``: (card_id, start, stop); what is read ends at ``stop``. Each round walks on in the cluster that holds its
    place, so there are as many rounds as a header has clusters at most. A scan header that runs past the block of its
    marker ends with that block, as blocks are read one by one.
    """
    kind = dict(starts.dtypes)["card_id"]

    def step(data: bytes, base: int, start: int, at: int, stop: int) -> tuple[int, bool, int | None]:
        """(place, goes on, scan) after the segments that begin in one cluster."""
        while at - base < cluster:
            i = at - base
            if at + 4 > stop or data[i] != 0xFF:
                return at, False, None
            if data[i + 1] == 0xFF:
                at += 1
                continue
            end = at + 2 + int.from_bytes(data[i + 2 : i + 4])
            if data[i + 1] == markers.SOS:
                block = start + -(-(at + 4 - start) // cluster) * cluster
                return at, False, min(end, block, stop)
            at = end
        return at, True, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["start", "at", "stop", "cluster", "bytes", "halo"]
        for batch in batches:
            out = []
            for start, at, stop, c, data, halo in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                whole = (data or b"").ljust(cluster, b"\0") + (halo or b"").ljust(3, b"\0")
                out.append((start, stop, *step(whole, (c - cards.FIRST_CLUSTER) * cluster, start, at, stop)))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("card_id"), *(pa.array(x, t) for x, t in zip(columns, types, strict=True))], names=["card_id", "start", "stop", "at", "on", "scan"])

    data = with_next(stored, 3)
    open_, done = starts.select("card_id", "start", "stop", (F.col("start") + 2).alias("at")), None
    while True:
        here = open_.withColumn("cluster", F.floor(F.col("at") / cluster) + cards.FIRST_CLUSTER).join(data, ["card_id", "cluster"], "left")
        walked = here.select("card_id", "start", "stop", "at", "cluster", "bytes", "halo").mapInArrow(run, f"card_id {kind}, start long, stop long, at long, on boolean, scan long").checkpoint()
        ended = walked.where("NOT on").select("card_id", "start", "scan")
        done = ended if done is None else done.unionByName(ended)
        open_ = walked.where("on").select("card_id", "start", "stop", "at")
        if open_.isEmpty():
            return done


def leftmost(spans: DataFrame) -> DataFrame:
    """The spans (card_id, at, behind, ..) that count: the first of each card, then each time the first that begins at ``behind`` or later."""
    slim = spans.select("card_id", "at", "behind").checkpoint()
    following = next_from(slim.select("card_id", F.col("at").alias("own"), F.col("behind").alias("at")), slim, ["card_id"], "at", "next")
    table = following.select("card_id", F.col("own").alias("cluster"), "next")
    heads = slim.groupBy("card_id").agg(F.min("at").alias("head"))
    chosen = cards.follow_chains(table, heads).select("card_id", F.col("cluster").alias("at"))
    return spans.join(chosen, ["card_id", "at"])


def span_bytes(spans: DataFrame, stored: DataFrame, cluster: int, names: list[str]) -> DataFrame:
    """(names.., bytes) of spans (names.., card_id, begin, end) of places; each is one row, so spans must be bounded."""
    some = spans.where("end > begin")
    first, last = F.floor(F.col("begin") / cluster), F.floor((F.col("end") - 1) / cluster)
    parts = some.select(*names, *([] if "card_id" in names else ["card_id"]), F.posexplode(F.sequence(first, last)).alias("pos", "c"))
    parts = parts.withColumn("cluster", F.col("c") + cards.FIRST_CLUSTER).drop("c")
    sizes = some.select(*names, (F.col("end") - F.floor(F.col("begin") / cluster) * cluster).alias("size"), (F.col("begin") % cluster).cast("int").alias("skip"))
    whole = cards.read_chains(parts, stored, sizes.select(*names, "size"), names, cluster)
    return whole.join(sizes.select(*names, "skip"), names).select(*names, F.expr("substring(bytes, skip + 1)").alias("bytes"))


def carve_files(stored: DataFrame, cards_end: DataFrame, cluster: int, most: int = MOST, data_start: int = 0, past_starts: bool = False) -> DataFrame:
    """(card_id, name, start, size, first, clusters, note, bytes): photos and clips carved out of ``stored`` clusters.

    A file starts where a cluster does, or at the first sector in it that starts a photo. A photo is read block by block
    of a cluster's size up to the end marker behind its scan header, or to a block that is blank or starts a known file,
    or ``most`` bytes; a clip takes the size that its header tells. ``cards_end``: (card_id, last). Names tell the sector
    on a card whose clusters begin at byte ``data_start``. With ``past_starts``, for cards whose files have blanks between
    them, only a blank stops a photo, and what begins before it is part of it.
    """
    facts = places(stored, cluster).checkpoint()
    base = (F.col("cluster") - cards.FIRST_CLUSTER) * cluster
    at_sector = F.filter("photos", lambda p: p % SECTOR == 0)
    on_grid = F.array_contains("photos", 0)
    sector = F.when(on_grid, F.lit(0)).when(F.col("clip").isNull(), F.get(at_sector, F.lit(0)))
    starts = facts.join(cards_end, "card_id").where(F.col("lead") < cluster).select("card_id", "cluster", "last", sector.alias("sector"), F.when(~on_grid, F.col("clip")).alias("clip"))
    starts = starts.where("sector IS NOT NULL OR clip IS NOT NULL").withColumn("start", base + F.coalesce("sector", F.lit(0))).withColumn("card_end", (F.col("last") - cards.FIRST_CLUSTER + 1) * cluster).checkpoint()
    photos = starts.where("clip IS NULL")

    # Where reading stops, for each sector that photos of a card start at: a cluster that isn't stored counts right after one that is.
    gaps = facts.select("card_id", (F.col("cluster") + 1).alias("cluster")).join(facts.select("card_id", "cluster"), ["card_id", "cluster"], "left_anti")
    rows = facts.select("card_id", "cluster", "lead", "trail", "known").unionByName(gaps, allowMissingColumns=True)
    behind = rows.select("card_id", (F.col("cluster") - 1).alias("cluster"), F.col("lead").alias("next_lead"))
    rows = rows.join(behind, ["card_id", "cluster"], "left").join(photos.select("card_id", "sector").distinct(), "card_id")
    blank = (F.coalesce("trail", F.lit(cluster)) + F.col("sector") >= cluster) & (F.coalesce("next_lead", F.lit(cluster)) >= F.col("sector"))
    starts_file = F.coalesce(F.array_contains("known", F.col("sector")), F.lit(False))
    stops = rows.where(blank if past_starts else blank | starts_file).select("card_id", "sector", F.col("cluster").alias("from"))
    bounded = next_from(photos.withColumn("from", F.col("cluster") + 1), stops, ["card_id", "sector"], "from", "stop_cluster")
    blocks = F.least(F.coalesce(F.col("stop_cluster") - F.col("cluster"), F.lit(cards.MAX_CLUSTERS)), F.lit(-(-most // cluster)))
    bounded = bounded.withColumn("stop", F.least(F.col("start") + blocks * cluster, "card_end")).drop("from", "stop_cluster").checkpoint()

    scans = scan_places(bounded.select("card_id", "start", "stop"), stored, cluster)
    ends = facts.select("card_id", base.alias("base"), F.explode("ends").alias("at")).select("card_id", (F.col("base") + F.col("at")).alias("scan"))
    ended = next_from(bounded.join(scans.where("scan IS NOT NULL"), ["card_id", "start"]), ends, ["card_id"], "scan", "mark")
    found = bounded.join(ended.select("card_id", "start", F.when(F.col("mark") + 2 <= F.col("stop"), F.col("mark") + 2).alias("end")), ["card_id", "start"], "left")
    tail = F.coalesce("end", "stop")
    held = F.floor((tail - 1) / cluster) + cards.FIRST_CLUSTER - F.col("cluster") + 1
    # The last cluster of a file off the grid may also hold the start of the next one.
    on_to_blank = F.col("end").isNull() if past_starts else F.lit(False)
    used = F.when((F.col("sector") == 0) | on_to_blank, held).otherwise(F.greatest(held - 1, F.lit(1)))
    note = F.when(F.col("end").isNotNull(), WHOLE).otherwise(OPEN)
    as_photo = found.select("card_id", "cluster", "start", tail.alias("end"), held.alias("clusters"), used.alias("used"), note.alias("note"), F.lit("jpg").alias("kind"))
    size = F.least("clip", F.lit(most))
    n = F.greatest(F.ceil(size / cluster), F.lit(1))
    as_clip = starts.where("clip IS NOT NULL").select("card_id", "cluster", "start", F.least(F.col("start") + size, "card_end").alias("end"), F.least(n, F.col("last") - F.col("cluster") + 1).alias("clusters"), n.alias("used"), F.lit(CLIP).alias("note"), F.lit("avi").alias("kind"))
    spans = as_photo.unionByName(as_clip).withColumn("at", F.col("cluster").cast("long")).withColumn("behind", (F.col("cluster") + F.col("used")).cast("long"))
    chosen = leftmost(spans.checkpoint())
    data = span_bytes(chosen.select("card_id", "start", F.col("start").alias("begin"), "end"), stored, cluster, ["card_id", "start"])
    name = F.concat(F.lit("f"), F.lpad(F.floor((F.col("start") + data_start) / SECTOR).cast("string"), 7, "0"), F.lit("."), "kind")
    return chosen.join(data, ["card_id", "start"]).select("card_id", name.alias("name"), "start", (F.col("end") - F.col("start")).alias("size"), F.col("cluster").alias("first"), F.col("clusters").cast("long").alias("clusters"), "note", "bytes")


# What is said of a small photo.
SMALL_NOTES = {
    "movie": "MJPEG movie frame (no Huffman tables; standard ones inserted)",
    "cache": "thumbnail from a Windows Thumbs.db cache",
    "side": "small JPEG file (.THM sidecar)",
    "exif": "embedded EXIF thumbnail",
}


def blocks_of(stored: DataFrame, cluster: int, size: int, before: int, behind: int) -> DataFrame:
    """(card_id, block, at, bytes): clusters dealt to blocks of ``size`` bytes, a multiple of theirs, each with up to ``before`` bytes ahead of it and ``behind`` after it.

    ``at`` is the place in the block, below 0 ahead of it. Bytes of a block are there once, those near its edges once more
    for each neighbour that reads them.
    """
    base = (F.col("cluster") - cards.FIRST_CLUSTER) * cluster
    low, high = F.floor((base - behind) / size), F.floor((base + cluster + before - 1) / size)
    dealt = stored.withColumn("block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high))).withColumn("at", (base - F.col("block") * size).cast("int"))
    # Of a neighbour's clusters no more than what is read of them.
    skip = F.when(F.col("at") < -before, -F.col("at") - before).otherwise(0)
    take = F.least(F.lit(cluster), F.lit(size + behind) - F.col("at")) - skip
    return dealt.where(take > 0).select("card_id", "block", (F.col("at") + skip).alias("at"), F.expr("bytes").substr(skip + 1, take).alias("bytes"))


def small_spans(stored: DataFrame, cluster: int) -> DataFrame:
    """(card_id, start, n, kind) of every small photo in ``stored`` clusters, those inside others too.

    Starts of a block read one buffer of it and of a window behind it, so bytes move about once however many starts they hold.
    """
    size, kind = -(-4 * WINDOW // cluster) * cluster, dict(stored.dtypes)["card_id"]

    def end_of(buffer: bytes, at: int) -> int | None:
        """As ``strict_end`` of the window at a start; most photos end in its first bytes, and nothing in those tells more."""
        n = 1 << 13
        while n < WINDOW:
            end = markers.strict_end(buffer[at : at + n])
            if end is not None and end <= n - 4:
                return end
            n *= 4
        return markers.strict_end(buffer[at : at + WINDOW])

    def look(buffer: bytes, at: int, start: int) -> tuple | None:
        end, grid = end_of(buffer, at), start % cluster == 0
        if end is None or not LEAST_SMALL <= end < MOST_SMALL or grid and end >= MOST_SIDE:
            return None
        before = buffer[at - min(start, 12) : at]
        cached = len(before) == 12 and before[:4] == b"\x0c\0\0\0" and int.from_bytes(before[8:], "little") == end
        return start, end, "movie" if not markers.has_tables(buffer[at : at + end]) else "cache" if cached else "side" if grid else "exif"

    def run(rows: pa.Table) -> pa.Table:
        buffer = bytearray(12 + size + WINDOW)
        for at, data in zip(rows.column("at").to_pylist(), rows.column("bytes").to_pylist(), strict=True):
            buffer[12 + at : 12 + at + len(data or b"")] = data or b""
        whole, base = bytes(buffer), rows.column("block")[0].as_py() * size
        starts = _every(whole[12 : 12 + size + 2], _PHOTO, size)
        found = [x for s in starts if (x := look(whole, 12 + s, base + s))]
        whose = rows.column("card_id").combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        return pa.table({"card_id": whose} | {n: pa.array([f[k] for f in found], t) for k, (n, t) in enumerate((("start", pa.int64()), ("n", pa.int64()), ("kind", pa.string())))})

    dealt = blocks_of(stored.select("card_id", F.col("cluster").cast("long").alias("cluster"), F.substring("bytes", 1, cluster).alias("bytes")), cluster, size, 12, WINDOW)
    return dealt.groupBy("card_id", "block").applyInArrow(run, f"card_id {kind}, start long, n long, kind string")


def small_photos(stored: DataFrame, cluster: int, data_start: int = 0) -> DataFrame:
    """(card_id, name, start, size, note, bytes): small photos anywhere in ``stored`` clusters, across their edges too.

    A photo is small if it ends within the limits; one that begins with a cluster is a file beside another, and must be
    smaller. Of spans that overlap the leftmost counts, and bytes are joined for those alone. A photo without Huffman
    tables gets the standard ones.
    """
    spans = small_spans(stored, cluster).withColumn("at", F.col("start")).withColumn("behind", F.col("start") + F.col("n")).checkpoint()
    chosen = leftmost(spans)
    data = span_bytes(chosen.select("card_id", "start", F.col("start").alias("begin"), F.col("behind").alias("end")), stored, cluster, ["card_id", "start"])
    card = dict(stored.dtypes)["card_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            photos = [markers.with_standard_tables(b) if k == "movie" else b for b, k in zip(batch.column("bytes").to_pylist(), batch.column("kind").to_pylist(), strict=True)]
            yield batch.set_column(batch.schema.get_field_index("bytes"), "bytes", pa.array(photos, pa.binary()))

    found = chosen.select("card_id", "start", "kind").join(data, ["card_id", "start"]).select("card_id", "start", "kind", "bytes").mapInArrow(run, f"card_id {card}, start long, kind string, bytes binary")
    place = F.col("start") + data_start
    name = F.concat(F.lit("t"), F.lpad(F.floor(place / SECTOR).cast("string"), 7, "0"), F.lit("_"), F.lpad((place % SECTOR).cast("string"), 4, "0"), F.lit(".jpg"))
    note = F.create_map(*[F.lit(x) for pair in SMALL_NOTES.items() for x in pair])[F.col("kind")]
    return found.select("card_id", name.alias("name"), "start", F.length("bytes").cast("long").alias("size"), note.alias("note"), "bytes")
