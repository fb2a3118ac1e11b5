"""Memory cards as tables: allocation, chains, damage and recovery as joins and windows.

A card holds a bounded number of clusters (at most MAX_CLUSTERS), so a window over one card is bounded; everything
scales over cards. Files are rows (card_id, file_no, size, gen): generation 0 is written first, in order of file_no;
then files are deleted, and generation 1 is written into what is free from the start of the card on.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardmend.sources import markers

FIRST_CLUSTER = 2
MAX_CLUSTERS = 4_194_304


def file_clusters(files: DataFrame, cluster: int) -> DataFrame:
    """(card_id, file_no, pos): a row for each cluster that a file needs; empty files need none."""
    n = F.ceil(F.col("size") / cluster).cast("int")
    return files.where(n > 0).select("card_id", "file_no", F.explode(F.sequence(F.lit(0), n - 1)).alias("pos"))


def cut_up(data: Column, cluster: int) -> Column:
    """A payload that isn't empty as an array of its clusters; the last may be shorter."""
    n = F.floor((F.length(data) - 1) / cluster).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(data, k * cluster + 1, F.lit(cluster)))


def allocate_fresh(files: DataFrame, cluster: int) -> DataFrame:
    """(card_id, file_no, pos, cluster): files one after another on an empty card."""
    n = F.ceil(F.col("size") / cluster)
    first = F.sum(n).over(W.partitionBy("card_id").orderBy("file_no").rowsBetween(W.unboundedPreceding, 0)) - n + FIRST_CLUSTER
    starts = files.withColumn("first", first.cast("long")).select("card_id", "file_no", "size", "first")
    return starts.where("size > 0").select("card_id", "file_no", F.posexplode(F.sequence("first", F.col("first") + F.ceil(F.col("size") / cluster) - 1)).alias("pos", "cluster"))


def deleted_every_other(files: DataFrame) -> DataFrame:
    """Every second file of a card, from the first on."""
    return files.withColumn("_n", F.row_number().over(W.partitionBy("card_id").orderBy("file_no"))).where("_n % 2 = 1").drop("_n")


def allocate_into_free(used: DataFrame, freed: DataFrame, newcomers: DataFrame, cluster: int) -> DataFrame:
    """(card_id, file_no, pos, cluster): new files in the first free clusters, in order.

    The k-th needed cluster takes the k-th free one: first those of deleted files, then those past the last used one.
    """
    need = file_clusters(newcomers, cluster).withColumn("k", F.row_number().over(W.partitionBy("card_id").orderBy("file_no", "pos")))
    free = freed.select("card_id", "cluster").withColumn("k", F.row_number().over(W.partitionBy("card_id").orderBy("cluster")))
    end = used.groupBy("card_id").agg(F.max("cluster").alias("last"))
    holes = freed.groupBy("card_id").agg(F.count(F.lit(1)).alias("holes"))
    placed = need.join(free, ["card_id", "k"], "left").join(end, "card_id", "left").join(holes, "card_id", "left")
    beyond = F.coalesce("last", F.lit(FIRST_CLUSTER - 1)) + F.col("k") - F.coalesce("holes", F.lit(0))
    return placed.select("card_id", "file_no", "pos", F.coalesce("cluster", beyond).alias("cluster"))


def fragments(chain: DataFrame) -> DataFrame:
    """(card_id, file_no, clusters, fragments): how often a chain jumps, and one more."""
    gap = F.col("cluster") - F.lag("cluster").over(W.partitionBy("card_id", "file_no").orderBy("pos"))
    return chain.withColumn("jump", (F.coalesce(gap, F.lit(1)) != 1).cast("int")).groupBy("card_id", "file_no").agg(F.count(F.lit(1)).alias("clusters"), (F.sum("jump") + 1).alias("fragments"))


def fat(chain: DataFrame) -> DataFrame:
    """(card_id, cluster, next): the file allocation table; null ends a chain."""
    return chain.select("card_id", "cluster", F.lead("cluster").over(W.partitionBy("card_id", "file_no").orderBy("pos")).alias("next"))


class Jumps:
    """Where 1, 2, 4, .. steps along a table (card_id, cluster, next) lead, each made when it is asked for and kept."""

    def __init__(self, table: DataFrame):
        self.made = [table.where("next IS NOT NULL").select("card_id", "cluster", "next").checkpoint()]

    def __getitem__(self, k: int) -> DataFrame:
        while len(self.made) <= k:
            last = self.made[-1]
            beyond = last.select("card_id", F.col("cluster").alias("next"), F.col("next").alias("beyond"))
            self.made.append(last.join(beyond, ["card_id", "next"]).select("card_id", "cluster", F.col("beyond").alias("next")).checkpoint())
        return self.made[k]


def follow_chains(table: DataFrame, heads: DataFrame, jumps: Jumps | None = None) -> DataFrame:
    """(card_id, head, pos, cluster): clusters reachable from each head, by jumps that double; loops end by the size of a card.

    ``heads``: (card_id, head). Each round knows where 2^r steps lead, and the positions reached so far double. Calls that
    follow one table may share its ``jumps``.
    """
    jumps = jumps or Jumps(table)
    reached = heads.select("card_id", "head", F.lit(0).cast("long").alias("pos"), F.col("head").alias("cluster")).checkpoint()
    k = 0
    while 1 << k <= MAX_CLUSTERS:
        more = reached.join(jumps[k], ["card_id", "cluster"]).select("card_id", "head", (F.col("pos") + (1 << k)).alias("pos"), F.col("next").alias("cluster"))
        more = more.join(reached.select("card_id", "head", "cluster"), ["card_id", "head", "cluster"], "left_anti").checkpoint()
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        k += 1
    return reached


def in_order(column: str, place: str) -> Column:
    """Binaries of a group end to end, by their places."""
    return F.expr(f"listagg({column}) WITHIN GROUP (ORDER BY {place})")


def unclaimed(clusters: DataFrame, claimed: DataFrame) -> DataFrame:
    """Clusters that no recovered file holds."""
    return clusters.join(claimed.select("card_id", "cluster"), ["card_id", "cluster"], "left_anti")


def islands(clusters: DataFrame) -> DataFrame:
    """(card_id, first, last, clusters): runs of neighbouring clusters."""
    run = F.col("cluster") - F.row_number().over(W.partitionBy("card_id").orderBy("cluster"))
    return clusters.withColumn("run", run).groupBy("card_id", "run").agg(F.min("cluster").alias("first"), F.max("cluster").alias("last"), F.count(F.lit(1)).alias("clusters")).drop("run")


def overwritten(old: DataFrame, new: DataFrame) -> DataFrame:
    """(card_id, file_no, victim, clusters): how many clusters of which deleted file each new file took."""
    victims = old.select("card_id", "cluster", F.col("file_no").alias("victim"))
    return new.join(victims, ["card_id", "cluster"]).groupBy("card_id", "file_no", "victim").agg(F.count(F.lit(1)).alias("clusters"))


def undelete_skipping(deleted: DataFrame, now: DataFrame, last: DataFrame, cluster: int) -> DataFrame:
    """(card_id, file_no, pos, cluster): deleted files from their first cluster on, past clusters that others use by now.

    ``deleted``: (card_id, file_no, size, first). ``last``: (card_id, last), the end of each card. The free clusters of a
    card are numbered, a file begins at the number of the first free one from its start on, and its n-th cluster is found
    by an equi-join on numbers.
    """
    every = last.select("card_id", F.explode(F.sequence(F.lit(FIRST_CLUSTER).cast("long"), F.col("last").cast("long"))).alias("cluster"))
    free = every.join(now.select("card_id", "cluster"), ["card_id", "cluster"], "left_anti")
    marks = deleted.where("size > 0").select("card_id", "file_no", "size", F.col("first").alias("cluster"), F.lit(0).alias("kind"))
    both = free.select("card_id", "cluster", F.lit(1).alias("kind")).unionByName(marks, allowMissingColumns=True)
    order = W.partitionBy("card_id").orderBy("cluster", "kind").rowsBetween(W.unboundedPreceding, 0)
    counted = both.withColumn("k", F.sum("kind").over(order))
    need = counted.where("kind = 0").select("card_id", "file_no", F.col("k").alias("before"), F.explode(F.sequence(F.lit(0), (F.ceil(F.col("size") / cluster) - 1).cast("int"))).alias("pos"))
    need = need.select("card_id", "file_no", "pos", (F.col("before") + F.col("pos") + 1).alias("k"))
    return need.join(counted.where("kind = 1").select("card_id", "k", "cluster"), ["card_id", "k"]).select("card_id", "file_no", "pos", "cluster")


def read_chains(chains: DataFrame, stored: DataFrame, sizes: DataFrame, names: list[str], cluster: int) -> DataFrame:
    """(names.., bytes): the bytes along chains (names.., card_id, pos, cluster), cut to the size in ``sizes`` (names.., size).

    ``stored``: (card_id, cluster, bytes); clusters that are shorter or missing read as zeros to their end. A file is one
    row and so bounded by its size.
    """
    blank = F.unhex(F.repeat(F.lit("00"), F.lit(cluster) - F.coalesce(F.length("bytes"), F.lit(0))))
    full = F.when(F.length("bytes") >= cluster, F.col("bytes")).otherwise(F.concat(F.coalesce("bytes", F.unhex(F.lit(""))), blank))
    parts = chains.join(stored.select("card_id", "cluster", "bytes"), ["card_id", "cluster"], "left").withColumn("bytes", full)
    whole = parts.groupBy(*names).agg(in_order("bytes", "pos").alias("bytes"))
    return whole.join(sizes, names).select(*names, F.substring("bytes", F.lit(1), F.col("size").cast("int")).alias("bytes"))


def best_overlap(wanted: DataFrame, found: DataFrame, share: int = 4) -> DataFrame:
    """(card_id, file_no, other, hits): for each file the recovered one that holds most of its clusters.

    One of ``share`` of the wanted clusters must be hit at least; of equal hits the lowest number counts. ``wanted`` and
    ``found``: (card_id, file_no, cluster). Hits are counted by an equi-join on clusters, so nothing meets that shares none.
    """
    size = wanted.groupBy("card_id", "file_no").agg(F.count(F.lit(1)).alias("size"))
    other = found.select("card_id", "cluster", F.col("file_no").alias("other"))
    hits = wanted.join(other, ["card_id", "cluster"]).groupBy("card_id", "file_no", "other").agg(F.count(F.lit(1)).alias("hits"))
    enough = hits.join(size, ["card_id", "file_no"]).where(F.col("hits") * share >= F.col("size"))
    best = enough.groupBy("card_id", "file_no").agg(F.max(F.struct("hits", (-F.col("other")).alias("less"))).alias("b"))
    return best.select("card_id", "file_no", (-F.col("b.less")).alias("other"), "b.hits")


def undelete_contiguous(deleted: DataFrame, now: DataFrame, cluster: int) -> DataFrame:
    """(card_id, file_no, clusters, intact): deleted files read as one run from their first cluster, and how much is still theirs.

    ``deleted``: (card_id, file_no, size, first). ``now``: chains that hold clusters by now.
    """
    run = deleted.where("size > 0").select("card_id", "file_no", F.explode(F.sequence("first", F.col("first") + F.ceil(F.col("size") / cluster) - 1)).alias("cluster"))
    taken = now.select("card_id", "cluster", F.lit(1).alias("taken"))
    return run.join(taken, ["card_id", "cluster"], "left").groupBy("card_id", "file_no").agg(F.count(F.lit(1)).alias("clusters"), F.sum(F.when(F.col("taken").isNull(), 1).otherwise(0)).alias("intact"))


def dense_image(clusters: DataFrame, cards: DataFrame) -> DataFrame:
    """(card_id, cluster, state): every cluster of a card in order, blank where none is stored.

    ``cards``: (card_id, last), the last cluster of each.
    """
    every = cards.select("card_id", F.explode(F.sequence(F.lit(FIRST_CLUSTER).cast("long"), F.col("last").cast("long"))).alias("cluster"))
    return every.join(clusters.select("card_id", "cluster", F.lit("used").alias("state")), ["card_id", "cluster"], "left").withColumn("state", F.coalesce("state", F.lit("blank")))


def image_parts(stored: DataFrame, cards: DataFrame, cluster: int, per_part: int) -> DataFrame:
    """(card_id, part, bytes): the raw image of each card's clusters in parts of ``per_part`` clusters; laid end to end they are the image.

    ``stored``: (card_id, cluster, bytes). ``cards``: (card_id, last). Clusters that aren't stored, or are shorter, are zeros.
    """
    every = cards.select("card_id", F.explode(F.sequence(F.lit(FIRST_CLUSTER).cast("long"), F.col("last").cast("long"))).alias("cluster"))
    held = every.join(stored.select("card_id", "cluster", "bytes"), ["card_id", "cluster"], "left")
    data = F.coalesce("bytes", F.unhex(F.lit("")))
    full = F.concat(data, F.unhex(F.repeat(F.lit("00"), F.greatest(F.lit(cluster) - F.length(data), F.lit(0)))))
    placed = held.select("card_id", "cluster", F.floor((F.col("cluster") - FIRST_CLUSTER) / per_part).alias("part"), full.alias("bytes"))
    return placed.groupBy("card_id", "part").agg(in_order("bytes", "cluster").alias("bytes"))


def carved(clusters: DataFrame) -> DataFrame:
    """(card_id, first, clusters, complete, bytes): files carved from stored clusters (card_id, cluster, bytes).

    A file begins at a cluster that starts with the header of a photo or a clip and runs over the clusters that follow
    it, up to the next header or a blank. A photo is cut at the end marker of its scan, a clip at the size that its
    header tells. A running count of such starts numbers the files.
    """
    order = W.partitionBy("card_id").orderBy("cluster")
    magic = F.hex(F.substring("bytes", 1, 12))
    clip = magic.startswith("52494646") & (F.substring(magic, 17, 8) == "41564920")
    header = magic.startswith("FFD8FF") | clip
    fresh = header | (F.col("cluster") - F.coalesce(F.lag("cluster").over(order), F.col("cluster")) > 1)
    numbered = clusters.withColumn("_head", header).withColumn("_clip", clip).withColumn("_no", F.sum(fresh.cast("int")).over(order))
    files = numbered.groupBy("card_id", "_no").agg(
        F.min("cluster").alias("first"), F.count(F.lit(1)).alias("clusters"), F.min_by("_head", "cluster").alias("_head"), F.min_by("_clip", "cluster").alias("_clip"),
        in_order("bytes", "cluster").alias("bytes"),
    )
    cut = F.pandas_udf(lambda s: s.map(lambda b: markers.photo_end(bytes(b))), "int")
    told = F.conv(F.hex(F.encode(F.reverse(F.decode(F.substring("bytes", 5, 4), "ISO-8859-1")), "ISO-8859-1")), 16, 10).cast("long") + 8
    found = files.where("_head").select("card_id", "first", "clusters", "_clip", "bytes")
    ends = found.where("NOT _clip").withColumn("_end", cut("bytes").cast("long")).unionByName(found.where("_clip").withColumn("_end", F.when(told <= F.length("bytes"), told)))
    return ends.select("card_id", "first", "clusters", F.col("_end").isNotNull().alias("complete"), F.when(F.col("_end").isNull(), F.col("bytes")).otherwise(F.expr("substring(bytes, 1, int(_end))")).alias("bytes"))


def body_pieces(data: bytes, least: int) -> Iterator[tuple[int, bytes]]:
    """(place, piece): a run of headerless bodies cut after every end marker, past a leftover scan header; short pieces are left out."""
    at = data.find(b"\xff\xda", 0, 512)
    low = at + 2 + int.from_bytes(data[at + 2 : at + 4]) if at >= 0 else 0
    while low < len(data):
        end = data.find(b"\xff\xd9", low)
        high = end + 2 if end >= 0 else len(data)
        if high - low >= least:
            yield low, data[low:high]
        low = high


def rebuilt(runs: DataFrame, headers: DataFrame, min_bytes: int = 256 * 1024, piece_bytes: int = 128 * 1024) -> DataFrame:
    """(card_id, first, place, bytes): runs of unclaimed bodies (card_id, first, bytes), cut at end markers, each piece under its card's longest header.

    Runs under ``min_bytes`` and pieces under ``piece_bytes`` are left out; markers that would end a piece early become harmless.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("bytes").to_pylist()):
                found = list(body_pieces(data, piece_bytes))
                take = batch.take(pa.array([i] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([take.column("card_id"), take.column("first"), pa.array([p for p, _ in found], pa.int64()), pa.array([markers.neutralised(b) for _, b in found], pa.binary())], names=["card_id", "first", "place", "bytes"])

    kinds = dict(runs.dtypes)
    pieces = runs.where(F.length("bytes") >= min_bytes).select("card_id", "first", "bytes").mapInArrow(run, f"card_id {kinds['card_id']}, first {kinds['first']}, place long, bytes binary")
    best = headers.groupBy("card_id").agg(F.max(F.struct(F.length("header").alias("n"), "header"))["header"].alias("header"))
    return pieces.join(best, "card_id").select("card_id", "first", "place", F.concat("header", "bytes").alias("bytes"))


def embedded_photos(payloads: DataFrame, key: str, least: int = 1024, most: int = 160 * 1024) -> DataFrame:
    """(key, offset, bytes): photos of ``least`` to ``most`` bytes anywhere inside payloads, as small ones lie in others' headers."""

    def found(data: bytes) -> Iterator[tuple[int, bytes]]:
        at = data.find(b"\xff\xd8\xff")
        while at >= 0:
            end = markers.photo_end(data[at : at + most])
            if end is not None and least <= end < most:
                yield at, data[at : at + end]
            at = data.find(b"\xff\xd8\xff", at + (end or 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *f) for i, b in enumerate(batch.column(1).to_pylist()) for f in found(b or b"")]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=[key, "offset", "bytes"])

    return payloads.select(key, "bytes").mapInArrow(run, f"{key} {dict(payloads.dtypes)[key]}, offset long, bytes binary")


def grafted(pieces: DataFrame, donors: DataFrame) -> DataFrame:
    """(card_id, first, bytes): bodies without a header under the longest header of their card.

    ``pieces``: (card_id, first, bytes). ``donors``: (card_id, header). Of equal lengths the last in byte order counts.
    """
    best = donors.groupBy("card_id").agg(F.max(F.struct(F.length("header").alias("n"), "header"))["header"].alias("header"))
    return pieces.join(best, "card_id").select("card_id", "first", F.concat("header", "bytes").alias("bytes"))


# How files begin, in hex: photos, clips, caches of thumbnails, side files.
HEADERS = ("FFD8FF", "52494646", "D0CF11E0", "00051607")


def cluster_kinds(data: DataFrame, column: str = "bytes") -> DataFrame:
    """``data`` with ``kind``: empty, header, body or other, by its first bytes, the markers in it and its share of zeros."""
    hexed, size = F.hex(column), F.length(column)
    pairs = F.regexp_extract_all(hexed, F.lit("(..)"), F.lit(1))
    zeros, full = F.size(F.filter(pairs, lambda p: p == "00")), F.size(F.filter(pairs, lambda p: p == "FF"))
    stray = F.size(F.regexp_extract_all(F.array_join(pairs, " "), F.lit("(FF (?!00|D[0-79]|FF)..)"), F.lit(1)))
    known = F.lit(False)
    for h in HEADERS:
        known = known | (hexed.startswith(h) & (size >= 4))
    ff_first = F.size(F.filter(F.slice(pairs, 1, F.greatest(size - 1, F.lit(1))), lambda p: p == "FF"))
    kind = F.when((zeros == size) | (full == size), "empty").when(known, "header").when((stray <= 2) & (ff_first > 0) & (zeros < F.floor(size / 4)), "body").otherwise("other")
    return data.withColumn("kind", kind)
