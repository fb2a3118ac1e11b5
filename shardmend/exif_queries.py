"""Queries over Exif trees, quantisation tables, lost headers and donors by their tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardmend.catalogue import digest, query
from shardmend.operators import lookups, marker_steps
from shardmend.operators.seeded_steps import seeded
from shardmend.photo_queries import BODY, COMPONENTS, FRAME, HEAD, SQL_PHOTO, WHOLE, photos
from shardmend.sources import exif

# Values of a block's entries: text in SQL over doc_id, padded to a fixed length by a NUL.
TEXTS = {
    "make": "'CAM-' || lpad((doc_id % 1000)::VARCHAR, 3, '0')", "artist": "'Some author'", "date": "'2004:06:12 10:' || lpad((doc_id % 60)::VARCHAR, 2, '0') || ':00'",
    "serial": "'SN' || lpad((doc_id % 100000)::VARCHAR, 5, '0')",
}
SPARK_TEXTS = {
    "make": lambda i: F.concat(F.lit("CAM-"), F.lpad((i % 1000).cast("string"), 3, "0")), "artist": lambda i: F.lit("Some author"), "date": lambda i: F.concat(F.lit("2004:06:12 10:"), F.lpad((i % 60).cast("string"), 2, "0"), F.lit(":00")),
    "serial": lambda i: F.concat(F.lit("SN"), F.lpad((i % 100000).cast("string"), 5, "0")),
}
LENGTHS = {"make": 8, "artist": 12, "date": 20, "serial": 8}
THUMB = "FFD8FFD9"


def block(main: list, below: list, gps: list, second: list) -> list[str]:
    """Hex of an Exif segment in pieces, some of which name a text: directories of (tag, text or hex of four bytes), low byte first."""
    little = lambda n, size: n.to_bytes(size, "little").hex().upper()
    size = lambda entries: 6 + 12 * len(entries) + sum(LENGTHS.get(v, 0) for _, _, v in entries) if entries else 0
    places = [8]
    for entries in (main, below, gps, second):
        places.append(places[-1] + size(entries))
    to = {"@exif": places[1], "@gps": places[2], "@thumb": places[4]}
    out = ["4949" + little(42, 2) + little(8, 4)]
    for k, entries in enumerate((main, below, gps, second)):
        at, behind = places[k] + 6 + 12 * len(entries), []
        if not entries:
            continue
        table = little(len(entries), 2)
        for tag, kind, value in entries:
            count, place = (LENGTHS[value], little(at, 4)) if value in LENGTHS else (int(value.split(":")[1]) if ":" in value else 1, little(to[value], 4) if value in to else value.split(":")[0])
            table += little(tag, 2) + little(kind, 2) + little(count, 4) + place
            if value in LENGTHS:
                at += LENGTHS[value]
                behind.append(value)
        out += [table + little(places[3] if k == 0 and second else 0, 4), *behind]
    total = places[4] + len(THUMB) // 2
    return ["FFE1" + (8 + total).to_bytes(2).hex().upper() + "457869660000" + out[0], *out[1:], THUMB]


def in_sql(pieces: list[str]) -> str:
    return " || ".join(f"upper(hex(encode({TEXTS[p]}))) || '00'" if p in TEXTS else f"'{p}'" for p in pieces)


def in_spark(pieces: list[str]) -> Column:
    i = F.col("photo_id")
    return F.concat(*[F.concat(F.hex(F.encode(SPARK_TEXTS[p](i), "US-ASCII")), F.lit("00")) if p in TEXTS else F.lit(p) for p in pieces])


SECOND = [(0x0103, 3, "06000000"), (0x0201, 4, "@thumb"), (0x0202, 4, "04000000")]
GIVEN = block([(0x010F, 2, "make"), (0x013B, 2, "artist"), (0x8769, 4, "@exif"), (0x8825, 4, "@gps")], [(0x9003, 2, "date"), (0xA431, 2, "serial")], [(0x0001, 2, "4E000000:2")], SECOND)
STRIPPED = block([(0x010F, 2, "make"), (0x8769, 4, "@exif")], [(0x9003, 2, "date")], [], SECOND)
TURNED = block([(0x010F, 2, "make"), (0x0112, 3, "08000000"), (0x013B, 2, "artist"), (0x8769, 4, "@exif"), (0x8825, 4, "@gps")], [(0x9003, 2, "date"), (0xA431, 2, "serial")], [(0x0001, 2, "4E000000:2")], SECOND)
XMP, IPTC = "FFE1000A687474703A2F2F61", "FFED000650686F74"
_NOTES = f"CASE WHEN doc_id % 4 = 1 THEN '{XMP}' ELSE '' END || CASE WHEN doc_id % 5 = 2 THEN '{IPTC}' ELSE '' END"
_REST = f"substr({WHOLE}, 5)"


def noted_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(photo_id, bytes): photos behind an Exif block with all its directories, some with other notes."""
    i = F.col("photo_id")
    notes = F.concat(F.when(i % 4 == 1, XMP).otherwise(""), F.when(i % 5 == 2, IPTC).otherwise(""))
    head = F.unhex(F.concat(F.lit("FFD8"), in_spark(GIVEN), notes))
    return photos(spark, sf_dir).select("photo_id", F.concat(head, F.expr("substring(bytes, 3)")).alias("bytes"))


@query("photo_exif_tree", f"""
    WITH e AS (SELECT doc_id, unnest(['main', 'main', 'main', 'main', 'exif', 'exif', 'gps', 'second', 'second', 'second']) AS directory, unnest([0, 1, 2, 3, 0, 1, 0, 0, 1, 2]) AS place,
                      unnest([271, 315, 34665, 34853, 36867, 42033, 1, 259, 513, 514]) AS tag, unnest([2, 2, 4, 4, 2, 2, 2, 3, 4, 4]) AS kind, unnest([8, 12, 1, 1, 20, 8, 2, 1, 1, 1]) AS count,
                      unnest([{TEXTS["make"]}, {TEXTS["artist"]}, '82', '140', {TEXTS["date"]}, {TEXTS["serial"]}, 'N', '6', '200', '4']) AS value FROM documents)
    SELECT doc_id AS photo_id, directory, place::INTEGER AS place, tag::INTEGER AS tag, kind::INTEGER AS kind, count::BIGINT AS count, value FROM e
""")
def photo_exif_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of every directory of each photo's Exif block, by the pointers between them."""
    return exif.entry_table(noted_photos(spark, sf_dir))


def noted_query(name: str, step: str, hexed: str, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return seeded(noted_photos(spark, sf_dir).withColumn("seed", F.col("photo_id")), step, **params).select("photo_id", F.length("bytes").alias("n_out"), digest().alias("digest"))

    query(name, f"WITH {SQL_PHOTO}, r AS (SELECT doc_id, {hexed} AS h FROM ph) SELECT doc_id AS photo_id, (len(h) // 2)::INTEGER AS n_out, md5(h) AS digest FROM r")(run)


noted_query("photo_strip_private", "strip_exif", f"'FFD8' || {in_sql(STRIPPED)} || {_REST}")
noted_query("photo_exif_turned", "exif_orientation", f"'FFD8' || {in_sql(TURNED)} || {_NOTES} || {_REST}", value=8)


# --- Quantisation tables in the header --------------------------------------------------------------------------------


def two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with a second table, of 16 bits, in a segment of its own behind their frame."""
    i = F.col("photo_id")
    wide = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.lpad(F.hex((i * 7 + k * 100) % 60000 + 1), 4, "0")), "")
    more = F.unhex(F.concat(F.lit("FFDB008311"), wide))
    at = F.instr(F.hex("bytes"), COMPONENTS)
    behind = ((at + len(COMPONENTS) - 1) / 2).cast("int")
    return photos(spark, sf_dir).select("photo_id", F.concat(F.substring("bytes", F.lit(1), behind), more, F.substring("bytes", behind + 1, F.length("bytes") - behind)).alias("bytes"))


_NARROW = "list_transform(range(64), lambda k: (doc_id + k) % 255 + 1)"
_WIDE = "list_transform(range(64), lambda k: (doc_id * 7 + k * 100) % 60000 + 1)"
_BEFORE, _AFTER = HEAD.split("dqt ||")[0].rstrip(" |"), f"{FRAME} || dri || dht || {BODY}"


def _tables_sql(narrow: str, wide: str) -> str:
    hexed = lambda x, digits: f"array_to_string(list_transform({x}, lambda v: printf('%0{digits}X', v::BIGINT)), '')"
    return f"{_BEFORE} || 'FFDB00C400' || {hexed(narrow, 2)} || '11' || {hexed(wide, 4)} || {_AFTER}"


def table_query(name: str, narrow: str, wide: str, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return seeded(two_tables(spark, sf_dir).withColumn("seed", F.col("photo_id")), "qtable_decode_swap", **params).select("photo_id", F.length("bytes").alias("n_out"), digest().alias("digest"))

    query(name, f"WITH {SQL_PHOTO}, r AS (SELECT doc_id, {_tables_sql(narrow, wide)} AS h FROM ph) SELECT doc_id AS photo_id, (len(h) // 2)::INTEGER AS n_out, md5(h) AS digest FROM r")(run)


_scaled = lambda x, most: f"list_transform({x}, lambda v: least(greatest(floor(v * 2.5::DOUBLE + 0.5), 1), {most}))"
table_query("photo_tables_scaled", _scaled(_NARROW, 255), _scaled(_WIDE, 65535), factor=2.5)
table_query("photo_tables_swapped", f"list_transform({_WIDE}, lambda v: v & 255)", _NARROW, mode="swap")
table_query("photo_tables_quality", str(marker_steps.quality_table(0, 30)), str(marker_steps.quality_table(1, 30)), mode="table", quality=30)


# --- Headers that a wrong length swallows, donors by their tables -----------------------------------------------------


@query("photo_header_repaired", f"""
    WITH {SQL_PHOTO}, r AS (SELECT doc_id, 'FFD8' || dqt || {FRAME} || dri || dht || {BODY} AS h FROM ph)
    SELECT doc_id AS photo_id, (len(h) // 2)::INTEGER AS n_out, md5(h) AS digest FROM r
""")
def photo_header_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos behind a note that claims to hold all of them: the frame is found by its looks, with the tables before it."""
    hidden = photos(spark, sf_dir).select("photo_id", F.col("photo_id").alias("seed"), F.concat(F.unhex(F.lit("FFD8FFE1FFFF")), F.expr("substring(bytes, 3)"), F.unhex(F.repeat(F.lit("00"), 70_000))).alias("bytes"))
    found = seeded(hidden, "repair_header").withColumn("bytes", F.expr("substring(bytes, 1, length(bytes) - 70000)"))
    return found.select("photo_id", F.length("bytes").alias("n_out"), digest().alias("digest"))


CAMERAS = 12


@query("photo_best_donor", f"""
    WITH c AS (SELECT doc_id, doc_id % {CAMERAS} AS tables, doc_id % 10 AS frame FROM documents),
         n AS (SELECT doc_id, coalesce(lead(doc_id) OVER (PARTITION BY tables, frame ORDER BY doc_id), min(doc_id) OVER (PARTITION BY tables, frame)) AS c,
                      coalesce(lead(doc_id) OVER (PARTITION BY tables ORDER BY doc_id), min(doc_id) OVER (PARTITION BY tables)) AS b,
                      coalesce(lead(doc_id) OVER (PARTITION BY frame ORDER BY doc_id), min(doc_id) OVER (PARTITION BY frame)) AS a,
                      coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS z FROM c)
    SELECT doc_id AS photo_id, CASE WHEN c <> doc_id THEN c WHEN b <> doc_id THEN b WHEN a <> doc_id THEN a ELSE z END AS donor,
           CASE WHEN c <> doc_id THEN 3 WHEN b <> doc_id THEN 2 WHEN a <> doc_id THEN 1 ELSE 0 END AS score FROM n
""")
def photo_best_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The donor that fits each photo best by the tables and the frame in their headers: a dozen cameras, ten sizes."""
    i = F.col("photo_id")
    two = lambda n: F.lpad(F.hex(n.cast("long")), 2, "0")
    head = F.concat(F.lit("FFD8FFDB004300"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: two(k + i % CAMERAS % 4)), ""), F.lit("FFC000110800"), two(i % 10 + 16), F.lit("0010" + COMPONENTS))
    more = F.concat(F.lit("FFC400140001" + "00" * 15), two(F.floor(i % CAMERAS / 4)), F.lit("FFDA000C03010002110311003F00"))
    made = photos(spark, sf_dir).select("photo_id", F.concat(F.unhex(F.concat(head, more)), "bytes").alias("bytes"))
    own = F.concat(F.lit("none "), F.col("photo_id").cast("string"))
    signed = marker_steps.signature_table(made).withColumn("frame", F.coalesce("frame", own)).withColumn("tables", F.coalesce("tables", own))
    return lookups.best_donor(signed, "photo_id", "tables", "frame")
