"""Queries over JPEG files made of documents: their structure, and steps on their segments.

The file of a document carries its text as scan data; what else is in it (Exif, a comment, a colour profile, noise,
restart markers, a second scan, a second picture, no end marker) depends on doc_id. SQL knows the pieces that a file is
made of, Spark has to find them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardmend import sql_draws
from shardmend.catalogue import CLUSTER, digest, query, set_checkpoints, table
from shardmend.operators import cards, donors, marker_steps
from shardmend.operators.seeded_steps import seeded
from shardmend.sources import markers

# Fixed pieces, in hex: blocks before and after the rotation, a comment, a profile, noise, what follows a size, scans.
EXIF_A, EXIF_B = "FFE100224578696600004949" + "2A000800000001001201030001000000", "00" + "0000" + "00000000"
NOTE, PROFILE, NOISE, RESTARTS = "FFFE00066E6F7465", "FFE200104943435F50524F46494C45000101", "FF05AB", "FFDD00040005"
COMPONENTS, TABLE = "03012200021101031101", "FFC400140001" + "00" * 15
SCAN, FIRST_SCAN, SECOND_SCAN = "FFDA000C03010002110311003F00", "FFDA000C03010002110311000000", "FFDA0008010100013F00"
GHOST = "FFD8FF4748"


def _hex2(n: Column, width: int = 2) -> Column:
    return F.lpad(F.hex(n.cast("long")), width, "0")


def photos(spark: SparkSession, sf_dir: str, whole: bool = False, bare: int = 0) -> DataFrame:
    """(photo_id, bytes): a JPEG file for each document; all of them ended, alone and without noise if ``whole``, the last of ``bare`` without Huffman tables."""
    i, hx = F.col("doc_id"), F.hex(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    n = F.length(hx) / 2
    at = [F.floor(n * k / 4).cast("int") for k in range(5)]
    q = [F.substring(hx, at[k] * 2 + 1, (at[k + 1] - at[k]) * 2) for k in range(4)]
    some = lambda every, rest, piece: F.when(i % every == rest, piece).otherwise("")
    passes, strips = i % 2 == 1, i % 4 == 2
    body = F.when(passes, F.concat(F.lit(FIRST_SCAN), q[0], q[1], F.lit(SECOND_SCAN), q[2], q[3])).when(strips, F.concat(F.lit(SCAN), q[0], F.lit("FFD0"), q[1], F.lit("FFD1"), q[2], F.lit("FFD2"), q[3])).otherwise(F.concat(F.lit(SCAN), *q))
    whole = F.concat(
        F.lit("FFD8"), some(3, 0, F.concat(F.lit(EXIF_A), _hex2(i % 8 + 1), F.lit(EXIF_B))), some(5, 0, F.lit(NOTE)), some(4, 1, F.lit(PROFILE)), F.lit("") if whole else some(13, 0, F.lit(NOISE)),
        F.lit("FFDB004300"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: _hex2((i + k) % 255 + 1)), ""),
        F.when(passes, "FFC2").otherwise("FFC0"), F.lit("001108"), _hex2(i % 50 + 16, 4), _hex2(i % 70 + 16, 4), F.lit(COMPONENTS),
        F.when(strips, RESTARTS).otherwise(""), F.when(i % bare == bare - 1, "").otherwise(F.concat(F.lit(TABLE), _hex2(i % 256))) if bare else F.concat(F.lit(TABLE), _hex2(i % 256)), body,
        F.lit("FFD9") if whole else F.when(i % 7 == 0, "").otherwise("FFD9"), F.lit("") if whole else F.when((i % 7 != 0) & (i % 11 == 0), GHOST).otherwise(""),
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), F.unhex(whole).alias("bytes"))


SQL_PHOTO = f"""
    t AS (SELECT doc_id, upper(hex(encode(coalesce(text, '')))) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
    u AS (SELECT doc_id, list_transform(range(4), lambda k: substr(hx, 2 * (n * k // 4) + 1, 2 * (n * (k + 1) // 4 - n * k // 4))) AS q FROM t),
    ph AS (SELECT doc_id, doc_id % 2 = 1 AS passes, doc_id % 4 = 2 AS strips, q,
                  CASE WHEN doc_id % 3 = 0 THEN '{EXIF_A}' || printf('%02X', doc_id % 8 + 1) || '{EXIF_B}' ELSE '' END AS exif,
                  CASE WHEN doc_id % 5 = 0 THEN '{NOTE}' ELSE '' END AS note, CASE WHEN doc_id % 4 = 1 THEN '{PROFILE}' ELSE '' END AS icc, CASE WHEN doc_id % 13 = 0 THEN '{NOISE}' ELSE '' END AS noise,
                  'FFDB004300' || array_to_string(list_transform(range(64), lambda k: printf('%02X', (doc_id + k) % 255 + 1)), '') AS dqt,
                  CASE WHEN doc_id % 2 = 1 THEN 'FFC2' ELSE 'FFC0' END || '001108' AS sof, printf('%04X', doc_id % 50 + 16) AS high, printf('%04X', doc_id % 70 + 16) AS wide,
                  CASE WHEN doc_id % 4 = 2 THEN '{RESTARTS}' ELSE '' END AS dri, '{TABLE}' || printf('%02X', doc_id % 256) AS dht,
                  CASE WHEN doc_id % 2 = 1 THEN '{FIRST_SCAN}' ELSE '{SCAN}' END AS sos,
                  CASE WHEN doc_id % 2 = 1 THEN q[1] || q[2] WHEN doc_id % 4 = 2 THEN q[1] || 'FFD0' || q[2] || 'FFD1' || q[3] || 'FFD2' || q[4] ELSE array_to_string(q, '') END AS scan,
                  CASE WHEN doc_id % 2 = 1 THEN '{SECOND_SCAN}' ELSE '' END AS sos2, CASE WHEN doc_id % 2 = 1 THEN q[3] || q[4] ELSE '' END AS scan2,
                  CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'FFD9' END AS eoi, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN '{GHOST}' ELSE '' END AS ghost FROM u)"""
FRAME = f"sof || high || wide || '{COMPONENTS}'"
HEAD = f"'FFD8' || exif || note || icc || noise || dqt || {FRAME} || dri"
BODY = "sos || scan || sos2 || scan2 || eoi || ghost"
WHOLE = f"{HEAD} || dht || {BODY}"
#: Each photo with the next one of the pool.
PAIRED = "pa AS (SELECT a.*, b.note AS note2, b.icc AS icc2, b.dqt AS dqt2, b.sof AS sof2, b.high AS high2, b.wide AS wide2, b.dri AS dri2, b.dht AS dht2, b.sos AS sos_2 FROM (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS next FROM ph) a JOIN ph b ON b.doc_id = a.next)"


def photo_query(name: str, step: str, hexed: str, more: str = "", of: str = "ph", **params) -> None:
    """A query that digests every photo after a step; ``hexed``: the file in hex, of its pieces. Donor steps take the next photo."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pool = photos(spark, sf_dir).withColumnRenamed("photo_id", "ord")
        rows = (donors.with_donor(pool) if of == "pa" else pool).withColumn("seed", F.col("ord"))
        return seeded(rows, step, other="other" if of == "pa" else None, **params).select(F.col("ord").alias("photo_id"), F.length("bytes").alias("n_out"), digest().alias("digest"))

    query(name, f"WITH RECURSIVE {SQL_PHOTO}{', ' + more if more else ''}, r AS (SELECT doc_id, {hexed} AS h FROM {of}) SELECT doc_id AS photo_id, (len(h) // 2)::INTEGER AS n_out, md5(h) AS digest FROM r")(run)


photo_query("photo_sof_dims", "sof_dims", WHOLE.replace("wide ||", "printf('%04X', doc_id % 70 + 32) ||"))
photo_query("photo_sof_size", "sof_dims", WHOLE.replace("high || wide", "printf('%04X', doc_id % 50 + 11) || '0280'"), width=640, height_delta=-5)
photo_query("photo_cbcr_swap", "cbcr_swap", WHOLE.replace(COMPONENTS, "03012200031101021101"))
photo_query("photo_strip_exif", "strip_exif", WHOLE.replace("exif || note || ", ""), mode="all")
photo_query("photo_icc_loss", "icc_loss", WHOLE.replace("icc || ", ""))
photo_query("photo_no_dht", "mjpeg_no_dht", f"{HEAD} || {BODY}", mode="none")
_STANDARD = f"'FFC4{len(markers.STANDARD_TABLES) + 2:04X}{markers.STANDARD_TABLES.hex().upper()}'"
photo_query("photo_standard_dht", "mjpeg_no_dht", f"{HEAD} || {_STANDARD} || {BODY}")
photo_query("photo_huffman_standard", "huffman_swap", f"{HEAD} || {_STANDARD} || {BODY}", PAIRED, "pa", source="standard")
photo_query("photo_color_matrix", "color_matrix", WHOLE.replace("'FFD8' ||", "'FFD8FFEE000E41646F6265006400000000' || '00' ||"), mode="adobe_flag_flip")
photo_query("photo_progressive_cut", "progressive_cut", f"CASE WHEN passes THEN {HEAD} || dht || sos || scan || 'FFD9' ELSE {WHOLE} END", scans=1)
photo_query("photo_progressive_drop_dc", "progressive_drop_dc", f"CASE WHEN passes THEN {HEAD} || dht || sos2 || scan2 || eoi || ghost ELSE {WHOLE} END")
photo_query("photo_second_picture", "mpf_ghost", f"CASE WHEN ghost <> '' THEN ghost ELSE {WHOLE} END")
photo_query("photo_exif_orientation", "exif_orientation", WHOLE.replace("exif ||", f"'{EXIF_A}03{EXIF_B}' ||"), value=3)
photo_query("photo_huffman_swap", "huffman_swap", f"{HEAD} || dht2 || {BODY}", PAIRED, "pa")
_rest = "sos2 || scan2 || eoi || ghost"
photo_query(
    "photo_rst_strip_loss", "rst_strip_loss",
    f"CASE WHEN NOT strips THEN {WHOLE} WHEN v[1] % 2 = 1 THEN {HEAD} || dht || sos || q[1] || 'FFD0' || q[3] || 'FFD1' || q[4] || {_rest} ELSE {HEAD} || dht || sos || q[1] || 'FFD0' || q[2] || 'FFD1' || q[4] || {_rest} END",
    sql_draws.draws("g", "ph", "1") + ", gp AS (SELECT * FROM ph JOIN g USING (doc_id))", "gp", count=1,
)
# Stray markers of the body become harmless: restarts where the donor has none, the second scan, an end that isn't the last.
_quiet = "replace(replace(replace(scan, 'FFD0', 'FED0'), 'FFD1', 'FED1'), 'FFD2', 'FED2')"
_body = f"CASE WHEN dri2 = '' THEN {_quiet} ELSE scan END || CASE WHEN sos2 = '' THEN '' ELSE 'FE' || substr(sos2, 3) END || scan2 || CASE WHEN ghost = '' THEN eoi ELSE 'FED9' || 'FE' || substr(ghost, 3) END"
photo_query("photo_header_graft", "header_graft", f"'FFD8' || note2 || icc2 || dqt2 || sof2 || high2 || wide2 || '{COMPONENTS}' || dri2 || dht2 || sos_2 || {_body}", PAIRED, "pa")
photo_query("photo_header_graft_skip", "header_graft", f"'FFD8' || note2 || icc2 || dqt2 || sof2 || high2 || wide2 || '{COMPONENTS}' || dri2 || dht2 || sos_2 || substr(scan || {_rest}, 21)", PAIRED, "pa", skip=10, neutralise_markers=False)
_spot = "substr(block, 1, 2 * (18 + v[1] % 18)) || printf('%02X', v[2] & 255) || substr(block, 2 * (18 + v[1] % 18) + 3)"
photo_query(
    "photo_exif_corrupt", "exif_corrupt", WHOLE.replace("exif ||", f"{_spot} ||"),
    sql_draws.draws("g", "ph", "2") + f", gp AS (SELECT *, CASE WHEN exif = '' THEN '{EXIF_A}01{EXIF_B}' ELSE exif END AS block FROM ph JOIN g USING (doc_id))", "gp",
)


@query("photo_segments", f"""
    WITH {SQL_PHOTO},
         e AS (SELECT doc_id, unnest(['SOI', 'APP1', 'COM', 'APP2', '', 'DQT', CASE WHEN passes THEN 'SOF2' ELSE 'SOF0' END, 'DRI', 'DHT', 'SOS', 'SOS', 'EOI']) AS name,
                      unnest(['FFD8', exif, note, icc, noise, dqt, {FRAME}, dri, dht, sos, sos2, eoi]) AS piece, unnest(['', '', '', '', '', '', '', '', '', scan, scan2, '']) AS rest, unnest(range(12)) AS k FROM ph),
         o AS (SELECT *, (sum(len(piece) + len(rest)) OVER (PARTITION BY doc_id ORDER BY k) - len(piece) - len(rest)) // 2 AS pl FROM e WHERE piece <> '')
    SELECT doc_id AS photo_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS seq, name, pl::INTEGER AS "offset", (len(piece) // 2)::INTEGER AS length,
           CASE WHEN name = 'SOS' THEN (pl + (len(piece) + len(rest)) // 2)::INTEGER END AS scan_end FROM o WHERE name <> ''
""")
def photo_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every photo, past noise and through restart markers and both scans."""
    return markers.segment_table(photos(spark, sf_dir)).select("photo_id", "seq", "name", "offset", "length", "scan_end")


@query("photo_exif_tags", "SELECT doc_id AS photo_id, 274 AS tag, 3 AS kind, 1::BIGINT AS count, doc_id % 8 + 1 AS value FROM documents WHERE doc_id % 3 = 0")
def photo_exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the first Exif directory of every photo that has one."""

    def run(batches):
        for batch in batches:
            rows = [(p, e) for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in marker_steps.exif_entries(b)]
            types = {"tag": pa.int32(), "kind": pa.int32(), "count": pa.int64(), "value": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int64()), *(pa.array([e[c] for _, e in rows], t) for c, t in types.items())], names=["photo_id", *types])

    return photos(spark, sf_dir).mapInArrow(run, "photo_id long, tag int, kind int, count long, value long")


@query("photo_qtable_scale", f"WITH {SQL_PHOTO} SELECT doc_id AS photo_id, array_to_string(list_transform(range(64), lambda k: least(greatest(floor(((doc_id + k) % 255 + 1) * 2.5 + 0.5)::INTEGER, 1), 255)), ',') AS qtable FROM ph")
def photo_qtable_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantisation values times 2.5, rounded half up and kept in a byte."""
    all_photos = photos(spark, sf_dir)
    tables = markers.segment_table(all_photos).where("name = 'DQT'").select("photo_id", (F.col("start") + 1).alias("at"))
    pairs = F.regexp_extract_all(F.hex(F.substring("bytes", F.col("at") + 1, F.lit(64))), F.lit("(..)"), F.lit(1))
    scaled = F.transform(pairs, lambda p: F.least(F.greatest(F.floor(F.conv(p, 16, 10).cast("int") * F.lit(2.5) + 0.5).cast("int"), F.lit(1)), F.lit(255)))
    return all_photos.join(tables, "photo_id").select("photo_id", F.concat_ws(",", scaled.cast("array<string>")).alias("qtable"))


@query("photo_scan_share", f"WITH {SQL_PHOTO} SELECT doc_id AS photo_id, (len({WHOLE}) // 2)::INTEGER AS n_bytes, ((len(scan) + len(scan2)) // 2)::BIGINT AS n_scan, CASE WHEN passes THEN 2 ELSE 1 END::BIGINT AS scans, eoi = '' AS cut_short FROM ph")
def photo_scan_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each photo is scan data, in how many scans, and whether it ends."""
    all_photos = photos(spark, sf_dir).withColumn("n_bytes", F.length("bytes"))
    found = markers.segment_table(all_photos).groupBy("photo_id").agg(F.sum(F.col("scan_end") - F.col("end")).alias("n_scan"), F.count("scan_end").alias("scans"), (F.max((F.col("name") == "EOI").cast("int")) == 0).alias("cut_short"))
    return all_photos.select("photo_id", "n_bytes").join(found, "photo_id").select("photo_id", "n_bytes", "n_scan", "scans", "cut_short")


@query("photo_inspection", f"""
    WITH {SQL_PHOTO}, w AS (SELECT ph.*, len({WHOLE}) // 2 AS size, len({HEAD} || dht || sos || scan || sos2 || scan2) // 2 AS tail FROM ph)
    SELECT doc_id AS photo_id, size, (doc_id % 70 + 16)::INTEGER AS width, (doc_id % 50 + 16)::INTEGER AS height, CASE WHEN passes THEN 194 ELSE 192 END AS sof, passes AS progressive, 3 AS components, 16 AS mcu_width, 16 AS mcu_height,
           ((doc_id % 70 + 31) // 16)::INTEGER AS mcu_cols, ((doc_id % 50 + 31) // 16)::INTEGER AS mcu_rows, CASE WHEN strips THEN 5 ELSE 0 END AS restart_interval, CASE WHEN passes THEN 2 ELSE 1 END AS scans,
           CASE WHEN ghost <> '' THEN 5 ELSE 0 END::BIGINT AS trailing_bytes, CASE WHEN noise <> '' THEN 3 ELSE 0 END::BIGINT AS garbage_bytes, CASE WHEN eoi <> '' THEN tail END AS eoi_offset FROM w
""")
def photo_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the headers of each photo tell, and how many of its bytes belong to nothing or come behind its end."""
    return markers.frame_table(photos(spark, sf_dir))


# --- Files on cards: photos and clips one after another, each from a new cluster on ----------------------------------

#: The file of each document in SQL: every ninth is a clip of its text. ``body`` ends where the file does, ``rest`` lies behind it.
SQL_FILES = f"""{SQL_PHOTO},
    fi AS (SELECT ph.doc_id, ph.doc_id // 64 AS card_id, ph.doc_id % 9 = 4 AS clip, n,
                  CASE WHEN ph.doc_id % 9 = 4 THEN '52494646' || printf('%02X', (n + 4) & 255) || printf('%02X', ((n + 4) >> 8) & 255) || printf('%02X', ((n + 4) >> 16) & 255) || '00' || '41564920' || hx ELSE {HEAD} || dht || sos || scan || sos2 || scan2 || eoi END AS body,
                  CASE WHEN ph.doc_id % 9 = 4 THEN '' ELSE ghost END AS rest, ph.doc_id % 9 = 4 OR eoi <> '' AS complete FROM ph JOIN t ON t.doc_id = ph.doc_id),
    pl AS (SELECT *, (len(body) + len(rest)) // 2 AS size, 2 + coalesce(sum((len(body) + len(rest) + {2 * CLUSTER - 1}) // {2 * CLUSTER}) OVER (PARTITION BY card_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM fi)"""


def card_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, file_no, size, bytes): photos, and a clip for every ninth document."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    size = F.lpad(F.hex((F.length("text") + 4).cast("long")), 8, "0")
    turned = F.concat(*[F.substring(size, k, 2) for k in (7, 5, 3, 1)])
    clips = text.where("doc_id % 9 = 4").select("doc_id", F.concat(F.unhex(F.concat(F.lit("52494646"), turned, F.lit("41564920"))), "text").alias("bytes"))
    rest = photos(spark, sf_dir).where("photo_id % 9 <> 4").withColumnRenamed("photo_id", "doc_id")
    return clips.unionByName(rest).select(F.floor(F.col("doc_id") / 64).alias("card_id"), (F.col("doc_id") % 64).alias("file_no"), F.length("bytes").cast("long").alias("size"), "bytes")


def file_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, cluster, file_no, bytes) of all files."""
    files = card_files(spark, sf_dir)
    chain = cards.allocate_fresh(files.drop("bytes"), CLUSTER)
    cut = files.select("card_id", "file_no", F.posexplode(cards.cut_up(F.col("bytes"), CLUSTER)).alias("pos", "bytes"))
    return chain.join(cut, ["card_id", "file_no", "pos"]).select("card_id", "cluster", "file_no", "bytes")


@query("card_carve_files", f"""
    WITH {SQL_FILES}
    SELECT card_id, first, complete, md5(body) AS digest FROM pl
    UNION ALL SELECT card_id, first + len(body) // {2 * CLUSTER}, false, md5(rest) FROM pl WHERE rest <> '' AND len(body) % {2 * CLUSTER} = 0
""")
def card_carve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos and clips carved from the clusters of each card, by their headers alone."""
    return cards.carved(file_clusters(spark, sf_dir).drop("file_no")).select("card_id", "first", "complete", digest().alias("digest"))


@query("card_carve", f"""
    WITH {SQL_FILES}, a AS (SELECT *, rest <> '' AND len(body) % {2 * CLUSTER} = 0 AS apart FROM pl)
    SELECT card_id, first, ((len(body) + CASE WHEN apart THEN 0 ELSE len(rest) END + {2 * CLUSTER - 1}) // {2 * CLUSTER})::BIGINT AS clusters, complete FROM a
    UNION ALL SELECT card_id, first + len(body) // {2 * CLUSTER}, 1, false FROM a WHERE apart
""")
def card_carve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many clusters each carved file runs over, what follows its end marker in them included."""
    return cards.carved(file_clusters(spark, sf_dir).drop("file_no")).select("card_id", "first", "clusters", "complete")


@query("card_carve_and_graft", f"""
    WITH {SQL_FILES}, h AS (SELECT ph.doc_id, 'FFD8' || note || dqt || {FRAME} || dri || dht || sos AS header FROM ph),
         d AS (SELECT card_id, header FROM (SELECT card_id, header, row_number() OVER (PARTITION BY card_id ORDER BY len(body) DESC, header DESC) AS r FROM pl JOIN h USING (doc_id) WHERE NOT clip AND complete AND doc_id % 64 % 3 <> 0) WHERE r = 1),
         o AS (SELECT card_id, first + 1 AS first, substr(CASE WHEN rest <> '' AND len(body) % {2 * CLUSTER} = 0 THEN body ELSE body || rest END, {2 * CLUSTER + 1}) AS piece FROM pl WHERE NOT clip AND doc_id % 64 % 3 = 0)
    SELECT card_id, first, len(header || piece) // 2 AS size, md5(header || piece) AS digest FROM o JOIN d USING (card_id) WHERE piece <> ''
""")
def card_carve_and_graft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third photo lost its first cluster: runs that no carved file claims go under the header of their card's largest whole photo."""
    set_checkpoints(spark)
    stored = file_clusters(spark, sf_dir)
    first = stored.groupBy("card_id", "file_no").agg(F.min_by(F.struct("cluster", F.hex(F.substring("bytes", 1, 2)).alias("head")), "cluster").alias("f"))
    lost = first.where("file_no % 3 = 0 AND f.head = 'FFD8'").select("card_id", "f.cluster")
    left = stored.join(lost, ["card_id", "cluster"], "left_anti").drop("file_no").checkpoint()
    found = cards.carved(left).checkpoint()
    claimed = found.select("card_id", F.explode(F.sequence("first", F.col("first") + F.col("clusters") - 1)).alias("cluster"))
    runs = cards.islands(cards.unclaimed(left.select("card_id", "cluster"), claimed)).select("card_id", "first", F.explode(F.sequence("first", "last")).alias("cluster"))
    pieces = runs.join(left, ["card_id", "cluster"]).groupBy("card_id", "first").agg(cards.in_order("bytes", "cluster").alias("bytes"))
    whole = found.where("complete").where(F.hex(F.substring("bytes", 1, 2)) == "FFD8")

    def headers(batches):
        for batch in batches:
            made = [marker_steps.bare_header(b) for b in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("card_id"), batch.column("n"), pa.array(made, pa.binary())], names=["card_id", "n", "header"])

    every = whole.select("card_id", F.length("bytes").alias("n"), "bytes").mapInArrow(headers, "card_id long, n int, header binary")
    best = every.groupBy("card_id").agg(F.max(F.struct("n", "header"))["header"].alias("header"))
    return cards.grafted(pieces, best).select("card_id", "first", F.length("bytes").cast("long").alias("size"), digest().alias("digest"))


@query("card_file_cluster_kinds", f"""
    WITH {SQL_FILES}, c AS (SELECT card_id, first + k AS cluster, regexp_extract_all(substr(body || rest, (k * {2 * CLUSTER} + 1)::BIGINT, {2 * CLUSTER}), '..') AS b FROM (SELECT *, unnest(range((size + {CLUSTER - 1}) // {CLUSTER})) AS k FROM pl)),
         s AS (SELECT *, len(list_filter(b, lambda x: x = '00')) AS zeros, len(list_filter(b, lambda x: x = 'FF')) AS full_, list_filter(range(1, len(b)), lambda k: b[k] = 'FF') AS marks FROM c)
    SELECT card_id, cluster, CASE WHEN zeros = len(b) OR full_ = len(b) THEN 'empty' WHEN len(b) >= 4 AND (array_to_string(b[1:3], '') = 'FFD8FF' OR array_to_string(b[1:4], '') = '52494646') THEN 'header'
           WHEN len(list_filter(marks, lambda k: b[k + 1] NOT IN ('00', 'D0', 'D1', 'D2', 'D3', 'D4', 'D5', 'D6', 'D7', 'D9', 'FF'))) <= 2 AND len(marks) > 0 AND zeros < len(b) // 4 THEN 'body' ELSE 'other' END AS kind FROM s
""")
def card_file_cluster_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each cluster of the cards looks like by itself."""
    return cards.cluster_kinds(file_clusters(spark, sf_dir)).select("card_id", "cluster", "kind")


@query("card_rebuild", f"""
    WITH {SQL_PHOTO}, b AS (SELECT doc_id // 64 AS card_id, string_agg(scan || eoi, '' ORDER BY doc_id) AS run, max(exif || note || icc || noise || dqt || dht) AS head FROM ph WHERE NOT passes AND NOT strips GROUP BY 1),
         s AS (SELECT card_id, head, string_split(run, 'FFD9') AS s FROM b WHERE len(run) >= 2000),
         p AS (SELECT card_id, head, unnest(range(1, len(s) + 1)) AS k, s FROM s),
         q AS (SELECT card_id, s[k] || CASE WHEN k < len(s) THEN 'FFD9' ELSE '' END AS piece, (len(array_to_string(s[1:k - 1], 'FFD9')) + CASE WHEN k > 1 THEN 4 ELSE 0 END) // 2 AS place FROM p)
    SELECT card_id, place, md5('FFD8FFDA' || piece) AS digest FROM q WHERE len(piece) >= 400
""")
def card_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of baseline photos in one run on each card, cut at end markers and put under a header."""
    pool = photos(spark, sf_dir).where("photo_id % 2 = 0 AND photo_id % 4 <> 2")
    segments = markers.segment_table(pool).where("name = 'SOS'").select("photo_id", "end")
    size = F.length("bytes") - F.col("end")
    # What follows the end marker (a second picture) is no part of the body.
    trailing = F.when((F.col("photo_id") % 7 != 0) & (F.col("photo_id") % 11 == 0), 5).otherwise(0)
    bodies = pool.join(segments, "photo_id").select(F.floor(F.col("photo_id") / 64).alias("card_id"), "photo_id", F.substring("bytes", F.col("end") + 1, size - trailing).alias("body"))
    runs = bodies.groupBy("card_id").agg(F.min("photo_id").alias("first"), F.sort_array(F.collect_list(F.struct("photo_id", "body"))).alias("rows"))
    runs = runs.select("card_id", "first", F.unhex(F.array_join(F.transform("rows", lambda r: F.hex(r["body"])), "")).alias("bytes"))
    headers = runs.select("card_id", F.unhex(F.lit("FFD8FFDA")).alias("header"))
    return cards.rebuilt(runs, headers, 1000, 200).select("card_id", "place", digest().alias("digest"))


@query("photo_embedded", f"""
    WITH {SQL_PHOTO}, w AS (SELECT ph.doc_id, n, {HEAD} || dht || sos || scan || sos2 || scan2 || eoi AS photo, eoi FROM ph JOIN t ON t.doc_id = ph.doc_id)
    SELECT doc_id AS photo_id, n AS "offset", len(photo) // 2 AS size, md5(photo) AS digest FROM w WHERE eoi <> '' AND len(photo) // 2 BETWEEN 256 AND 163839
""")
def photo_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small photos found inside payloads: here each lies behind its document's text."""
    text = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("photo_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"))
    both = photos(spark, sf_dir).join(text, "photo_id").select("photo_id", F.concat("text", "bytes").alias("bytes"))
    return cards.embedded_photos(both, "photo_id", least=256).select("photo_id", "offset", F.length("bytes").cast("long").alias("size"), digest().alias("digest"))
