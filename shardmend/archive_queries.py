"""Queries over archives put together of rows, and over masks painted on grids of blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardmend.catalogue import SQL_BLOCKS, blocks, digest, query, shared_run, table
from shardmend.operators import coefficients
from shardmend.sources import archives

PART = 16_384


def document_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of the texts of 64 documents, in parts that are written and read again."""
    i = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(F.floor(i / 64).alias("archive"), i.alias("place"), F.concat(F.lit("doc/"), i.cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("bytes"))
    folder = f"{shared_run(spark)}/archives"
    parts = archives.archived(files, PART)
    parts.write.parquet(folder)
    return spark.read.schema(parts.schema).parquet(folder)


_CRC = """
    tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) t),
    f AS (SELECT doc_id, doc_id // 64 AS archive, 'doc/' || doc_id || '.txt' AS name, upper(hex(encode(coalesce(text, '')))) AS hx, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents),
    c AS (SELECT f.*, len(name) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hx), 2), lambda i: ('0x' || substr(hx, i, 2))::BIGINT)), lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) AS crc FROM f, tab),
    p AS (SELECT *, coalesce(sum(30 + n + size) OVER w, 0)::BIGINT AS spot FROM c WINDOW w AS (PARTITION BY archive ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _little(x: str, size: int) -> str:
    return " || ".join(f"printf('%02X', (({x})::BIGINT >> {8 * k}) & 255)" for k in range(size))


@query("archive_directory", """
    WITH f AS (SELECT doc_id, doc_id // 64 AS archive, 'doc/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size FROM documents)
    SELECT archive, name, coalesce(sum(30 + len(name) + size) OVER (PARTITION BY archive ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "at", size FROM f
""")
def archive_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the directories of archives list: names, places and sizes."""
    return archives.directory(document_archives(spark, sf_dir)).select("archive", "name", "at", "size")


@query("archive_whole", f"""
    WITH {_CRC},
         k AS (SELECT *, '{archives.STORED}' || {_little("crc", 4)} || {_little("size", 4)} || {_little("size", 4)} || {_little("n", 2)} || '0000' AS known, upper(hex(encode(name))) AS nx FROM p),
         l AS (SELECT archive, string_agg('{archives.LOCAL + archives.NEEDS}' || known || nx || hx, '' ORDER BY doc_id) AS files, string_agg('{archives.CENTRAL}1400{archives.NEEDS}' || known || '{"00" * 10}' || {_little("spot", 4)} || nx, '' ORDER BY doc_id) AS directory, count(*) AS entries FROM k GROUP BY archive),
         w AS (SELECT archive, files || directory || '{archives.LAST}00000000' || {_little("entries", 2)} || {_little("entries", 2)} || {_little("len(directory) // 2", 4)} || {_little("len(files) // 2", 4)} || '0000' AS h FROM l)
    SELECT archive, len(h) // 2 AS size, md5(h) AS digest FROM w
""")
def archive_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each archive laid end to end, and that they follow each other."""
    whole = document_archives(spark, sf_dir).groupBy("archive").agg(F.expr("listagg(bytes) WITHIN GROUP (ORDER BY begin)").alias("bytes"))
    return whole.select("archive", F.length("bytes").cast("long").alias("size"), digest().alias("digest"))


@query("archive_extracted", "SELECT doc_id // 64 AS archive, 'doc/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size, true AS whole, md5(upper(hex(encode(coalesce(text, ''))))) AS digest FROM documents")
def archive_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files taken out of archives again, by their directories."""
    return archives.extracted(document_archives(spark, sf_dir), PART).select("archive", "name", "size", "whole", digest().alias("digest"))


# --- Masks: embeddings as blocks on a grid of ten columns, 24 rows, by their number -----------------------------------

MASK = {"w": 4, "h": 3, "data": [0, 64, 128, 255, 255, 0, 32, 200, 5, 100, 255, 0]}
COLUMNS, ROWS = 10, 24
_CELL = f"least(vec_id // {COLUMNS} % {ROWS} * {MASK['h']} // {ROWS}, {MASK['h'] - 1}) * {MASK['w']} + least(vec_id % {COLUMNS} * {MASK['w']} // {COLUMNS}, {MASK['w'] - 1})"
_WEIGHED = f"w AS (SELECT vec_id, coef, ({MASK['data']})[{_CELL} + 1]::DOUBLE / 255 * 0.7::DOUBLE AS w FROM b)"
_ROUND = "(sign({0}) * floor(abs({0}) + 0.5))::BIGINT"


def mask_query(name: str, mode: str, value: str) -> None:
    """A query that brushes every block; ``value``: coefficient v at place i (from 1) in SQL, under weight w."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        x, y = F.col("vec_id") % COLUMNS, F.floor(F.col("vec_id") / COLUMNS) % ROWS
        weight = coefficients.mask_weight(MASK, 0.7, x, y, F.lit(COLUMNS), F.lit(ROWS))
        rows = blocks(spark, sf_dir).withColumn("w", weight)
        return rows.select("vec_id", F.concat_ws(",", coefficients.brushed(F.col("coef"), F.col("w"), mode).cast("array<string>")).alias("coef"))

    query(name, f"WITH {SQL_BLOCKS}, {_WEIGHED} SELECT vec_id, CASE WHEN w > 0 THEN array_to_string(list_transform(range(1, len(coef) + 1), lambda i: {value}), ',') ELSE array_to_string(coef, ',') END AS coef FROM w")(run)


_PLACES = "[" + ", ".join(map(str, coefficients.zigzag())) + "]"
mask_query("block_mask_zero", "zero", f"CASE WHEN {_PLACES}[i] < least(greatest({_ROUND.format('(64.0::DOUBLE - w * 63.0::DOUBLE)')}, 1), 64) THEN coef[i] ELSE 0 END")
mask_query("block_mask_boost", "boost", f"CASE WHEN i = 1 THEN coef[i] ELSE least(greatest({_ROUND.format('(coef[i] * (1.0::DOUBLE + w * 3.0::DOUBLE))')}, -32767), 32767) END")
mask_query("block_mask_harsh", "harsh", "CASE WHEN i = 1 THEN coef[i] ELSE least(greatest(" + _ROUND.format("(" + _ROUND.format("(coef[i] / (1.0::DOUBLE + w * 15.0::DOUBLE))") + " * (1.0::DOUBLE + w * 15.0::DOUBLE))") + ", -32767), 32767) END")
