"""Queries over cards with directory trees: documents as files in directories of their language and source.

Even cards have 32-byte entries with short names, odd ones sets of entries with long names. Files lie scattered over their
card but for those that their entry calls contiguous; directories are scattered behind them, and one of them names the root
as its child. SQL knows where each text lies, Spark has to find it from the root's first cluster alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shardmend.catalogue import CLUSTER, digest, query, set_checkpoints, table
from shardmend.operators import cards, directories


def _little(n: Column, size: int) -> Column:
    """A number in hex of ``size`` bytes, low byte first."""
    whole = F.lpad(F.hex(n.cast("long")), 2 * size, "0")
    return F.concat(*[F.substring(whole, 2 * k + 1, 2) for k in reversed(range(size))])


def _text(s: Column, size: int) -> Column:
    return F.rpad(F.hex(F.encode(s, "US-ASCII")), 2 * size, "20")


def _units(s: Column) -> Column:
    """ASCII in hex of two bytes for each character, filled up to whole entries of 15."""
    wide = F.regexp_replace(F.hex(F.encode(s, "US-ASCII")), "(..)", "$100")
    return F.rpad(wide, F.ceil(F.length(s) / 15).cast("int") * 60, F.lit("0"))


def short_slots(name: Column, is_dir: Column, gone: Column, first: Column, size: Column, long_one: Column) -> Column:
    """The 32-byte entry of a child in hex, after one of a long name where there is one."""
    stem, suffix = F.substring_index(name, ".", 1), F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise("")
    shown = F.concat(_text(stem, 8), _text(suffix, 3))
    shown = F.when(gone, F.concat(F.lit("E5"), F.substring(shown, 3, 20))).otherwise(shown)
    own = F.concat(shown, F.when(is_dir, "10").otherwise("20"), F.repeat(F.lit("00"), 8), _little(F.floor(first / 65536), 2), F.repeat(F.lit("00"), 4), _little(first % 65536, 2), _little(size, 4))
    return F.concat(F.when(long_one, F.concat(F.lit("41"), F.repeat(F.lit("61"), 10), F.lit("0F"), F.repeat(F.lit("62"), 20))).otherwise(""), own)


def set_slots(name: Column, is_dir: Column, gone: Column, first: Column, size: Column, contiguous: Column) -> Column:
    """The set of entries of a child in hex."""
    names = F.ceil(F.length(name) / 15)
    kind = lambda used, free: F.when(gone, free).otherwise(used)
    head = F.concat(kind("85", "05"), _little(names + 1, 1), F.lit("0000"), F.when(is_dir, "1000").otherwise("2000"), F.repeat(F.lit("00"), 26))
    stream = F.concat(kind("C0", "40"), F.when(contiguous, "03").otherwise("01"), F.lit("00"), _little(F.length(name), 1), F.repeat(F.lit("00"), 4), _little(size, 8), F.repeat(F.lit("00"), 4), _little(first, 4), _little(size, 8))
    member = F.when(gone, "4100").otherwise("C100")
    return F.concat(head, stream, F.regexp_replace(_units(name), "(.{60})", F.concat(member, F.lit("$1"))))


def tree_cards(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """volumes, table, stored and in_use of cards with directory trees."""
    i, text = F.col("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select(
        F.floor(i / 64).alias("card_id"), (i % 64).alias("file_no"), (F.floor(i / 64) % 2 == 1).alias("sets"), F.upper(F.coalesce("lang", F.lit("xx"))).alias("a"),
        F.upper(F.coalesce("source", F.lit("none"))).alias("b"), (i % 5 == 0).alias("gone"), (F.ascii(F.right(F.coalesce("source", F.lit("none")), F.lit(1))) % 3 == 1).alias("dir_gone"),
        ((F.floor(i / 64) % 2 == 1) & (i % 3 == 0)).alias("contiguous"), F.length(text).cast("long").alias("size"), text.alias("bytes"), (i % 2 == 1).alias("long_one"),
        F.when(F.floor(i / 64) % 2 == 1, F.concat(F.lit("Document "), i.cast("string"), F.lit(" of its card.txt"))).otherwise(F.concat(F.lit("D"), F.lpad(i.cast("string"), 7, "0"), F.lit(".TXT"))).alias("name"),
    )
    places = cards.file_clusters(docs.select("card_id", "file_no", "size"), CLUSTER).join(docs.select("card_id", "file_no", "contiguous"), ["card_id", "file_no"])
    order = [F.col("contiguous").desc(), F.when(F.col("contiguous"), F.col("file_no")).otherwise(F.col("pos")), F.when(F.col("contiguous"), F.col("pos")).otherwise(F.col("file_no"))]
    placed = places.withColumn("cluster", F.row_number().over(W.partitionBy("card_id").orderBy(*order)).cast("long") + 1).checkpoint()
    file_end = placed.groupBy("card_id").agg(F.max("cluster").alias("end"))
    firsts = placed.where("pos = 0").select("card_id", "file_no", F.col("cluster").alias("first"))

    # Children by the path of their directory; directories come before files, and one more names the root.
    none = F.lit(False)
    files = docs.join(firsts, ["card_id", "file_no"], "left").select("card_id", "sets", F.concat("a", F.lit("/"), "b", F.lit("/")).alias("path"), "name", none.alias("is_dir"), "gone", "contiguous", "size", "long_one", F.lit("").alias("to"), F.coalesce("first", F.lit(0)).alias("first"))
    upper = docs.select("card_id", "sets", F.lit("").alias("path"), F.col("a").alias("name"), none.alias("gone"), F.concat("a", F.lit("/")).alias("to")).distinct()
    lower = docs.select("card_id", "sets", F.concat("a", F.lit("/")).alias("path"), F.col("b").alias("name"), F.col("dir_gone").alias("gone"), F.concat("a", F.lit("/"), "b", F.lit("/")).alias("to")).distinct()
    loop = upper.where("to = 'EN/'").select("card_id", "sets", F.lit("EN/").alias("path"), F.lit("LOOP").alias("name"), none.alias("gone"), F.lit("").alias("to"))
    dirs = upper.unionByName(lower).unionByName(loop).select("card_id", "sets", "path", "name", F.lit(True).alias("is_dir"), "gone", none.alias("contiguous"), F.lit(0).cast("long").alias("size"), none.alias("long_one"), "to", F.lit(0).cast("long").alias("first"))
    children = files.unionByName(dirs)
    slots = F.when(F.col("sets"), F.ceil(F.length("name") / 15) + 2).otherwise(F.col("long_one").cast("long") + 1)
    extra = F.when(F.col("sets"), 0).when(F.col("path") == "", 1).otherwise(2)
    need = children.groupBy("card_id", "sets", "path").agg(F.sum(slots).alias("n")).withColumn("n", F.ceil((F.col("n") + extra) * 32 / CLUSTER).cast("int"))
    spots = need.select("card_id", "path", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("pos")).join(file_end, "card_id", "left")
    spots = spots.withColumn("cluster", F.coalesce("end", F.lit(1)) + F.row_number().over(W.partitionBy("card_id").orderBy("pos", "path"))).select("card_id", "path", "pos", "cluster").checkpoint()
    heads = spots.where("pos = 0").select("card_id", F.col("path").alias("to"), F.col("cluster").alias("dir_first"))
    known = children.join(heads, ["card_id", "to"], "left").withColumn("first", F.when(F.col("is_dir"), F.col("dir_first")).otherwise(F.col("first")))
    given = [F.col(c) for c in ("name", "is_dir", "gone", "first", "size")]
    hexed = F.when(F.col("sets"), set_slots(*given, F.col("contiguous"))).otherwise(short_slots(*given, F.col("long_one")))
    dots = F.when(F.col("sets"), "").when(F.col("path") == "", F.concat(F.hex(F.lit("CARD       ")), F.lit("08"), F.repeat(F.lit("00"), 20))).otherwise(F.concat(F.lit("2E" + "20" * 10 + "10" + "00" * 20), F.lit("2E2E" + "20" * 9 + "10" + "00" * 20)))
    lists = known.select("card_id", "sets", "path", (~F.col("is_dir")).alias("o"), "name", hexed.alias("x")).groupBy("card_id", "sets", "path").agg(F.sort_array(F.collect_list(F.struct("o", "name", "x"))).alias("x"))
    lists = lists.select("card_id", "path", F.unhex(F.concat(dots, F.array_join(F.transform("x", lambda c: c["x"]), ""))).alias("bytes"))
    piece = F.substring("bytes", (F.col("pos") * CLUSTER + 1).cast("int"), F.lit(CLUSTER)).alias("bytes")
    in_dirs = spots.join(lists, ["card_id", "path"]).select("card_id", "cluster", piece)
    cut = docs.where("size > 0").select("card_id", "file_no", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / CLUSTER).cast("int")), lambda k: F.substring(F.col("bytes"), k * CLUSTER + 1, F.lit(CLUSTER)))).alias("pos", "bytes"))
    in_files = placed.select("card_id", "file_no", "pos", "cluster").join(cut, ["card_id", "file_no", "pos"]).select("card_id", "cluster", "bytes")

    state = docs.select("card_id", "file_no", "sets", (F.col("gone") | F.col("dir_gone")).alias("lost"))
    owned = placed.join(state, ["card_id", "file_no"])
    chained = owned.where("NOT contiguous AND (sets OR NOT lost)").select("card_id", F.concat(F.lit("f"), F.col("file_no").cast("string")).alias("file_no"), "pos", "cluster")
    dir_chains = spots.select("card_id", F.concat(F.lit("d"), "path").alias("file_no"), "pos", "cluster")
    dead = lower.where("gone").select("card_id", F.col("to").alias("path")).distinct()
    in_use = owned.where("NOT lost").select("card_id", "cluster").unionByName(spots.join(dead, ["card_id", "path"], "left_anti").select("card_id", "cluster"))
    ends = spots.groupBy("card_id").agg(F.max("cluster").alias("last"))
    volumes = spots.where("path = '' AND pos = 0").select("card_id", F.col("cluster").alias("root")).join(ends, "card_id").withColumn("fs", F.when(F.col("card_id") % 2 == 1, "exfat").otherwise("fat32"))
    return {"volumes": volumes, "table": cards.fat(chained.unionByName(dir_chains)), "stored": in_files.unionByName(in_dirs).checkpoint(), "in_use": in_use}


SQL_TREES = f"""
    f AS (SELECT doc_id, doc_id // 64 AS card_id, doc_id % 64 AS file_no, doc_id // 64 % 2 = 1 AS sets, doc_id % 5 = 0 AS gone, ascii(right(coalesce(source, 'none'), 1)) % 3 = 1 AS dir_gone, doc_id // 64 % 2 = 1 AND doc_id % 3 = 0 AS contiguous,
                 upper(coalesce(lang, 'xx')) AS a, upper(coalesce(source, 'none')) AS b, upper(hex(encode(coalesce(text, '')))) AS hx, octet_length(encode(coalesce(text, ''))) AS size,
                 CASE WHEN doc_id // 64 % 2 = 1 THEN 'Document ' || doc_id || ' of its card.txt' ELSE 'D' || lpad(doc_id::VARCHAR, 7, '0') || '.TXT' END AS name FROM documents),
    cl AS (SELECT card_id, file_no, gone OR dir_gone AS lost, pos, rpad(substr(hx, {2 * CLUSTER} * pos + 1, {2 * CLUSTER}), {2 * CLUSTER}, '0') AS data,
                  1 + row_number() OVER (PARTITION BY card_id ORDER BY contiguous DESC, CASE WHEN contiguous THEN file_no ELSE pos END, CASE WHEN contiguous THEN pos ELSE file_no END) AS cluster
           FROM (SELECT *, unnest(range((size + {CLUSTER - 1}) // {CLUSTER})) AS pos FROM f))"""


@query("card_directory_walk", f"""
    WITH {SQL_TREES} SELECT card_id, a || '/' || b || '/' || name AS name, size, CASE WHEN contiguous THEN '{directories.NOTES["contiguous"]}' ELSE '{directories.NOTES["chain"]}' END AS note, md5(hx) AS digest
    FROM f WHERE NOT gone AND NOT dir_gone AND size > 0
""")
def card_directory_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files read through the tree, from each card's root on."""
    set_checkpoints(spark)
    t = tree_cards(spark, sf_dir)
    files = directories.walk(t["volumes"], t["table"], t["stored"])
    return directories.read_files(files, t["table"], t["stored"], t["in_use"], CLUSTER).select("card_id", "name", "size", "note", digest().alias("digest"))


_GONE_NAME = "CASE WHEN sets OR NOT (gone OR dir_gone) THEN {0} ELSE regexp_replace({0}, '/_', '/~') END"
_SHORT = "a || '/' || CASE WHEN NOT sets AND dir_gone THEN '_' || b[2:] ELSE b END || '/' || CASE WHEN NOT sets AND gone THEN '_' || name[2:] ELSE name END"


@query("card_directory_undelete", f"""
    WITH {SQL_TREES}, free AS (SELECT card_id, cluster, data, row_number() OVER (PARTITION BY card_id ORDER BY cluster) AS k FROM cl WHERE lost),
         heads AS (SELECT c.card_id, c.file_no, (SELECT count(*) FROM free WHERE free.card_id = c.card_id AND free.cluster < c.cluster) AS before FROM cl c JOIN f USING (card_id, file_no) WHERE pos = 0 AND lost AND NOT sets),
         blind AS (SELECT h.card_id, h.file_no, string_agg(free.data, '' ORDER BY free.k) AS hx FROM heads h JOIN f USING (card_id, file_no) JOIN free ON free.card_id = h.card_id AND free.k BETWEEN h.before + 1 AND h.before + (f.size + {CLUSTER - 1}) // {CLUSTER} GROUP BY 1, 2)
    SELECT f.card_id, {_GONE_NAME.format(_SHORT)} AS name, size,
           CASE WHEN size = 0 THEN '{directories.NOTES["empty"]}' WHEN sets AND contiguous OR (gone OR dir_gone) AND NOT sets THEN '{directories.NOTES["skipping"]}' WHEN gone OR dir_gone THEN '{directories.NOTES["kept"]}' ELSE '{directories.NOTES["chain"]}' END AS note,
           CASE WHEN NOT sets AND (gone OR dir_gone) AND size > 0 THEN md5(substr(blind.hx, 1, 2 * size)) ELSE md5(f.hx) END AS digest
    FROM f LEFT JOIN blind USING (card_id, file_no) WHERE gone OR dir_gone OR NOT contiguous
""")
def card_directory_undelete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted files too, along chains that are left or past clusters in use; live ones that no chain holds are not looked at."""
    set_checkpoints(spark)
    t = tree_cards(spark, sf_dir)
    files = directories.walk(t["volumes"], t["table"], t["stored"]).where("deleted OR NOT contiguous")
    return directories.read_files(files, t["table"], t["stored"], t["in_use"], CLUSTER, "skipping").select("card_id", "name", "size", "note", digest().alias("digest"))
