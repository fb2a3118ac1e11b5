"""Every registered query and its SQL twin."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardmend import sql_draws
from shardmend.functions import card_fields
from shardmend.functions.batches import BATCH_BYTES, BATCH_ROWS
from shardmend.functions.prng import Pcg32, batch_seed, repeat_seed
from shardmend.operators import byte_steps, cards, coefficients, donors, lookups, seeded_steps
from shardmend.plans import presets
from shardmend.functions.hashes import payload_hash
from shardmend.plans.recipe import Recipe, Repeat, Step, apply_recipe, needs_other, parse_recipe, plan_keys, write_recipe
from shardmend.sources import markers
from shardmend.sources.files import payload_kind


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches small enough for whole payloads, whatever a table holds; a session keeps smaller bounds."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        bound = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(bound).rstrip("b")) <= most:
            spark.conf.set(bound, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as byte payloads: (doc_id, bytes)."""
    return table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))


def digest(column: str = "bytes"):
    return F.md5(F.hex(column))


def recipe_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = Recipe([Step("ftp_ascii", {"direction": "lf_to_crlf"}), Step("truncate", {"percent": 60})])
    before = payloads(spark, sf_dir).withColumn("n_in", F.length("bytes").cast("long"))
    return apply_recipe(before, recipe).select("doc_id", "n_in", F.length("bytes").cast("long").alias("n_out"), digest().alias("digest"))


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {"recipe_chain": recipe_chain}

#: Payload bytes and their length in upper-case hex, for byte steps in SQL.
SQL_PAYLOAD = "p AS (SELECT doc_id, encode(text) AS b, octet_length(encode(text)) AS n, upper(hex(encode(text))) AS hx FROM documents)"

ORACLE_SQL: dict[str, str] = {
    "recipe_chain": """
        WITH a AS (SELECT doc_id, encode(text) AS b, encode(replace(replace(text, chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10))) AS c FROM documents),
             d AS (SELECT doc_id, octet_length(b) AS n_in, array_slice(c, 1, CAST(floor(octet_length(c) * 60.0::DOUBLE / 100) AS BIGINT)) AS e FROM a)
        SELECT doc_id, n_in, octet_length(e) AS n_out, md5(upper(hex(e))) AS digest FROM d
    """,
}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- Byte steps as column expressions -------------------------------------------------------------------------------


def byte_query(name: str, step: Callable[[Column], Column], hexed: str) -> None:
    """A query that digests every payload after a step; ``hexed``: the result as hex in SQL, of b, n and hx."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return payloads(spark, sf_dir).select("doc_id", step(F.col("bytes")).alias("bytes")).select("doc_id", F.length("bytes").cast("long").alias("n_out"), digest().alias("digest"))

    query(name, f"WITH {SQL_PAYLOAD}, r AS (SELECT doc_id, {hexed} AS h FROM p) SELECT doc_id, len(h) // 2 AS n_out, md5(h) AS digest FROM r")(run)


def _cut(percent: float) -> str:
    return f"CAST(floor(n * {float(percent)}::DOUBLE / 100) AS BIGINT)"


byte_query("byte_truncate", lambda b: byte_steps.truncate(b, 60), f"substr(hx, 1, 2 * {_cut(60)})")
byte_query("byte_truncate_exact", lambda b: byte_steps.truncate(b, byte=100), "substr(hx, 1, 200)")
byte_query("transfer_interrupted_download", byte_steps.interrupted_download, f"substr(hx, 1, 2 * {_cut(70)})")
byte_query("transfer_ftp_ascii", byte_steps.ftp_ascii, "upper(hex(encode(replace(replace(decode(b), chr(13) || chr(10), chr(10)), chr(10), chr(13) || chr(10)))))")
byte_query("transfer_ftp_crlf_to_lf", lambda b: byte_steps.ftp_ascii(byte_steps.ftp_ascii(b), "crlf_to_lf"), "upper(hex(encode(replace(decode(b), chr(13) || chr(10), chr(10)))))")
byte_query("byte_swap16", byte_steps.byte_swap16, f"substr(hx, 1, 2 * {_cut(50)}) || regexp_replace(substr(hx, 2 * {_cut(50)} + 1), '(..)(..)', '\\2\\1', 'g')")
_seven = f"regexp_replace(substr(hx, 2 * {_cut(30)} + 1), '(..)', '\\1,', 'g')"
for _i, _digit in enumerate("89ABCDEF"):
    _seven = f"regexp_replace({_seven}, '{_digit}(.),', '{_i}\\1,', 'g')"
byte_query("transfer_seven_bit", byte_steps.seven_bit, f"substr(hx, 1, 2 * {_cut(30)}) || replace({_seven}, ',', '')")
byte_query("byte_zero_fill", lambda b: byte_steps.zero_fill(b, 50, 256), f"substr(hx, 1, 2 * {_cut(50)}) || repeat('00', least(256, n - {_cut(50)})) || substr(hx, 2 * ({_cut(50)} + least(256, n - {_cut(50)})) + 1)")
byte_query("byte_patch", lambda b: byte_steps.byte_patch(b, 8, "DEADBEEF"), "substr(hx, 1, 16) || substr('DEADBEEF', 1, 2 * greatest(least(4, n - 8), 0)) || substr(hx, 2 * least(8 + greatest(least(4, n - 8), 0), n) + 1)")


# --- Recipes --------------------------------------------------------------------------------------------------------


@query("recipe_repeat", f"WITH {SQL_PAYLOAD}, r AS (SELECT doc_id, n, CAST(floor(n * 90.0::DOUBLE / 100) AS BIGINT) AS a, hx FROM p), s AS (SELECT doc_id, hx, CAST(floor(a * 90.0::DOUBLE / 100) AS BIGINT) AS c FROM r) SELECT doc_id, CAST(floor(c * 90.0::DOUBLE / 100) AS BIGINT) AS n_out, md5(substr(hx, 1, 2 * CAST(floor(c * 90.0::DOUBLE / 100) AS BIGINT))) AS digest FROM s")
def recipe_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = Recipe([Repeat([Step("truncate", {"percent": 90}), Step("byte_patch", enabled=False)], 3)])
    return apply_recipe(payloads(spark, sf_dir), recipe).select("doc_id", F.length("bytes").cast("long").alias("n_out"), digest().alias("digest"))


@query("recipe_from_json", ORACLE_SQL["byte_swap16"])
def recipe_from_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = parse_recipe('{"steps": [{"id": "byte_swap16", "params": {"start": 50}}, {"id": "truncate", "enabled": false}]}')
    return apply_recipe(payloads(spark, sf_dir), recipe).select("doc_id", F.length("bytes").cast("long").alias("n_out"), digest().alias("digest"))


@query("recipe_patch_stale", f"WITH {SQL_PAYLOAD}, r AS (SELECT doc_id, n, CASE WHEN doc_id % 2 = 0 THEN substr(hx, 1, 4) || substr('FFFF', 1, 2 * greatest(least(2, n - 2), 0)) || substr(hx, 2 * least(2 + greatest(least(2, n - 2), 0), n) + 1) ELSE hx END AS h FROM p) SELECT doc_id, doc_id % 2 <> 0 AS stale, md5(h) AS digest FROM r")
def recipe_patch_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that were made for a version of a payload: they hold where its hash is still the same."""
    docs = payloads(spark, sf_dir)
    made_for = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.sha2("bytes", 256)).otherwise("gone").alias("base"))
    joined = docs.join(made_for, "doc_id").withColumn("stale", F.sha2("bytes", 256) != F.col("base"))
    return joined.select("doc_id", "stale", F.when(F.col("stale"), F.col("bytes")).otherwise(byte_steps.byte_patch(F.col("bytes"), 2, "FFFF")).alias("bytes")).select("doc_id", "stale", digest().alias("digest"))


def _sql_hash(text: str) -> str:
    """The two-part hash of a text in SQL; both halves travel in one number."""
    a = "(xor((h // 4294967296)::UBIGINT, c::UBIGINT)::UHUGEINT * 16777619::UHUGEINT % 4294967296::UHUGEINT)"
    b = "(xor((h % 4294967296)::UBIGINT, c::UBIGINT)::UHUGEINT * 1540483477::UHUGEINT % 4294967296::UHUGEINT)::UBIGINT"
    fold = f"list_reduce(list_transform(string_split({text}, ''), lambda x: ord(x)::UHUGEINT), lambda h, c: {a} * 4294967296::UHUGEINT + xor({b}, {b} >> 15::UBIGINT)::UHUGEINT, 2166136261::UHUGEINT * 4294967296::UHUGEINT + {0x01000193 ^ 0x5BD1E995}::UHUGEINT)"
    return f"(SELECT lower(to_base((z // 4294967296)::BIGINT, 36)) || lower(to_base((z % 4294967296)::BIGINT, 36)) FROM (SELECT {fold} AS z))"


_FIRST_KEY, _LAST_KEY = '|Struncate:5:{"percent":60}', "|Sbyte_swap16:0:{}"


@query("recipe_plan_keys", f"WITH a AS (SELECT doc_id, {_sql_hash(f"'src:' || source || doc_id || '{_FIRST_KEY}'")} AS k FROM documents), b AS (SELECT doc_id, k, {_sql_hash(f"k || '{_LAST_KEY}'")} AS m FROM a) SELECT doc_id, unnest([0, 1, 2]) AS node, unnest([k, k, m]) AS key FROM b")
def recipe_plan_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of the results of each prefix of a recipe on every document: a disabled step keeps the key before it."""
    recipe = Recipe([Step("truncate", {"percent": 60}, 5), Step("seven_bit", enabled=False), Step("byte_swap16")])
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(plan_keys(recipe, F.concat("source", F.col("doc_id").cast("string")))).alias("node", "key"))


_NESTED = """{"format": "some-recipe", "version": 1, "engine": "1", "steps": [
    {"type": "repeat", "times": 2, "seed": 9, "children": [{"type": "step", "id": "truncate", "params": {"percent": 90}, "seed": 1}, {"type": "step", "id": 7, "params": {}}]},
    {"type": "patch", "baseHash": "BASE", "patches": [{"offset": 1, "bytes": [222, 173]}, {"offset": 3, "bytes": [1]}, {"bytes": [1]}]},
    {"type": "step", "id": "not_made_yet", "params": {}, "seed": 3}, {"type": "note"}, {"type": "step", "id": "truncate", "params": {"byte": 5}, "enabled": false}]}"""


@query("recipe_nested", f"WITH {SQL_PAYLOAD}, r AS (SELECT doc_id, n, CAST(floor(CAST(floor(n * 90.0::DOUBLE / 100) AS BIGINT) * 90.0::DOUBLE / 100) AS BIGINT) AS c, hx FROM p), s AS (SELECT doc_id, substr(hx, 1, 2 * c) AS h FROM r), t AS (SELECT doc_id, CASE WHEN len(h) >= 8 AND h = (SELECT h FROM s WHERE len(h) >= 8 ORDER BY doc_id LIMIT 1) THEN substr(h, 1, 2) || 'DEAD01' || substr(h, 9) ELSE h END AS h FROM s) SELECT doc_id, len(h) // 2 AS n_out, md5(h) AS digest FROM t")
def recipe_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe with a repeat, a patch made for one version of one payload, a step that isn't known and one that is off."""
    docs = payloads(spark, sf_dir)
    cut = apply_recipe(docs, Recipe(parse_recipe(_NESTED).nodes[:1])).where("length(bytes) >= 4")
    base = cut.orderBy("doc_id").limit(1).select(payload_hash(F.col("bytes")).alias("h")).first()
    recipe = parse_recipe(_NESTED.replace("BASE", base["h"] if base else ""))
    recipe = parse_recipe(write_recipe(recipe))
    return apply_recipe(docs, recipe).select("doc_id", F.length("bytes").cast("long").alias("n_out"), digest().alias("digest"))


@query("recipe_steps_animation", f"WITH {SQL_PAYLOAD}, s AS (SELECT doc_id, hx, n FROM p) SELECT doc_id, k AS n_steps, md5(CASE k WHEN 0 THEN hx WHEN 1 THEN substr(hx, 1, 2 * {_cut(60)}) ELSE substr(hx, 1, least(16, 2 * {_cut(60)})) || substr('DEADBEEF', 1, 2 * greatest(least(4, {_cut(60)} - 8), 0)) || substr(substr(hx, 1, 2 * {_cut(60)}), 2 * least(8 + greatest(least(4, {_cut(60)} - 8), 0), {_cut(60)}) + 1) END) AS digest FROM s, (SELECT unnest([0, 1, 2]) AS k)")
def recipe_steps_animation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every prefix of a recipe on every payload, from none of its steps to all."""
    recipe = Recipe([Step("truncate", {"percent": 60}), Step("byte_patch", {"at": 8, "hexed": "DEADBEEF"})])
    docs = payloads(spark, sf_dir)
    frames = [apply_recipe(docs, Recipe(recipe.nodes[:k])).select("doc_id", F.lit(k).alias("n_steps"), digest().alias("digest")) for k in range(len(recipe.nodes) + 1)]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


# --- Seeds ----------------------------------------------------------------------------------------------------------


@query("batch_seeds", "SELECT doc_id, (4294967290 + doc_id) % 4294967296 AS seed FROM documents")
def batch_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", batch_seed(F.lit(4294967290).cast("long"), F.col("doc_id")).alias("seed"))


_mix = "(SELECT doc_id, r, xor(xor(doc_id, (77::HUGEINT * 2654435761 % 4294967296)::BIGINT), ((r + 1)::HUGEINT * 2246822507 % 4294967296)::BIGINT) AS h FROM documents, (SELECT unnest(range(3)) AS r))"


@query("repeat_seeds", f"WITH a AS {_mix}, b AS (SELECT doc_id, r, (xor(h, h >> 16)::HUGEINT * 2146121005 % 4294967296)::BIGINT AS h FROM a), c AS (SELECT doc_id, r, (xor(h, h >> 15)::HUGEINT * 2221713035 % 4294967296)::BIGINT AS h FROM b) SELECT doc_id, r::INTEGER AS turn, xor(h, h >> 16) AS seed FROM c")
def repeat_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("turn"))
    return docs.select("doc_id", "turn", repeat_seed(F.col("doc_id"), F.lit(77).cast("long"), F.col("turn").cast("long")).alias("seed"))


@query("pcg32_stream", """
    WITH RECURSIVE g(seed, i, st) AS (
        SELECT d.doc_id, 0, ((2493549199::UHUGEINT + d.doc_id::UHUGEINT) % 18446744073709551616::UHUGEINT * 6364136223846793005::UHUGEINT + 2493549199::UHUGEINT) % 18446744073709551616::UHUGEINT FROM documents d
        UNION ALL
        SELECT seed, i + 1, (st * 6364136223846793005::UHUGEINT + 2493549199::UHUGEINT) % 18446744073709551616::UHUGEINT FROM g WHERE i < 4),
    o AS (SELECT seed, i, (xor(st::UBIGINT >> 18::UBIGINT, st::UBIGINT) >> 27::UBIGINT) & 4294967295::UBIGINT AS x, st::UBIGINT >> 59::UBIGINT AS r FROM g)
    SELECT seed, i AS draw, (((x >> r) | ((x::UHUGEINT * (1::UHUGEINT << ((32::UBIGINT - r) % 32::UBIGINT)::UHUGEINT)) % 4294967296::UHUGEINT)::UBIGINT) & 4294967295::UBIGINT)::BIGINT AS value FROM o
""")
def pcg32_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    draw = F.pandas_udf(lambda s: s.map(lambda x: Pcg32(x).draw(5).astype("int64").tolist()), T.ArrayType(T.LongType()))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed"), F.posexplode(draw("doc_id")).alias("draw", "value"))


# --- Seeded damage ----------------------------------------------------------------------------------------------------

SEEDED_TWINS = sql_draws.twins()


def seeded_query(name: str, step: str | None = None, **params) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = payloads(spark, sf_dir).withColumn("seed", F.col("doc_id")).withColumn("n_in", F.length("bytes"))
        return seeded_steps.seeded(docs, step or name, **params).select("doc_id", "n_in", F.length("bytes").alias("n_out"), digest().alias("digest"))

    query(f"seeded_{name}", SEEDED_TWINS.get(name))(run)


for _name, _params in {
    "bitflip": {"rate": 200.0}, "byte_delete": {"count": 3, "length": 5}, "byte_insert": {"count": 2}, "fake_marker": {"count": 3}, "zero_run": {"length": 64}, "ransomware": {"kb": 1},
    "ftp_stretch": {}, "base64_damage": {}, "chipoff_xor": {"page_kb": 1}, "stutter_read": {"cluster_kb": 1}, "dropped_sectors": {}, "tool_fill_pattern": {}, "flash_fault": {"mode": "burst", "page_kb": 2},
}.items():
    seeded_query(_name, **_params)
seeded_query("flash_zero", "flash_fault", mode="zero", page_kb=2)


# --- Donors ---------------------------------------------------------------------------------------------------------

SQL_POOL = "p AS (SELECT a.doc_id, upper(hex(encode(a.text))) AS x, octet_length(encode(a.text)) AS n, upper(hex(encode(b.text))) AS y, octet_length(encode(b.text)) AS m FROM documents a JOIN documents b ON b.doc_id = (a.doc_id + 1) % (SELECT count(*) FROM documents))"
SQL_BODY = "q AS (SELECT *, least(n, 624) AS s FROM p)"


def donor_query(name: str, step: Callable[[Column, Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        pool = payloads(spark, sf_dir).withColumnRenamed("doc_id", "ord")
        return donors.with_donor(pool).select(F.col("ord").alias("doc_id"), step(F.col("bytes"), F.col("other")).alias("bytes")).select("doc_id", F.length("bytes").cast("long").alias("n_out"), digest().alias("digest"))

    query(name, f"WITH {SQL_POOL}, {SQL_BODY}, {sql} SELECT doc_id, len(h) // 2 AS n_out, md5(h) AS digest FROM r")(run)


donor_query("card_cross_link", lambda b, o: donors.cross_link(b, o, 55, 1), "t AS (SELECT *, s + floor(floor((n - s) * 0.55::DOUBLE) / 1024)::BIGINT * 1024 AS k, floor(floor(m * 0.55::DOUBLE) / 1024)::BIGINT * 1024 AS d FROM q), r AS (SELECT doc_id, substr(x, 1, 2 * k) || substr(y, 2 * d + 1) AS h FROM t)")
donor_query("card_recuva_contiguous", lambda b, o: donors.recuva_contiguous(b, o, 45, 1), "t AS (SELECT *, s + floor(floor((n - s) * 0.45::DOUBLE) / 1024)::BIGINT * 1024 AS k, floor((m // 3) / 1024)::BIGINT * 1024 AS d FROM q), r AS (SELECT doc_id, substr(x, 1, 2 * k) || substr(repeat(y, ceil((n - k + d) / m)::BIGINT), 2 * d + 1, 2 * (n - k)) AS h FROM t)")
donor_query("card_interleave", lambda b, o: donors.interleave(b, o, 20, 1, 1), "t AS (SELECT *, s + floor(floor((n - s) * 0.2::DOUBLE) / 1024)::BIGINT * 1024 AS k FROM q), u AS (SELECT *, ceil((n - k) / 1024.0)::BIGINT AS turns, greatest(ceil(m / 1024.0)::BIGINT, 1) AS lap FROM t), r AS (SELECT doc_id, substr(x, 1, 2 * k) || array_to_string(list_transform(range(turns), lambda i: substr(x, 2 * (k + i * 1024) + 1, 2048) || CASE WHEN i < turns - 1 THEN substr(y, 2 * (i % lap) * 1024 + 1, 2048) ELSE '' END), '') AS h FROM u)")


_splice_low = "CASE WHEN m > 4096 THEN v[1] % (m - 4095) // 1024 * 1024 ELSE 0 END"
_splice_piece = "substr(repeat(substr(y, 2 * low + 1, 8192), ceil(4096.0 / greatest(1, least(4096, m - low)))::BIGINT), 1, 8192)"


@query("seeded_splice", f"WITH RECURSIVE {SQL_POOL}, {sql_draws.draws('g', 'p', '1')}, q AS (SELECT *, {_splice_low} AS low, least(floor(n * 0.5::DOUBLE)::BIGINT // 1024 * 1024, n) AS place FROM p JOIN g USING (doc_id)), r AS (SELECT doc_id, CASE WHEN m = 0 THEN x ELSE substr(x, 1, 2 * place) || {_splice_piece} || substr(x, 2 * place + 8193) END AS h FROM q) SELECT doc_id, (len(h) // 2)::INTEGER AS n_out, md5(h) AS digest FROM r")
def seeded_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = payloads(spark, sf_dir).withColumnRenamed("doc_id", "ord")
    pairs = donors.with_donor(pool).withColumn("seed", F.col("ord"))
    return seeded_steps.spliced(pairs, cluster_kb=1).select(F.col("ord").alias("doc_id"), F.length("bytes").alias("n_out"), digest().alias("digest"))


@query("pool_rotation", "SELECT a.doc_id, k::INTEGER AS k, (a.doc_id + 1 + k) % (SELECT count(*) FROM documents) AS donor FROM documents a, (SELECT unnest(range(3)) AS k)")
def pool_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donors.pool_rotation(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord")), 3).select(F.col("ord").alias("doc_id"), "k", "donor")


# --- Cards: documents as files on cards of 64, the last 16 written after every other of the rest was deleted --------

CLUSTER = 512


def set_checkpoints(spark: SparkSession) -> None:
    """The shared folder for checkpoints. Where none is set, a local session takes a temporary one; a cluster must name it."""
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or f"{tempfile.gettempdir()}/checkpoints")


def shared_run(spark: SparkSession) -> str:
    """A folder of its own for what a query writes on the way, beside the shared checkpoints."""
    set_checkpoints(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"


SQL_CARD = f"""
    files AS (SELECT doc_id // 64 AS card_id, doc_id % 64 AS file_no, octet_length(encode(text)) AS size FROM documents),
    sized AS (SELECT *, (size + {CLUSTER} - 1) // {CLUSTER} AS n FROM files),
    fresh AS (SELECT card_id, file_no, size, n, 2 + coalesce(sum(n) OVER (PARTITION BY card_id ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first,
                     row_number() OVER (PARTITION BY card_id ORDER BY file_no) % 2 = 1 AS gone FROM sized WHERE file_no < 48),
    old AS (SELECT card_id, file_no, gone, i AS pos, first + i AS cluster FROM (SELECT *, unnest(range(n)) AS i FROM fresh)),
    hole AS (SELECT card_id, cluster, row_number() OVER (PARTITION BY card_id ORDER BY cluster) AS k FROM old WHERE gone),
    need AS (SELECT card_id, file_no, i AS pos, row_number() OVER (PARTITION BY card_id ORDER BY file_no, i) AS k FROM (SELECT *, unnest(range(n)) AS i FROM sized WHERE file_no >= 48)),
    fin AS (SELECT card_id, max(cluster) AS last, count(*) FILTER (gone) AS holes FROM old GROUP BY card_id),
    new AS (SELECT need.card_id, need.file_no, need.pos, coalesce(hole.cluster, fin.last + need.k - fin.holes) AS cluster FROM need LEFT JOIN hole USING (card_id, k) JOIN fin USING (card_id)),
    live AS (SELECT card_id, file_no, pos, cluster FROM old WHERE NOT gone UNION ALL SELECT * FROM new)"""


def card_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = payloads(spark, sf_dir)
    files = docs.select(F.floor(F.col("doc_id") / 64).alias("card_id"), (F.col("doc_id") % 64).alias("file_no"), F.length("bytes").cast("long").alias("size"))
    first = files.where("file_no < 48")
    old = cards.allocate_fresh(first, CLUSTER)
    gone = cards.deleted_every_other(first)
    freed = old.join(gone.select("card_id", "file_no"), ["card_id", "file_no"], "left_semi")
    new = cards.allocate_into_free(old, freed, files.where("file_no >= 48"), CLUSTER)
    live = old.join(gone.select("card_id", "file_no"), ["card_id", "file_no"], "left_anti").unionByName(new)
    return {"files": files, "old": old, "gone": gone, "freed": freed, "new": new, "live": live}


@query("card_allocation", f"WITH {SQL_CARD} SELECT card_id, file_no, pos::INTEGER AS pos, cluster FROM live")
def card_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return card_tables(spark, sf_dir)["live"]


@query("card_fragments", f"WITH {SQL_CARD}, j AS (SELECT *, cluster - lag(cluster) OVER (PARTITION BY card_id, file_no ORDER BY pos) AS gap FROM live) SELECT card_id, file_no, count(*) AS clusters, count(*) FILTER (gap <> 1) + 1 AS fragments FROM j GROUP BY card_id, file_no")
def card_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.fragments(card_tables(spark, sf_dir)["live"])


@query("card_fat", f"WITH {SQL_CARD} SELECT card_id, cluster, lead(cluster) OVER (PARTITION BY card_id, file_no ORDER BY pos) AS next FROM live")
def card_fat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.fat(card_tables(spark, sf_dir)["live"])


@query("card_fat_chains", f"WITH {SQL_CARD}, h AS (SELECT card_id, file_no, min(cluster) FILTER (pos = 0) AS head FROM live GROUP BY 1, 2) SELECT card_id, head, pos, cluster FROM live JOIN h USING (card_id, file_no)")
def card_fat_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    set_checkpoints(spark)
    live = card_tables(spark, sf_dir)["live"]
    return cards.follow_chains(cards.fat(live), live.where("pos = 0").select("card_id", F.col("cluster").alias("head")))


@query("card_unclaimed_islands", f"WITH {SQL_CARD}, u AS (SELECT card_id, cluster FROM old WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.card_id = old.card_id AND l.cluster = old.cluster)), r AS (SELECT *, cluster - row_number() OVER (PARTITION BY card_id ORDER BY cluster) AS run FROM u) SELECT card_id, min(cluster) AS first, max(cluster) AS last, count(*) AS clusters FROM r GROUP BY card_id, run")
def card_unclaimed_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = card_tables(spark, sf_dir)
    return cards.islands(cards.unclaimed(t["old"].select("card_id", "cluster"), t["live"]))


@query("card_overwritten", f"WITH {SQL_CARD} SELECT n.card_id, n.file_no, o.file_no AS victim, count(*) AS clusters FROM new n JOIN old o ON o.card_id = n.card_id AND o.cluster = n.cluster WHERE o.gone GROUP BY 1, 2, 3")
def card_overwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = card_tables(spark, sf_dir)
    return cards.overwritten(t["freed"], t["new"])


@query("card_undelete_contiguous", f"WITH {SQL_CARD} SELECT o.card_id, o.file_no, count(*) AS clusters, count(*) FILTER (l.cluster IS NULL) AS intact FROM old o LEFT JOIN live l ON l.card_id = o.card_id AND l.cluster = o.cluster WHERE o.gone GROUP BY 1, 2")
def card_undelete_contiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = card_tables(spark, sf_dir)
    first = t["old"].where("pos = 0").select("card_id", "file_no", F.col("cluster").alias("first"))
    return cards.undelete_contiguous(t["gone"].join(first, ["card_id", "file_no"]), t["live"], CLUSTER)


@query("card_dense_image", f"WITH {SQL_CARD}, e AS (SELECT card_id, max(cluster) AS last FROM live GROUP BY card_id), a AS (SELECT card_id, unnest(range(2, last + 1)) AS cluster FROM e) SELECT a.card_id, a.cluster, CASE WHEN l.cluster IS NULL THEN 'blank' ELSE 'used' END AS state FROM a LEFT JOIN live l ON l.card_id = a.card_id AND l.cluster = a.cluster")
def card_dense_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = card_tables(spark, sf_dir)["live"]
    return cards.dense_image(live, live.groupBy("card_id").agg(F.max("cluster").alias("last")))


@query("card_cluster_kinds", "WITH p AS (SELECT doc_id, encode(text) AS b FROM documents) SELECT doc_id, CASE WHEN octet_length(b) = 0 THEN 'empty' ELSE 'other' END AS kind FROM p")
def card_cluster_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.cluster_kinds(payloads(spark, sf_dir)).select("doc_id", "kind")


@query("card_cluster_owner", f"WITH {SQL_CARD} SELECT card_id, cluster, file_no FROM old")
def card_cluster_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file holds each cluster of a fresh card, from first clusters and lengths alone."""
    old = card_tables(spark, sf_dir)["old"]
    files = old.groupBy("card_id", "file_no").agg(F.min("cluster").alias("low"), (F.max("cluster") + 1).alias("high"))
    return lookups.interval_join(old.select("card_id", "cluster"), files, "card_id", "cluster", "low", "high", 16).select("card_id", "cluster", "file_no")


@query("card_last_start", f"WITH {SQL_CARD}, s AS (SELECT card_id, first, file_no FROM fresh WHERE n > 0), e AS (SELECT card_id, max(cluster) AS last FROM old GROUP BY card_id), p AS (SELECT card_id, unnest(range(0, last + 1)) AS cluster FROM e) SELECT p.card_id, p.cluster, last_value(s.file_no IGNORE NULLS) OVER (PARTITION BY p.card_id ORDER BY p.cluster) AS file_no FROM p LEFT JOIN s ON s.card_id = p.card_id AND s.first = p.cluster")
def card_last_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last file that starts at or before each cluster."""
    old = card_tables(spark, sf_dir)["old"]
    starts = old.where("pos = 0").select("card_id", "cluster", "file_no")
    points = old.groupBy("card_id").agg(F.max("cluster").alias("last")).select("card_id", F.explode(F.expr("sequence(0L, last)")).alias("cluster"))
    return lookups.last_before(points, starts, "card_id", "cluster", "file_no", 64)


@query("pool_best_donor", """
    WITH a AS (SELECT doc_id, coalesce(lead(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id), min(doc_id) OVER (PARTITION BY source, lang)) AS c,
                      coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), min(doc_id) OVER (PARTITION BY source)) AS b,
                      coalesce(lead(doc_id) OVER (PARTITION BY lang ORDER BY doc_id), min(doc_id) OVER (PARTITION BY lang)) AS a,
                      coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS z FROM documents)
    SELECT doc_id, CASE WHEN c <> doc_id THEN c WHEN b <> doc_id THEN b WHEN a <> doc_id THEN a ELSE z END AS donor,
           CASE WHEN c <> doc_id THEN 3 WHEN b <> doc_id THEN 2 WHEN a <> doc_id THEN 1 ELSE 0 END AS score FROM a
""")
def pool_best_donor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The donor that fits each document best, with its source for tables and its language for a frame."""
    return lookups.best_donor(table(spark, sf_dir, "documents"), "doc_id", "source", "lang")


@query("card_fields", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_custkey <= 64 THEN 2 WHEN o_custkey <= 256 THEN 4 WHEN o_custkey <= 512 THEN 8 WHEN o_custkey <= 1024 THEN 16 ELSE 32 END
                   WHEN 1 THEN CASE WHEN o_custkey <= 4096 THEN 4 ELSE 32 END ELSE CASE WHEN o_custkey <= 32768 THEN 32 ELSE 128 END END AS cluster_kb,
           rtrim(substr(upper(replace(replace(o_orderpriority, '.', ''), '/', '')), 1, 11)) AS label,
           rpad(upper(split_part(o_orderpriority || '.jpg', '.', 1))[1:8], 8, ' ') || 'JPG' AS short_name,
           ((s // 86400 // 365 + 20) * 512 + least(s // 86400 % 365 // 31 + 1, 12) * 32 + least(s // 86400 % 365 % 31 + 1, 28)) * 65536 + (s % 86400 // 3600) * 2048 + (s // 60 % 60) * 32 + s % 60 // 2 AS packed,
           CASE WHEN (o_custkey % 1400 - 6) // 166 >= 0 AND o_custkey % 1400 >= 6 AND (o_custkey % 1400 - 6) // 166 < 8 AND (o_orderkey % 900 - 6) // 184 * 8 + (o_custkey % 1400 - 6) // 166 < 30 AND o_orderkey % 900 >= 6 THEN (o_orderkey % 900 - 6) // 184 * 8 + (o_custkey % 1400 - 6) // 166 ELSE -1 END AS cell
    FROM (SELECT *, o_orderkey * 86399 AS s FROM orders)
""")
def card_field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field rules of cards and sheets over the orders table."""
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    fs = F.element_at(F.array(*map(F.lit, ("fat16", "fat32", "exfat"))), (key % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", card_fields.default_cluster_kb(fs, other).alias("cluster_kb"), card_fields.volume_label(F.col("o_orderpriority")).alias("label"),
        card_fields.short_name(F.concat("o_orderpriority", F.lit(".jpg"))).alias("short_name"), card_fields.packed_time(key * 86399).alias("packed"), card_fields.sheet_cell(F.lit(30), other % 1400, key % 900).alias("cell"),
    )


# --- Photos: synthetic files, their structure, marker-level edits ---------------------------------------------------


@query("preset_stories")
def preset_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every story at half its worst on every payload, seeds counted up over the batch."""
    docs = payloads(spark, sf_dir)
    paired = donors.with_donor(docs.withColumnRenamed("doc_id", "ord")).withColumnRenamed("ord", "doc_id")
    out = []
    for name in presets.STORIES:
        # Only stories with a step that takes another payload carry one to Python.
        recipe = presets.story(name, 0.5, 7)
        done = apply_recipe(paired, recipe, seed="doc_id", other="other") if needs_other(recipe) else apply_recipe(docs, recipe, seed="doc_id")
        out.append(done.select("doc_id", F.lit(name).alias("story"), F.length("bytes").alias("n_out"), digest().alias("digest")))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


KINDS = {"avi": "52494646102700004156492020", "photo": "FFD8FFE000104A46494600", "project": "504B030414000000", "": "00"}


@query("payload_kinds", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'avi' WHEN 1 THEN 'photo' WHEN 2 THEN 'project' ELSE CASE doc_id % 5 WHEN 0 THEN 'recipe' WHEN 1 THEN 'photo' WHEN 2 THEN 'photo' ELSE 'unknown' END END AS kind FROM documents
""")
def payload_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under heads and names of several kinds: magic bytes count first, then the extension."""
    i = F.col("doc_id")
    head = F.element_at(F.array(*map(F.lit, KINDS.values())), (i % 4 + 1).cast("int"))
    name = F.element_at(F.array(*map(F.lit, ("a.json", "B.JPG", "c.webp", "d.txt", "e"))), (i % 5 + 1).cast("int"))
    made = payloads(spark, sf_dir).select("doc_id", F.concat(F.unhex(head), F.coalesce("bytes", F.unhex(F.lit("")))).alias("bytes"), name.alias("path"))
    return made.select("doc_id", payload_kind(F.col("path"), F.col("bytes")).alias("kind"))


# --- Coefficient blocks: the first 64 numbers of each embedding, in thousandths --------------------------------------


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 64), lambda v: F.round(v.cast("double") * 1000).cast("int")).alias("coef"))


SQL_BLOCKS = "b AS (SELECT vec_id, label, list_transform(embedding[1:64], lambda v: round(v::DOUBLE * 1000)::INTEGER) AS coef FROM embeddings)"


@query("block_energy", f"WITH {SQL_BLOCKS} SELECT vec_id, list_sum(list_transform(coef[2:], lambda v: v::BIGINT * v))::BIGINT AS energy, len(list_filter(coef, lambda v: v = 0))::INTEGER AS zeros, list_sort(coef)[len(coef) // 2 + 1] AS median FROM b")
def block_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coef")
    return blocks(spark, sf_dir).select("vec_id", coefficients.energy(c).alias("energy"), coefficients.zeros(c).alias("zeros"), coefficients.upper_median(c).alias("median"))


_ORDER = "[" + ", ".join(map(str, coefficients.zigzag())) + "]"


@query("block_kill", f"WITH {SQL_BLOCKS} SELECT vec_id, array_to_string(list_transform(range(1, len(coef) + 1), lambda i: CASE WHEN {_ORDER}[i] BETWEEN 10 AND 63 THEN 0 ELSE coef[i] END), ',') AS coef FROM b")
def block_kill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("vec_id", F.concat_ws(",", coefficients.kill(F.col("coef"), 10, 63).cast("array<string>")).alias("coef"))


@query("block_drop", f"WITH {SQL_BLOCKS} SELECT vec_id, array_to_string(list_transform(coef, lambda v: least(-v, 32767)), ',') AS negated, array_to_string(list_transform(range(1, len(coef) + 1), lambda i: CASE WHEN i = 1 THEN coef[i] ELSE 0 END), ',') AS flat FROM b")
def block_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("coef")
    return blocks(spark, sf_dir).select("vec_id", F.concat_ws(",", coefficients.drop(c, "negate").cast("array<string>")).alias("negated"), F.concat_ws(",", coefficients.drop(c, "flat").cast("array<string>")).alias("flat"))


@query("block_dc_running", f"WITH {SQL_BLOCKS} SELECT vec_id, sum(coef[1]) OVER (PARTITION BY label, vec_id // 16 ORDER BY vec_id)::BIGINT AS dc FROM b")
def block_dc_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = blocks(spark, sf_dir).select("vec_id", F.col("label").alias("photo"), F.floor(F.col("vec_id") / 16).alias("interval"), F.col("vec_id").alias("seq"), F.element_at("coef", 1).alias("diff"))
    return coefficients.dc_from_differences(rows).select("vec_id", "dc")
