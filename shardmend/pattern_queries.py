"""Queries of relational patterns over cards and rows, and reads of what is left on cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardmend import sql_draws
from shardmend.catalogue import CLUSTER, SQL_CARD, SQL_PAYLOAD, card_tables, digest, payloads, query, set_checkpoints, table
from shardmend.operators import cards, coefficients, patterns
from shardmend.plans.recipe import Recipe, Step, apply_recipe, generation


def stored_clusters(spark: SparkSession, sf_dir: str, live: DataFrame) -> DataFrame:
    """(card_id, cluster, bytes) of live files, which are cut before they meet their clusters."""
    docs = payloads(spark, sf_dir).where("length(bytes) > 0").select(F.floor(F.col("doc_id") / 64).alias("card_id"), (F.col("doc_id") % 64).alias("file_no"), F.posexplode(cards.cut_up(F.col("bytes"), CLUSTER)).alias("pos", "bytes"))
    return live.join(docs, ["card_id", "file_no", "pos"]).select("card_id", "cluster", "bytes")


@query("card_read_fat", "SELECT doc_id // 64 AS card_id, doc_id % 64 AS file_no, octet_length(encode(text)) AS size, md5(upper(hex(encode(text)))) AS digest FROM documents WHERE octet_length(encode(text)) > 0 AND (doc_id % 64 >= 48 OR doc_id IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id // 64 ORDER BY doc_id) AS r FROM documents WHERE doc_id % 64 < 48) WHERE r % 2 = 0))")
def card_read_fat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live files read back along the allocation table, from their first clusters alone."""
    set_checkpoints(spark)
    t = card_tables(spark, sf_dir)
    heads = t["live"].where("pos = 0").select("card_id", F.col("cluster").alias("head"), "file_no")
    chains = cards.follow_chains(cards.fat(t["live"]), heads.select("card_id", "head")).join(heads, ["card_id", "head"])
    whole = cards.read_chains(chains.select("card_id", "file_no", "pos", "cluster"), stored_clusters(spark, sf_dir, t["live"]), t["files"], ["card_id", "file_no"], CLUSTER)
    return whole.select("card_id", "file_no", F.length("bytes").cast("long").alias("size"), digest().alias("digest"))


PER_PART = 64


@query("card_image", f"""
    WITH {SQL_CARD}, e AS (SELECT card_id, max(cluster) AS last FROM live GROUP BY card_id), a AS (SELECT card_id, unnest(range(2, last + 1)) AS cluster FROM e),
         h AS (SELECT doc_id // 64 AS card_id, doc_id % 64 AS file_no, upper(hex(encode(text))) AS hx FROM documents),
         c AS (SELECT live.card_id, cluster, substr(hx, (pos * {2 * CLUSTER} + 1)::BIGINT, {2 * CLUSTER}) AS data FROM live JOIN h ON h.card_id = live.card_id AND h.file_no = live.file_no)
    SELECT a.card_id, (a.cluster - 2) // {PER_PART} AS part, md5(string_agg(rpad(coalesce(data, ''), {2 * CLUSTER}, '0'), '' ORDER BY a.cluster)) AS digest FROM a LEFT JOIN c ON c.card_id = a.card_id AND c.cluster = a.cluster GROUP BY 1, 2
""")
def card_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw image of each card, in parts: clusters of live files where they lie, zeros elsewhere."""
    live = card_tables(spark, sf_dir)["live"]
    ends = live.groupBy("card_id").agg(F.max("cluster").alias("last"))
    return cards.image_parts(stored_clusters(spark, sf_dir, live), ends, CLUSTER, PER_PART).select("card_id", "part", digest().alias("digest"))


@query("card_undelete_skipping", f"""
    WITH {SQL_CARD}, l AS (SELECT card_id, max(cluster) AS last FROM (SELECT card_id, cluster FROM old UNION ALL SELECT card_id, cluster FROM live) GROUP BY card_id),
         a AS (SELECT card_id, unnest(range(2, last + 1)) AS cluster FROM l),
         f AS (SELECT card_id, cluster, row_number() OVER (PARTITION BY card_id ORDER BY cluster) AS k FROM a WHERE NOT EXISTS (SELECT 1 FROM live v WHERE v.card_id = a.card_id AND v.cluster = a.cluster)),
         h AS (SELECT card_id, file_no, n, (SELECT count(*) FROM f WHERE f.card_id = fresh.card_id AND f.cluster < fresh.first) AS before FROM fresh WHERE gone AND n > 0),
         w AS (SELECT card_id, file_no, before, unnest(range(n)) AS pos FROM h)
    SELECT w.card_id, w.file_no, w.pos::INTEGER AS pos, f.cluster FROM w JOIN f ON f.card_id = w.card_id AND f.k = w.before + w.pos + 1
""")
def card_undelete_skipping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted files from their start on, past clusters that others use by now."""
    t = card_tables(spark, sf_dir)
    first = t["old"].where("pos = 0").select("card_id", "file_no", F.col("cluster").alias("first"))
    last = t["old"].select("card_id", "cluster").unionByName(t["live"].select("card_id", "cluster")).groupBy("card_id").agg(F.max("cluster").alias("last"))
    return cards.undelete_skipping(t["gone"].join(first, ["card_id", "file_no"]), t["live"], last, CLUSTER)


@query("card_best_overlap", f"""
    WITH {SQL_CARD}, s AS (SELECT card_id, file_no, count(*) AS size FROM old WHERE gone GROUP BY 1, 2),
         h AS (SELECT o.card_id, o.file_no, n.file_no AS other, count(*) AS hits FROM old o JOIN new n ON n.card_id = o.card_id AND n.cluster = o.cluster WHERE o.gone GROUP BY 1, 2, 3),
         r AS (SELECT h.*, row_number() OVER (PARTITION BY h.card_id, h.file_no ORDER BY hits DESC, other) AS r FROM h JOIN s ON s.card_id = h.card_id AND s.file_no = h.file_no WHERE hits * 4 >= size)
    SELECT card_id, file_no, other, hits FROM r WHERE r = 1
""")
def card_best_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each deleted file the new one that took most of its clusters, a quarter of them at least."""
    t = card_tables(spark, sf_dir)
    return cards.best_overlap(t["freed"].select("card_id", "file_no", "cluster"), t["new"].select("card_id", "file_no", "cluster"))


@query("card_byte_owner", f"WITH {SQL_CARD}, b AS (SELECT doc_id // 64 AS card_id, doc_id, 1024 + doc_id % 64 * 700 AS at FROM documents) SELECT b.doc_id, b.card_id, b.at, o.file_no FROM b JOIN old o ON o.card_id = b.card_id AND o.cluster = b.at // {CLUSTER}")
def card_byte_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which file of a fresh card holds a byte: an equi-join on its place divided by the cluster size."""
    at = (F.col("doc_id") % 64 * 700 + 1024).alias("at")
    points = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("card_id"), at).withColumn("cluster", F.floor(F.col("at") / CLUSTER))
    return points.join(card_tables(spark, sf_dir)["old"], ["card_id", "cluster"]).select("doc_id", "card_id", "at", "file_no")


@query("card_largest_files", f"WITH {SQL_CARD}, r AS (SELECT card_id, file_no, size, row_number() OVER (PARTITION BY card_id ORDER BY size DESC, file_no) AS place FROM files) SELECT card_id, file_no, size, place::INTEGER AS place FROM r WHERE place <= 3")
def card_largest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.top_of(card_tables(spark, sf_dir)["files"], ["card_id"], [F.col("size").desc(), F.col("file_no")], 3)


@query("byte_histogram", "WITH b AS (SELECT upper(hex(encode(text))) AS hx FROM documents), s AS (SELECT unnest(regexp_extract_all(hx, '..')) AS x FROM b) SELECT ('0x' || x)::INTEGER AS symbol, count(*) AS n FROM s GROUP BY x")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each byte occurs over all payloads."""
    return patterns.symbol_counts(payloads(spark, sf_dir))


@query("blurred_quantities", "SELECT l_orderkey, l_linenumber, floor(sum(l_quantity::BIGINT) OVER w / count(*) OVER w)::BIGINT AS blurred FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def blurred_quantities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole means over a centred frame of each order's lines, which ends cut short."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.rint("l_quantity").cast("long").alias("quantity"))
    return patterns.box_blur(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "quantity"], "quantity", 1).select("l_orderkey", "l_linenumber", "blurred")


@query("seeded_sample", f"""
    WITH RECURSIVE p AS (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n FROM documents), {sql_draws.draws("g", "p", "greatest(n - 1, 1)")},
         o AS (SELECT p.doc_id, n, list_reduce(list_prepend(range(n), list_transform(range(n - 1, 0, -1), lambda i: [i, v[n - i] % (i + 1)])),
                      lambda o, e: list_transform(range(1, len(o) + 1), lambda k: CASE k WHEN e[1] + 1 THEN o[e[2] + 1] WHEN e[2] + 1 THEN o[e[1] + 1] ELSE o[k] END)) AS o FROM p JOIN g ON g.doc_id = p.doc_id)
    SELECT doc_id, n::INTEGER AS size, unnest(range(least(n, 3)))::INTEGER AS draw, unnest(o[1:3])::INTEGER AS line FROM o
""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines of each document without repeats, by a shuffle seeded with its id."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seed"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("size"))
    return patterns.seeded_sample(rows, "seed", "size", 3).select("doc_id", "size", F.posexplode("picked").alias("draw", "line"))


@query("nation_orders_map", "SELECT r_name AS region, string_agg(n_name || '=' || c, ',' ORDER BY n_name) AS orders FROM (SELECT r_name, n_name, count(*) AS c FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) GROUP BY 1")
def nation_orders_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of orders by nation, as one map for each region."""
    t = lambda name: table(spark, sf_dir, name)
    named = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    rows = t("orders").select("o_custkey").join(named, F.col("o_custkey") == F.col("c_custkey"))
    maps = patterns.as_map(rows, ["region"], "nation", F.count(F.lit(1)))
    return maps.select("region", F.array_join(F.transform(F.map_entries("entries"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("orders"))


# --- Coefficients in long form: every number of each embedding is the level of a block, in rows of eight -------------

LEVELS = "l AS (SELECT vec_id, k // 8 AS row_no, k % 8 AS bx, round(embedding[k + 1]::DOUBLE * 100)::INTEGER + CASE WHEN k // 8 >= 3 THEN 40 ELSE 0 END AS dc FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS k FROM embeddings))"


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, by, bx, dc): from the fourth row of blocks on, all is 40 brighter."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v"))
    by = F.floor(F.col("k") / 8)
    return rows.select("vec_id", by.alias("by"), (F.col("k") % 8).cast("long").alias("bx"), (F.round(F.col("v").cast("double") * 100).cast("int") + F.when(by >= 3, 40).otherwise(0)).alias("dc"))


@query("block_repaired", f"""
    WITH RECURSIVE {LEVELS}, d AS (SELECT a.vec_id, a.row_no, list_sort(list((a.dc - b.dc)::BIGINT)) AS s FROM l a JOIN l b ON b.vec_id = a.vec_id AND b.row_no = a.row_no - 1 AND b.bx = a.bx GROUP BY 1, 2),
         m AS (SELECT vec_id, row_no, s[len(s) // 2 + 1] AS m FROM d),
         c(vec_id, row_no, off) AS (SELECT vec_id, 0::BIGINT, 0::BIGINT FROM embeddings UNION ALL SELECT c.vec_id, c.row_no + 1, CASE WHEN abs(m.m + c.off) < 6 THEN 0 ELSE m.m + c.off END FROM c JOIN m ON m.vec_id = c.vec_id AND m.row_no = c.row_no + 1)
    SELECT l.vec_id, l.row_no, l.bx, CASE WHEN off = 0 THEN dc ELSE least(greatest(dc - off, -2047), 2047) END::INTEGER AS dc FROM l JOIN c ON c.vec_id = l.vec_id AND c.row_no = l.row_no
""")
def block_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels brought to those of the row above, from the top down."""
    return coefficients.repaired(levels(spark, sf_dir).withColumnRenamed("vec_id", "photo")).withColumnRenamed("photo", "vec_id").withColumnRenamed("by", "row_no")


@query("block_dc_offset", f"""
    WITH {LEVELS}, n AS (SELECT *, row_no * 8 + bx AS mcu, max(row_no * 8 + bx) OVER (PARTITION BY vec_id) + 1 AS total FROM l), s AS (SELECT *, least(total // 2, total - 1) AS start FROM n)
    SELECT vec_id, mcu, CASE WHEN mcu >= start AND mcu < (start // 12 + 1) * 12 THEN dc + 40 ELSE dc END::INTEGER AS dc FROM s
""")
def block_dc_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tint of 60 levels from the middle of each photo to the next restart, under a first quantiser of 12."""
    rows = levels(spark, sf_dir).select(F.col("vec_id").alias("photo"), F.lit(2).alias("comp"), (F.col("by") * 8 + F.col("bx")).alias("mcu"), F.lit(12).alias("q0"), "dc")
    return coefficients.dc_offset(rows, interval=12).select(F.col("photo").alias("vec_id"), "mcu", "dc")


@query("block_painted", "WITH b AS (SELECT vec_id, label, list_transform(embedding, lambda v: round(v::DOUBLE * 1000)::INTEGER) AS coef FROM embeddings) SELECT vec_id, array_to_string(list_transform(coef, lambda v: trunc(v * (1.0::DOUBLE - (label % 5) / 4.0::DOUBLE))::INTEGER), ',') AS coef FROM b")
def block_painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All numbers of each embedding under a brush whose weight depends on its label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: F.round(v.cast("double") * 1000).cast("int")).alias("coef"))
    return rows.select("vec_id", F.concat_ws(",", coefficients.painted(F.col("coef"), F.col("label") % 5 / F.lit(4.0)).cast("array<string>")).alias("coef"))


# --- Animations ----------------------------------------------------------------------------------------------------


@query("recipe_generations", f"WITH {SQL_PAYLOAD}, g AS (SELECT doc_id, hx, n, floor(n * 90.0::DOUBLE / 100)::BIGINT AS a FROM p), h AS (SELECT *, floor(a * 90.0::DOUBLE / 100)::BIGINT AS b FROM g) SELECT doc_id, unnest([0, 1, 2]) AS generation, md5(unnest([hx, substr(hx, 1, 2 * a), substr(hx, 1, 2 * b)])) AS digest FROM h")
def recipe_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe over its own results: each payload as it is, once and twice saved."""
    docs = payloads(spark, sf_dir)
    recipe, out = Recipe([Step("truncate", {"percent": 90}, 1)]), docs.select("doc_id", F.lit(0).alias("generation"), digest().alias("digest"))
    for k in (1, 2):
        docs = apply_recipe(docs, generation(recipe, k))
        out = out.unionByName(docs.select("doc_id", F.lit(k).alias("generation"), digest().alias("digest")))
    return out


_ONCE = [sql_draws.flipped(f"x{k}", "p" if k == 1 else f"x{k - 1}", 50.0, f"doc_id + 1 + {k}") for k in (1, 2, 3)]


@query("recipe_seeded_generations", f"WITH RECURSIVE {sql_draws.PAYLOAD}, {', '.join(_ONCE)} " + " UNION ALL ".join(f"SELECT doc_id, {k} AS generation, md5(hx) AS digest FROM x{k}" for k in (1, 2, 3)))
def recipe_seeded_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three generations of flipped bits, each with seeds of its own."""
    docs, out = payloads(spark, sf_dir), []
    for k in (1, 2, 3):
        docs = apply_recipe(docs, generation(Recipe([Step("bitflip", {"rate": 50.0}, 1)]), k), seed="doc_id")
        out.append(docs.select("doc_id", F.lit(k).alias("generation"), digest().alias("digest")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("payload_difference", f"WITH {SQL_PAYLOAD}, b AS (SELECT doc_id, n, least(256, n - n // 2) AS m, list_transform(range(n // 2, n // 2 + least(256, n - n // 2)), lambda k: ('0x' || substr(hx, (2 * k + 1)::BIGINT, 2))::BIGINT) AS v FROM p) SELECT doc_id, n, coalesce(list_sum(v), 0)::BIGINT AS total, CASE WHEN n > 0 THEN round(coalesce(list_sum(v), 0) / n, 9) END AS mean, len(list_filter(v, lambda x: x <> 0)) AS changed FROM b WHERE n IS NOT NULL")
def payload_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far zero fill moves each payload: the sum and mean of absolute differences, and the bytes that changed."""
    docs = payloads(spark, sf_dir).where("bytes IS NOT NULL")
    from shardmend.operators.byte_steps import zero_fill

    both = docs.select("doc_id", "bytes", zero_fill(F.col("bytes"), 50, 256).alias("after"))
    return patterns.differences(both, "bytes", "after").select("doc_id", "n", "total", F.when(F.col("n") > 0, F.round(F.col("total") / F.col("n"), 9)).alias("mean"), "changed")
