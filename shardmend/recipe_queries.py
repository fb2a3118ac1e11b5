"""Queries over recipes: the status of every node, recipes held as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardmend.catalogue import SQL_PAYLOAD, digest, payloads, query, shared_run, table
from shardmend.photo_queries import HEAD, SQL_PHOTO, WHOLE, photos
from shardmend.plans.prefix_store import PrefixStore, run_stored
from shardmend.plans.recipe import Patch, Recipe, Repeat, Step
from shardmend.plans.statuses import node_rows, run_nodes
from shardmend.plans.step_catalogue import reencode_marks

STATUS_RECIPE = Recipe(
    [
        Step("strip_exif", {"mode": "all"}), Step("truncate", {"percent": 5}, enabled=False), Step("pixel_sort"), Patch("0-1", [(0, b"\0")]), Step("progressive_cut", {"scans": 1}, 3),
        Repeat([Step("byte_patch", {"at": 0, "hex": "ABCD"}), Step("mpf_ghost", {}, 4), Step("byte_patch", {"at": 1, "hex": "EF"})], 2, seed=5),
        Repeat([], 2), Step("truncate", {"byte": 10}),
    ]
)
_BARE = WHOLE.replace("exif || note || ", "")
_CUT = f"CASE WHEN passes THEN {HEAD.replace('exif || note || ', '')} || dht || sos || scan || 'FFD9' ELSE {_BARE} END"


@query("recipe_node_status", f"""
    WITH {SQL_PHOTO}, r AS (SELECT doc_id, passes, eoi = '' OR ghost <> '' AS unclear, len({_BARE}) // 2 AS a, len({_CUT}) // 2 AS b, CASE WHEN ghost <> '' AND NOT passes THEN 5 ELSE len({_CUT}) // 2 END AS c FROM ph), n AS (SELECT unnest(range(8)) AS node)
    SELECT doc_id AS photo_id, node::INTEGER AS node,
           CASE node WHEN 1 THEN 'disabled' WHEN 2 THEN 'unavailable' WHEN 3 THEN 'stale' WHEN 4 THEN CASE WHEN passes THEN 'ok' ELSE 'error' END WHEN 5 THEN 'error' ELSE 'ok' END AS status,
           CASE WHEN node = 2 THEN 'step "pixel_sort" is not available yet' WHEN node = 4 AND NOT passes OR node = 5 THEN CASE WHEN node = 4 OR NOT passes AND unclear THEN 'no such segment' ELSE 'no second picture' END END AS error,
           CASE WHEN node = 1 THEN NULL WHEN node < 4 THEN a WHEN node < 5 THEN b ELSE least(c, CASE node WHEN 7 THEN 10 ELSE c END) END AS size FROM r, n
""")
def recipe_node_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each node of a recipe on each photo: steps that run, fail, are off or unknown, a stale patch, repeats."""
    return node_rows(run_nodes(photos(spark, sf_dir), STATUS_RECIPE), "photo_id")


@query("recipe_status_output", f"WITH {SQL_PHOTO}, r AS (SELECT doc_id, CASE WHEN ghost <> '' AND NOT passes THEN ghost ELSE {_CUT} END AS h FROM ph) SELECT doc_id AS photo_id, md5('ABCD' || substr(h, 5)) AS digest FROM r")
def recipe_status_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The photos after a recipe that partly fails: a repeat that fails keeps what its turns had made by then."""
    return run_nodes(photos(spark, sf_dir), Recipe(STATUS_RECIPE.nodes[:-1])).select("photo_id", digest().alias("digest"))


# Node k of a document's recipe is one of these, picked by its id; # stands for k.
NODES = [
    '{"uid":"n#","type":"step","id":"truncate","enabled":true}', '{"uid":"n#","type":"step","id":"requantize"}', '{"uid":"n#","type":"step","id":"strip_exif","enabled":true}',
    '{"uid":"n#","type":"step","id":"coeff_kill","enabled":false}', '{"uid":"n#","type":"patch","enabled":true}', '{"uid":"n#","type":"step","id":"not_known"}',
    '{"uid":"n#","type":"repeat","times":9,"children":[{"uid":"a#","id":"dc_offset"},{"uid":"b#","id":"dropped_sectors"},{"uid":"c#","id":"resave","enabled":false}]}',
    '{"uid":"n#","type":"repeat","times":1,"children":[{"uid":"a#","id":"dc_offset"},{"uid":"b#","id":"dropped_sectors"}]}',
]
WIDTH = 7


def recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recipe_id, json): a recipe of seven nodes for each document."""
    pick = lambda k: F.element_at(F.array(*map(F.lit, NODES)), (F.pmod(F.floor(F.col("doc_id") / (8 ** (k % 3))) + k * k, F.lit(8)) + 1).cast("int"))
    nodes = F.concat_ws(",", *[F.replace(pick(k), F.lit("#"), F.lit(str(k))) for k in range(WIDTH)])
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("recipe_id"), F.concat(F.lit('{"format":"some-recipe","steps":['), nodes, F.lit("]}")).alias("json"))


@query("recipe_reencode_marks", f"""
    WITH n AS (SELECT doc_id, unnest(range({WIDTH})) AS k FROM documents), p AS (SELECT doc_id, k, (doc_id // (CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 8 ELSE 64 END) + k * k) % 8 AS t FROM n),
         e AS (SELECT doc_id, k, 0 AS i, 'n' || k AS uid, CASE t WHEN 0 THEN 'byte' WHEN 1 THEN 'pixel' WHEN 2 THEN 'meta' WHEN 4 THEN 'byte' END AS layer FROM p WHERE t IN (0, 1, 2, 4)
               UNION ALL SELECT doc_id, k, i, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END || k, CASE WHEN i % 2 = 0 THEN 'coeff' ELSE 'card' END FROM (SELECT *, unnest(CASE t WHEN 6 THEN range(4) ELSE range(2) END) AS i FROM p WHERE t >= 6)),
         w AS (SELECT *, last_value(nullif(layer, 'meta') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)
    SELECT DISTINCT doc_id AS recipe_id, uid FROM w WHERE layer IN ('pixel', 'coeff') AND before IN ('byte', 'card')
""")
def recipe_reencode_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where recipes decode a picture that an earlier step has changed as bytes."""
    return reencode_marks(recipes(spark, sf_dir))


STORED_RECIPE = Recipe([Step("truncate", {"percent": 60}, 5), Step("byte_patch", {"at": 2, "hex": "C0FFEE"}, enabled=False), Step("byte_swap16"), Step("truncate", {"percent": 90})])


@query("recipe_stored_prefix", f"""
    WITH {SQL_PAYLOAD}, a AS (SELECT doc_id, floor(n * 60.0::DOUBLE / 100)::BIGINT AS n, substr(hx, 1, 2 * floor(n * 60.0::DOUBLE / 100)::BIGINT) AS hx FROM p),
         b AS (SELECT doc_id, n, substr(hx, 1, 2 * floor(n * 50.0::DOUBLE / 100)::BIGINT) || regexp_replace(substr(hx, 2 * floor(n * 50.0::DOUBLE / 100)::BIGINT + 1), '(..)(..)', '\\2\\1', 'g') AS hx FROM a)
    SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 3 WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS start, CASE WHEN doc_id % 6 = 0 THEN 'cached,disabled,cached,ok' WHEN doc_id % 2 = 0 THEN 'cached,disabled,ok,ok' ELSE 'ok,disabled,ok,ok' END AS statuses,
           md5(substr(hx, 1, 2 * floor(n * 90.0::DOUBLE / 100)::BIGINT)) AS digest FROM b
""")
def recipe_stored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe on every payload, each from its longest stored prefix: half of them went through its first node before, a third of those through three.

    A node that is off keeps the key before it, so what is stored after the first node also counts after the second.
    """
    store = PrefixStore(spark, f"{shared_run(spark)}/prefixes")
    docs = payloads(spark, sf_dir).where("bytes IS NOT NULL")
    source = F.concat_ws(":", F.sha2("bytes", 256), F.col("doc_id").cast("string"))
    run_stored(docs.where("doc_id % 2 = 0"), Recipe(STORED_RECIPE.nodes[:2]), store, "doc_id", source, keep=[1])
    run_stored(docs.where("doc_id % 6 = 0"), Recipe(STORED_RECIPE.nodes[:3]), store, "doc_id", source, keep=[2])
    done = run_stored(docs, STORED_RECIPE, store, "doc_id", source, keep=[3])
    return done.select("doc_id", "start", F.array_join(F.transform("nodes", lambda n: n["status"]), ",").alias("statuses"), digest().alias("digest"))
