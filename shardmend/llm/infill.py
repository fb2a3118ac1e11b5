"""Fill-in-middle with a distinct-text index.

Texts that are the same are one entry of an index, which holds the text and its code point boundaries as an Elias-Fano
list, made once. Every document joins its entry, draws two cuts and a form from its id, and selects the byte offsets of
its cuts from the list; the parts are then slices of bytes.

Entries are named by SHA-256 and length; a second hash must agree among all rows of an entry, and what is restored from
an output must have the hash that the document's own text had, or the job stops. A text is shuffled once for each task
that reads it, without its copies, and meets the list of its documents, ids and draws alone. Texts with very many rows
are held in several parts: their names are at most HOT_NAMES, as each has more than a share of all rows, and go to every
task; the list of any other text has that share at most.

A null text is like an empty one, whose form is plain. Very long texts are one entry each and are cut like others. Rows
without doc_id draw by their text; rows that repeat an id have the same draws. Equal cuts leave the middle empty. An
empty table gives no rows. Carried columns may have any names; ``_fim`` is made anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

from shardmend.llm.common import fields, give_back, id_key, materialise, tidied

SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Rows of a text from which on it is held in parts of so many; as a share of all rows, one in HOT_NAMES at least.
HOT_ROWS, HOT_NAMES = 512, 100_000
#: Bits between two samples of the boundaries' upper parts.
SAMPLE = 1024


def elias_fano(text: bytes) -> bytes:
    """Where each code point of a UTF-8 text begins, and where the last ends, as an Elias-Fano list.

    Count and low bits; the low bits of all values, a plane for each; how many values come before every SAMPLE bits of the
    upper parts; the upper parts, value i setting bit (value >> low) + i.
    """
    data = np.frombuffer(text, np.uint8)
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    n = len(places)
    low = max(int(places[-1] // n).bit_length() - 1, 0)
    upper = np.zeros(-(-int((places[-1] >> low) + n) // SAMPLE) * SAMPLE, np.uint8)
    upper[(places >> low) + np.arange(n)] = 1
    before = np.concatenate([[0], np.cumsum(upper.reshape(-1, SAMPLE).sum(axis=1, dtype=np.int64))[:-1]])
    planes = [np.packbits((places >> b & 1).astype(np.uint8), bitorder="little") for b in range(low)]
    parts = [np.array([n, low, len(before)], "<u4"), *planes, before.astype("<u4"), np.packbits(upper, bitorder="little")]
    return b"".join(p.tobytes() for p in parts)


def selected(index: bytes, i: int) -> int:
    """Value ``i`` of an Elias-Fano list."""
    n, low, samples = np.frombuffer(index, "<u4", 3).tolist()
    plane, at = -(-n // 8), 12
    value = sum((index[at + b * plane + i // 8] >> i % 8 & 1) << b for b in range(low))
    at += low * plane
    before = np.frombuffer(index, "<u4", samples, at)
    block = int(np.searchsorted(before, i, "right")) - 1
    bits = np.frombuffer(index, np.uint8, SAMPLE // 8, at + 4 * samples + block * SAMPLE // 8)
    place = np.flatnonzero(np.unpackbits(bits, bitorder="little"))[i - int(before[block])]
    return (block * SAMPLE + int(place) - i) << low | value


@F.arrow_udf(BinaryType())
def boundaries(texts: pa.Array) -> pa.Array:
    out = pa.array([elias_fano(x) for x in texts.to_pylist()], pa.binary())
    give_back()
    return out


@F.arrow_udf(ArrayType(IntegerType()))
def offsets(index: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    rows = zip(index.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True)
    return pa.array([[selected(x, a), selected(x, b)] for x, a, b in rows], pa.list_(pa.int32()))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A marker can't arise where two parts meet, so each is found once."""
    before = lambda x, mark: F.substring_index(x, mark, 1)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    psm = F.concat(after(before(output, SUFFIX), PREFIX), after(output, MIDDLE), after(before(output, MIDDLE), SUFFIX))
    spm = F.concat(after(before(output, MIDDLE), PREFIX), after(output, MIDDLE), after(before(output, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


@tidied
def infilled(docs: DataFrame, carry: list[str], seed: str = SEED) -> DataFrame:
    """``carry`` columns of ``docs`` with a column ``_fim`` of n, form, prefix_chars, middle_chars, output and restored.

    ``n`` counts code points; lengths of parts are null where the form is plain.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = [F.unhex(F.sha2(text, 256)).alias("name"), F.octet_length(text).alias("size")]
    h = F.sha2(F.concat(F.lit(f"{seed}:"), id_key(F.col("doc_id"), F.col("text"))), 256)
    draws = F.transform(F.sequence(F.lit(1), F.lit(25), F.lit(8)), lambda i: F.conv(F.substr(h, i, F.lit(8)), 16, 10).cast("long"))
    row = F.struct(*fields([c for c in carry if c != "_fim"]))
    rows = materialise(docs.select(row.alias("row"), draws.alias("h"), *name))
    total = rows.count()
    hot = rows.groupBy("name", "size").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_ROWS, total // HOT_NAMES))
    hot = F.broadcast(materialise(hot.select("name", "size", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("parts"))))
    named = docs.select(text.alias("text"), *name)
    key = ["name", "size"]

    def joined(texts: DataFrame, own: DataFrame, *more: str) -> DataFrame:
        """Texts, one row for each, with the list of their documents: what is made of a text from here on is made once."""
        agreed = F.min(F.xxhash64("text")) == F.max(F.xxhash64("text"))
        one = texts.groupBy(*key, *more).agg(F.first("text").alias("text"), F.assert_true(agreed, "texts of one name differ").alias("same")).where("same IS NULL").drop("same")
        if more:
            one = one.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        on = [*key, *(["part"] if more else [])]
        lists = own.groupBy(*on).agg(F.collect_list(F.struct("row", "h")).alias("rows"))
        return one.join(lists, on).select("name", "text", "rows")

    dealt = rows.join(hot, key).withColumn("part", F.pmod(F.xxhash64("h", "row"), F.col("parts")).cast("int"))
    cold = joined(named.join(hot, key, "left_anti"), rows.join(hot, key, "left_anti"))
    index = cold.unionByName(joined(named.join(hot, key), dealt, "parts")).withColumn("index", boundaries(F.col("text").cast("binary")))
    met = index.withColumn("own", F.explode("rows")).select("own.row", "own.h", "name", "text", "index")

    n = F.char_length("text")
    first, second = (F.pmod(F.col("h")[i], n + 1).cast("int") for i in (0, 1))
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (n == 0) | marked | (F.pmod(F.col("h")[2], F.lit(100)) >= PLAIN_FROM)
    form = F.when(plain, "plain").when(F.pmod(F.col("h")[3], F.lit(100)) < SPM_BELOW, "spm").otherwise("psm")
    cut = met.select("row", "name", "text", n.alias("n"), form.alias("form"), F.least(first, second).alias("a"), F.greatest(first, second).alias("b"), "index")
    cut = cut.withColumn("at", offsets("index", "a", "b")).drop("index")
    part = lambda a, b: F.substr(F.col("text").cast("binary"), a + 1, b - a).cast("string")
    prefix, middle, suffix = part(F.lit(0), F.col("at")[0]), part(F.col("at")[0], F.col("at")[1]), part(F.col("at")[1], F.octet_length("text"))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    made = cut.withColumn("output", F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text")))
    made = made.withColumn("restored", restored(F.col("output"), F.col("form")))
    chars = lambda x: F.when(F.col("form") != "plain", x).cast("long")
    right = F.when(F.unhex(F.sha2("restored", 256)) == F.col("name"), F.col("restored")).otherwise(F.raise_error(F.lit("restored text differs")))
    fim = F.struct(F.col("n").cast("long").alias("n"), "form", chars(F.col("a")).alias("prefix_chars"), chars(F.col("b") - F.col("a")).alias("middle_chars"), "output", right.alias("restored"))
    return made.select("row.*", fim.alias("_fim"))


def infill_digest(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of every document."""
    sha = lambda c: F.sha2(F.col(f"_fim.{c}"), 256).alias(f"{c}_sha256")
    return infilled(docs, ["doc_id"], seed).select("doc_id", "_fim.n", "_fim.form", "_fim.prefix_chars", "_fim.middle_chars", sha("output"), sha("restored"))


ORACLE_SQL = f"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}:' || doc_id) AS h FROM documents),
         d AS (SELECT doc_id, text, n, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS c2,
                      ('0x' || substr(h, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4 FROM t),
         f AS (SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b,
                      CASE WHEN n = 0 OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 >= {PLAIN_FROM} THEN 'plain'
                           WHEN h4 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM d),
         o AS (SELECT *, CASE form WHEN 'plain' THEN text
                  WHEN 'psm' THEN '{PREFIX}' || substr(text, 1, a) || '{SUFFIX}' || substr(text, b + 1) || '{MIDDLE}' || substr(text, a + 1, b - a)
                  ELSE '{SUFFIX}' || substr(text, b + 1) || '{PREFIX}' || substr(text, 1, a) || '{MIDDLE}' || substr(text, a + 1, b - a) END AS output FROM f)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
           sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
