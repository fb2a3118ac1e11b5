"""Mixing sources to target weights.

Tokens are summed per source, each source gets a target share, and the target over the sum is its repetition rate. Each
document is taken floor(rate) times, and once more when a number drawn from a hash of its id falls under the fraction.

Null sources form one source, which sorts last. Null and empty texts have size 0: they are taken like the others and add
no words. Very long texts are counted in place. A source without words has rate 0. Rows that repeat a doc_id share one
draw, rows without one draw by their text. An empty table gives no rows. Columns are carried along under any names, but
for ``_mix``, which the plan makes anew and the mix itself passes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import fields, fresh_name, id_key, materialise, n_words, quoted, ranked, tidied, unit_hash

#: Weights of the sources in order of code points, repeating.
WEIGHTS = (3, 1, 2)
#: All targets together, as a share of all sizes; the most that one source may reach, as a multiple of its own.
BUDGET, CAP = 1.5, 2.0
SEED = "mix-1"


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Targets share ``budget`` times all sizes by weight. A source stops at ``cap`` times its size and what is over goes
    to the others by weight, until none is above: the level of one unit of weight is solved over sums alone.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    spread = materialise(totals.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    place = ranked(spread, [], order, F.col("part"), "place").drop("part")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialise(place.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, full = None, -1
    while True:
        over = F.lit(False) if level is None else F.col("most") < F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(over, F.col("most"))), F.sum(F.when(~over, F.col("weight"))), F.count(F.when(over, 1))).first()
        if row[2] == full or not row[1]:
            break
        level, full = (total * budget - (row[0] or 0.0)) / row[1], row[2]
    share = F.lit(0.0) if level is None else F.col("weight") * F.lit(level)
    return sources.select("source", "source_size", F.least("most", share).alias("target"))


@tidied
def mixture(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """``docs`` with a column ``_mix`` (one of that name is replaced) of size, source_size, target, copies and taken."""
    sized = docs.select("source", n_words(F.col("text")).alias("size"))
    targets = source_targets(sized, weights, budget, cap)
    docs = docs.drop("_mix")
    joined = docs.join(targets, docs["source"].eqNullSafe(targets["source"]))
    whole, target = targets["source_size"], targets["target"]
    rate = F.when(whole > 0, target / whole).otherwise(0.0)
    extra = unit_hash(F.lit(seed), id_key(docs["doc_id"], docs["text"])) < rate - F.floor(rate)
    copies = (F.floor(rate) + extra.cast("int")).cast("long")
    size = n_words(docs["text"])
    made = F.struct(size.alias("size"), whole.alias("source_size"), target.alias("target"), copies.alias("copies"), (size * copies).alias("taken"))
    return joined.select(*[docs[quoted(c)] for c in docs.columns], made.alias("_mix"))


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    kept = fresh_name(docs, "mix_own")
    own = docs.withColumnRenamed("_mix", kept)
    copy = fresh_name(own, "mix_copy")
    plan = mixture(own, seed).where("_mix.copies > 0")
    copies = F.explode(F.sequence(F.lit(1), F.col("_mix.copies").cast("int"))).alias(copy)
    return plan.select(*fields(own.columns), copies).drop(copy).withColumnRenamed(kept, "_mix")


ORACLE_SQL = r"""
    WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
         totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
         weighed AS (SELECT source, source_size, source_size * 2.0::DOUBLE AS most,
                            CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM totals),
         filled AS (SELECT most, weight, coalesce(sum(most) OVER w, 0) AS full_before, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight,
                           (SELECT sum(source_size) FROM totals) * 1.5::DOUBLE AS budget
                    FROM weighed WINDOW w AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         level AS (SELECT arg_min((budget - full_before) / open_weight, most / weight) FILTER ((budget - full_before) / open_weight <= most / weight) AS unit FROM filled),
         targets AS (SELECT source, source_size, least(most, weight * unit) AS target FROM weighed, level),
         rated AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
                          ('0x' || substr(md5('mix-1:' || d.doc_id), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
                   FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""
