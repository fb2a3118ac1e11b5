"""Chat formatting with cumulative snapshots collapsed.

Conversations that are logged again and again as they grow appear as prefixes of longer ones. Every turn gets a hash of
its place, role and text; running sums of them identify each prefix of a conversation. A conversation whose whole is a
proper prefix of another is dropped by an anti join, and of equal conversations the one with the lowest id stays. What
is left is rendered. Built of DataFrame functions alone.

Turns are in order of ``turn`` (null first), then role and text, whatever their numbers are, so that repeated turns
count one by one. Null roles and texts render as empty and are told apart from empty ones. A turn without a conversation
id is a conversation of its own, of one turn and no id; equal ones collapse like others. A long conversation is numbered
and summed in blocks of turn numbers; only its rendered text is one row. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardmend.llm.common import materialise, tidied

#: Turns of a conversation are numbered and summed in blocks of so many turn numbers, which are then put together.
BLOCK = 256


def turn_hash(seed: int):
    """A hash of a turn's place, role and text. Null is told from empty by a mark; sums of hashes are kept exact in decimals."""
    parts = [F.col("k"), *[x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]]
    return F.xxhash64(F.lit(seed), *parts).cast("decimal(38,0)")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, k, a, b, role, text): each turn's number from 1 and two hashes of the turns up to it."""
    key = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    base = turns.select("conv_id", "turn", "role", "text", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long").alias("_block"))
    inner = W.partitionBy("conv_id", "_block").orderBy(*key)
    numbered = base.withColumn("_i", F.row_number().over(inner).cast("long"))
    sizes = base.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("conv_id", "_block", (F.sum("_n").over(W.partitionBy("conv_id").orderBy("_block")) - F.col("_n")).alias("_before"))
    same = lambda x, y: x["conv_id"].eqNullSafe(y["conv_id"]) & (x["_block"] == y["_block"])
    placed = numbered.join(before, same(numbered, before)).select(numbered["conv_id"], numbered["_block"], "turn", "role", "text", (F.col("_i") + F.col("_before")).alias("k"))
    hashed = placed.withColumn("_a", turn_hash(1)).withColumn("_b", turn_hash(2))
    run = W.partitionBy("conv_id", "_block").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "_block").agg(F.sum("_a").alias("_sa"), F.sum("_b").alias("_sb"))
    order = W.partitionBy("conv_id").orderBy("_block")
    carried = sums.select("conv_id", "_block", (F.sum("_sa").over(order) - F.col("_sa")).alias("_ca"), (F.sum("_sb").over(order) - F.col("_sb")).alias("_cb"))
    running = hashed.withColumn("_ra", F.sum("_a").over(run)).withColumn("_rb", F.sum("_b").over(run))
    return running.join(carried, same(running, carried)).select(running["conv_id"], "k", (F.col("_ra") + F.col("_ca")).alias("a"), (F.col("_rb") + F.col("_cb")).alias("b"), "role", "text")


def maximal_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(k, a, b, conv_id, n_copies) of the conversations that stay, all prefixes, and turns without a conversation id by hash."""
    every = materialise(prefixes(turns.where("conv_id IS NOT NULL")))
    alone = turns.where("conv_id IS NULL").select(F.lit(1).cast("long").alias("k"), "role", "text").withColumn("a", turn_hash(1)).withColumn("b", turn_hash(2))
    single = materialise(alone.groupBy("k", "a", "b").agg(F.min("role").alias("role"), F.min("text").alias("text"), F.count(F.lit(1)).alias("n")))
    whole = every.groupBy("conv_id").agg(F.max(F.struct("k", "a", "b")).alias("last")).select("conv_id", "last.k", "last.a", "last.b", F.lit(1).cast("long").alias("n"))
    one = single.select(F.lit(None).cast(dict(turns.dtypes)["conv_id"]).alias("conv_id"), "k", "a", "b", "n")
    distinct = whole.unionByName(one).groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_copies"))
    ends = whole.select("conv_id", F.col("k").alias("n"))
    proper = every.select("conv_id", "k", "a", "b").join(ends, "conv_id").where("k < n").select("k", "a", "b").distinct()
    return distinct.join(proper, ["k", "a", "b"], "left_anti"), every, single


@tidied
def rendered(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): conversations that stay, as one text each."""
    kept, every, single = maximal_conversations(turns)
    kept = materialise(kept)
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>"))
    rows = every.select("conv_id", "k", line.alias("line")).join(kept.select("conv_id", F.col("k").alias("n_turns"), "n_copies"), "conv_id")
    whole = rows.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("k", "line"))).alias("lines"))
    whole = whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))
    lone = kept.where("conv_id IS NULL").join(single.select("k", "a", "b", line.alias("line")), ["k", "a", "b"])
    return whole.unionByName(lone.select("conv_id", F.col("k").alias("n_turns"), "n_copies", F.col("line").alias("text")))


ORACLE_SQL = """
    WITH p AS (SELECT conv_id, row_number() OVER w AS k, string_agg(coalesce(role, '~') || chr(1) || coalesce(text, '~'), chr(2)) OVER w AS prefix,
                      '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' AS line
               FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
         n AS (SELECT conv_id, max(k) AS n FROM p GROUP BY conv_id),
         whole AS (SELECT p.prefix, min(p.conv_id) AS conv_id, p.k AS n_turns, count(*) AS n_copies FROM p JOIN n ON n.conv_id = p.conv_id AND n.n = p.k GROUP BY p.prefix, p.k),
         proper AS (SELECT DISTINCT prefix FROM p JOIN n ON n.conv_id = p.conv_id AND p.k < n.n),
         kept AS (SELECT * FROM whole WHERE prefix NOT IN (SELECT prefix FROM proper))
    SELECT kept.conv_id, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies, string_agg(line, chr(10) ORDER BY k) AS text
    FROM kept JOIN p ON p.conv_id = kept.conv_id GROUP BY kept.conv_id
"""
