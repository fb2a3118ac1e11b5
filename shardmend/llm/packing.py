"""Packing by optimal length buckets.

The histogram of lengths over all documents goes through dynamic programming, which picks the bucket boundaries with
the least padding. Inside each bucket, documents in hash order fill batches of a token budget; a batch holds as many
rows as fit at the bucket's boundary, and one where a single row is longer than the budget.

Every distinct length may be a boundary, so the plan is one of least padding. The histogram that reaches the driver has
a row for each distinct length, of which there are no more than the longest text has words.

Null and empty texts have no tokens and go to the first bucket. Very long texts are counted in place; one longer than
the budget is a batch of its own. Rows without doc_id draw by their text; of equal draws the order is by doc_id, and that
of rows that repeat it is free. An empty table gives no rows. Carried columns may have any names; ``_pack`` is made anew.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import fields, id_key, materialise, n_words, ranked, tidied, unit_hash

BUCKETS, BUDGET = 12, 16384
#: Rows of a bucket that are ranked in one task, about.
SHARD_ROWS = 10_000
SEED = "pack-1"


def optimal_boundaries(lengths: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int) -> np.ndarray:
    """Up to ``buckets`` boundaries out of ascending ``lengths`` that minimise padding; of equal plans, the lower boundaries.

    The cost of a bucket is its boundary times its rows less its tokens. Best split points move one way only, so each
    layer is solved by halves.
    """
    m = len(lengths)
    rows, words = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(tokens)])
    best = lengths * rows[1:] - words[1:]
    splits = []
    for _ in range(1, min(buckets, m)):
        new, cut = np.full(m, np.iinfo(np.int64).max), np.zeros(m, np.int64)
        todo = [(len(splits) + 1, m - 1, len(splits), m - 2)]
        while todo:
            a, b, low, high = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(low, min(high, j - 1) + 1)
            cost = best[i] + lengths[j] * (rows[j + 1] - rows[i + 1]) - (words[j + 1] - words[i + 1])
            k = int(np.argmin(cost))
            new[j], cut[j] = cost[k], i[k]
            todo += [(a, j - 1, low, int(i[k])), (j + 1, b, int(i[k]), high)]
        splits.append(cut)
        best = new
    at, out = m - 1, [m - 1]
    for cut in reversed(splits):
        at = int(cut[at])
        out.append(at)
    return lengths[out[::-1]]


@tidied
def packed(docs: DataFrame, carry: list[str], tokens: Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET, seed: str = SEED) -> DataFrame:
    """``carry`` columns of ``docs`` with a column ``_pack`` of n_tokens, bucket, bucket_len, batch, slot and padding.

    ``tokens``: a column with each row's length; the number of words by default. A carried ``_pack`` is replaced.
    Lengths and draws are written once; what counts them reads that table, and so does the result unless it carries texts.
    """
    carry = [c for c in carry if c != "_pack"]
    length = n_words(F.col("text")) if tokens is None else tokens.cast("long")
    own = F.struct(length.alias("length"), F.col("doc_id").alias("id"), unit_hash(F.lit(seed), id_key(F.col("doc_id"), F.col("text"))).alias("u")).alias("own")
    slim = [c for c in carry if c.lower() != "text"]
    sized = materialise(docs.select(F.struct(*fields(slim)).alias("row"), own) if slim and len(slim) == len(carry) else docs.select(own))
    rows = sized if "row" in sized.columns else docs.select(F.struct(*fields(carry)).alias("row"), own)
    counted = sorted((r["length"], r["count"]) for r in sized.groupBy("own.length").count().collect())
    bounds, sizes = [0], [0]
    if counted:
        lengths, counts = (np.array(x, np.int64) for x in zip(*counted, strict=True))
        bounds = optimal_boundaries(lengths, counts, lengths * counts, buckets).tolist()
        at = np.searchsorted(lengths, bounds, "right")
        sizes = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(counts)])[at]])).tolist()
    pick = lambda values: F.element_at(F.array(*[F.lit(int(x)).cast("long") for x in values]), F.col("bucket") + 1)
    bucket = sum((F.lit(int(b)) < F.col("own.length")).cast("int") for b in bounds[:-1]) if len(bounds) > 1 else F.lit(0)
    shard = F.floor(F.col("own.u") * pick([n // SHARD_ROWS + 1 for n in sizes])).cast("int")
    with_bucket = lambda df: df.withColumn("bucket", bucket)
    placed = ranked(with_bucket(rows), ["bucket"], [F.col("own.u"), F.col("own.id")], shard, "place", with_bucket(sized.select("own")))
    per, bound = pick([max(1, budget // max(1, b)) for b in bounds]), pick(bounds)
    made = F.struct(
        F.col("own.length").alias("n_tokens"), F.col("bucket").cast("int").alias("bucket"), bound.alias("bucket_len"), F.floor(F.col("place") / per).cast("long").alias("batch"),
        (F.col("place") % per).cast("int").alias("slot"), (bound - F.col("own.length")).alias("padding"),
    )
    return placed.select("row.*", made.alias("_pack"))


ORACLE_SQL = rf"""
    WITH RECURSIVE sized AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents),
         hist AS (SELECT n_tokens AS length, count(*)::BIGINT AS n, sum(n_tokens)::BIGINT AS t FROM sized GROUP BY n_tokens),
         h AS MATERIALIZED (SELECT row_number() OVER (ORDER BY length) AS j, length, sum(n) OVER (ORDER BY length)::BIGINT AS rows_to, sum(t) OVER (ORDER BY length)::BIGINT AS tokens_to FROM hist),
         dp AS (
            SELECT 1 AS k, j, length * rows_to - tokens_to AS cost, [length] AS bounds FROM h
            UNION ALL
            SELECT k + 1, b.j, min(d.cost + b.length * (b.rows_to - a.rows_to) - (b.tokens_to - a.tokens_to)),
                   list_append(arg_min(d.bounds, (d.cost + b.length * (b.rows_to - a.rows_to) - (b.tokens_to - a.tokens_to))::HUGEINT * 1000000 + a.j), b.length)
            FROM dp d JOIN h a ON a.j = d.j JOIN h b ON b.j > a.j WHERE d.k < {BUCKETS} GROUP BY k, b.j, b.length),
         best AS (SELECT bounds FROM dp WHERE j = (SELECT max(j) FROM h) ORDER BY k DESC LIMIT 1),
         placed AS (SELECT doc_id, n_tokens, len(list_filter(bounds, lambda b: b < n_tokens))::INTEGER AS bucket, bounds,
                           ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT AS u FROM sized, best),
         numbered AS (SELECT *, bounds[bucket + 1] AS bucket_len, row_number() OVER (PARTITION BY bucket ORDER BY u, doc_id) - 1 AS r FROM placed)
    SELECT doc_id, n_tokens, bucket, bucket_len, r // greatest(1, {BUDGET} // greatest(1, bucket_len)) AS batch,
           (r % greatest(1, {BUDGET} // greatest(1, bucket_len)))::INTEGER AS slot, bucket_len - n_tokens AS padding FROM numbered
"""
