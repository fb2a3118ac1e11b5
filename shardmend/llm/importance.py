"""Importance resampling towards a target distribution.

Word features are hashed into buckets; how often the target texts and all documents use a bucket gives each bucket a
gain, a document weighs the mean gain of its features, and the documents of highest weight plus hash-seeded Gumbel noise
are drawn, which is sampling without replacement in proportion to the exponential of the weights.

Features come from the bytes of Arrow's text buffer: a table classifies bytes, differences of the classes are the word
boundaries, and one table-driven CRC32 state for each word advances over all words at once, byte by byte; a run of
several words goes on with a space and the next word's bytes.

Counts leave a task as at most one number for each bucket. Scores are whole numbers of a bounded range, so their
histogram, which the driver reads to find the last score drawn, is bounded too; only drawn rows are ranked, in ranges
of (score, id).

Null and empty texts, and those without words, have no features, weigh 0 and are not among the rows to draw from. Very
long texts and words are read whole. Rows without doc_id draw by their text and are the last of equal scores. Rows that
repeat an id draw alike and are ranked one by one. Empty tables, on either side, give counts of zero. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardmend.llm.common import BUFFER, LOWER, id_key, lean, materialise, ranked, row_groups, tidied, utf8

BUCKETS, RUN, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, "2024"
#: Bytes of a word that all words advance over together; the few longer ones go on one by one.
TOGETHER = 48


def _crc_table() -> np.ndarray:
    """The states that CRC32 (reflected polynomial 0xEDB88320) reaches from each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


def _word_bytes() -> np.ndarray:
    """Whether a byte belongs to words: digits, letters and whatever is not ASCII."""
    inside = np.zeros(256, bool)
    inside[0x30:0x3A] = inside[0x41:0x5B] = inside[0x61:0x7B] = True
    inside[0x80:] = True
    return inside


CRC, WORD_BYTE = _crc_table(), _word_bytes()


def words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end, row) of the words of rows that stand end to end; no word crosses rows."""
    # A gap before every row, and one at the end, keeps the words of neighbours apart.
    inside = np.append(np.insert(WORD_BYTE[data].view(np.int8), starts[:-1], 0), np.int8(0))
    step = np.diff(inside)
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    row = np.searchsorted(starts[:-1] + np.arange(len(starts) - 1), begin, "right") - 1
    return begin - row, end - row, row


def advanced(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC states after the bytes from ``begin`` to ``end``, all at once."""
    size = end - begin
    order = np.argsort(np.minimum(size, 255).astype(np.uint8), kind="stable")[::-1]
    size, at, state = size[order], begin[order], state[order]
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, TOGETHER + 1), minlength=TOGETHER + 2))
    for i in range(TOGETHER):
        n = longer[i]
        if not n:
            break
        state[:n] = CRC[(state[:n] ^ data[at[:n] + i]) & np.uint32(255)] ^ state[:n] >> np.uint32(8)
    for i in range(longer[TOGETHER]):
        rest = data[at[i] + TOGETHER : at[i] + size[i]].tobytes()
        state[i] = zlib.crc32(rest, int(state[i] ^ np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def features(data: np.ndarray, starts: np.ndarray, buckets: int = BUCKETS, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of every run of 1 to ``run`` words, and how many words each row has."""
    data = LOWER[data]
    begin, end, row = words(data, starts)
    found_rows, found = [], []
    state = np.full(len(begin), 0xFFFFFFFF, np.uint32)
    for r in range(run):
        n = max(len(begin) - r, 0)
        state = state[:n]
        if r:
            state = CRC[(state ^ np.uint32(32)) & np.uint32(255)] ^ state >> np.uint32(8)
        state = advanced(state, data, begin[r:], end[r:])
        same = row[:n] == row[r:]  # runs that reach into the next row are none
        found_rows.append(row[:n][same])
        found.append(((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))[same])
    return np.concatenate(found_rows), np.concatenate(found).astype(np.int64), np.bincount(row, minlength=len(starts) - 1)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How often each bucket is used by all ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            for i, j in row_groups(starts, BUFFER):
                _, bucket, _ = features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], buckets, run)
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(lean(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a bucket adds to a weight: the logarithm of its smoothed share of the target over that of the documents, in thousandths."""
    s, t, n = documents.astype(np.float64), target.astype(np.float64), len(documents)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN, seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    kind, buckets = dict(docs.dtypes)["doc_id"], len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = utf8(batch.column("text"))
            n_words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, j in row_groups(starts, BUFFER):
                row, bucket, n_words[i:j] = features(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], buckets, run)
                n[i:j] = np.bincount(row, minlength=j - i)
                np.add.at(total, i + row, gain[bucket])
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            columns = [batch.column("doc_id"), batch.column("key"), *(pa.array(x) for x in (n_words, n, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "n_words", "n_features", "weight"])

    key = F.concat(F.lit(f"{seed}:"), id_key(F.col("doc_id"), F.col("text")))
    found = docs.select("doc_id", key.alias("key"), "text").mapInArrow(lean(weigh), f"doc_id {kind}, key string, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2("key", 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    return found.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


@tidied
def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, run: int = RUN, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; those not drawn have no rank."""
    scored = materialise(weighed(docs, gains(bucket_counts(docs, buckets, run), bucket_counts(target, buckets, run)), run, seed))
    able = F.col("n_words") >= least_words
    # Scores are thousandths of logarithms of counts and of noise: a histogram of some hundred thousand rows at most.
    counted = sorted(((r["score"], r["count"]) for r in scored.where(able).groupBy("score").count().collect()), reverse=True)
    wanted = sum(n for _, n in counted) * percent // 100
    last, above = None, 0
    for score, n in counted:
        if above >= wanted:
            break
        last, above = score, above + n
    near = F.lit(False) if last is None else able & (F.col("score") >= last)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    dealt = materialise(scored.where(near).repartitionByRange(*order, F.xxhash64("n_features", "weight")).withColumn("part", F.spark_partition_id()))
    placed = ranked(dealt, [], order, F.col("part"), "rank").withColumn("rank", F.when(F.col("rank") < wanted, F.col("rank") + 1))
    columns = ["doc_id", "n_features", "weight", "score"]
    return scored.where(~near).select(*columns, F.lit(None).cast("long").alias("rank")).unionByName(placed.select(*columns, "rank"))


def drawn(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """(doc_id, rank) of the sample itself."""
    return resampled(docs, target, **settings).where("rank IS NOT NULL").select("doc_id", "rank")


ORACLE_SQL = rf"""
    WITH tab AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)) t),
         w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
         b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
         dw AS MATERIALIZED (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM w) GROUP BY ALL),
         bw AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
         hx AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
         crc AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                                      lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % {BUCKETS} AS bucket FROM hx, tab),
         s AS (SELECT bucket, sum(n)::BIGINT AS s FROM dw JOIN crc USING (word) GROUP BY bucket),
         t AS (SELECT bucket, sum(n)::BIGINT AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
         sums AS (SELECT (SELECT coalesce(sum(s), 0)::BIGINT FROM s) AS sall, (SELECT coalesce(sum(t), 0)::BIGINT FROM t) AS tall),
         gain AS (SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * (sall + {BUCKETS}))::DOUBLE / ((s + 1) * (tall + {BUCKETS}))::DOUBLE))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
         means AS (SELECT doc_id, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS g FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY doc_id),
         scored AS (SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN ((g - ((g % n) + n) % n) // n)::BIGINT ELSE 0 END AS weight,
                           ('0x' || substr(sha256('{SEED}:' || w.doc_id), 1, 8))::BIGINT AS h FROM w LEFT JOIN means USING (doc_id)),
         final AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
         able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM final WHERE n_features >= {LEAST_WORDS})
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {PERCENT} // 100 THEN r END AS rank FROM final LEFT JOIN able USING (doc_id)
"""
