"""Steps that take bytes of another payload: the donor comes by an equi-join, the bytes by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardmend.functions.payload import head, tail
from shardmend.operators.lookups import next_in_group, numbered
from shardmend.sources.markers import HEADER_GUESS


def pool_rotation(payloads: DataFrame, places: int = 1) -> DataFrame:
    """(ord, k, donor): for each payload its first ``places`` donors, the others in order from the next one on, wrapping.

    ``ord`` orders the pool and may have gaps. A pool of one is its own donor.
    """
    pool = numbered(payloads.select("ord"), "ord", "no")
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    rows = pool.join(F.broadcast(size)).select("ord", "no", "size", F.explode(F.sequence(F.lit(0), F.lit(places - 1))).alias("k"))
    rows = rows.where(F.col("k") < F.greatest(F.col("size") - 1, F.lit(1))).select("ord", "k", F.pmod(F.col("no") + 1 + F.col("k"), F.col("size")).alias("no"))
    return rows.join(pool.select("no", F.col("ord").alias("donor")), "no").select("ord", "k", "donor")


def with_donor(payloads: DataFrame, k: int = 0) -> DataFrame:
    """``payloads`` (ord, bytes) with the bytes of their k-th donor as ``other``."""
    if k == 0:
        turn = next_in_group(payloads.withColumn("_all", F.lit(0)), ["_all"], "ord").select("ord", F.col("next").alias("donor"))
    else:
        turn = pool_rotation(payloads, k + 1).where(F.col("k") == k).select("ord", "donor")
    donors = payloads.select(F.col("ord").alias("donor"), F.col("bytes").alias("other"))
    return payloads.join(turn, "ord").join(donors, "donor").drop("donor")


def text_body(b: Column) -> Column:
    """Where the body of a payload without JPEG structure begins."""
    return F.least(F.length(b), F.lit(HEADER_GUESS))


def aligned(size: Column, fraction: float, cluster: int) -> Column:
    """A fraction of a size, cut down to whole clusters."""
    return (F.floor((size * F.lit(fraction)).cast("int") / F.lit(cluster)) * cluster).cast("int")


def cross_link(b: Column, other: Column, at: float = 55, cluster_kb: int = 8) -> Column:
    """From a cluster on, the chain runs on in another file, at the same fraction of it."""
    start, size = text_body(b), cluster_kb * 1024
    keep = start + aligned(F.length(b) - start, at / 100, size)
    return F.concat(head(b, keep), tail(other, aligned(F.length(other), at / 100, size)))


def recuva_contiguous(b: Column, other: Column, fragment_at: float = 45, cluster_kb: int = 8) -> Column:
    """The first fragment, then a neighbour's data from its first third on, up to the same length."""
    start, size = text_body(b), cluster_kb * 1024
    keep = F.least(start + aligned(F.length(b) - start, fragment_at / 100, size), F.length(b))
    first = (F.floor(F.floor(F.length(other) / 3) / size) * size).cast("int")
    need = F.length(b) - keep
    laps = F.ceil((need + first) / F.greatest(F.length(other), F.lit(1))).cast("int")
    # The neighbour over and over, from the first third of its first turn.
    over = F.unhex(F.repeat(F.hex(other), F.when(F.length(other) > 0, laps).otherwise(0)))
    return F.concat(head(b, keep), F.substring(over, first + 1, need))


def interleave(b: Column, other: Column, start: float = 20, period: int = 2, cluster_kb: int = 8) -> Column:
    """Periods of clusters of two files in turns; the donor starts again when it ends."""
    body, cluster = text_body(b), cluster_kb * 1024
    step = period * cluster
    at = body + aligned(F.length(b) - body, start / 100, cluster)
    turns = F.ceil((F.length(b) - at) / step).cast("int")
    own, donor = F.hex(b), F.hex(other)
    lap = F.greatest(F.ceil(F.length(other) / step), F.lit(1))
    piece = lambda i: F.concat(
        F.substring(own, (at + i * step) * 2 + 1, F.lit(2 * step)),
        F.when(i < turns - 1, F.substring(donor, (F.pmod(i, lap) * step * 2 + 1).cast("int"), F.lit(2 * step))).otherwise(F.lit("")),
    )
    mixed = F.array_join(F.transform(F.sequence(F.lit(0), turns - 1), piece), "")
    return F.concat(head(b, at), F.when(turns > 0, F.unhex(mixed)).otherwise(F.unhex(F.lit(""))))
