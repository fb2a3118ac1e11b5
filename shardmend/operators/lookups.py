"""Lookups by place: intervals, the last at or before, the next in a group, the donor that fits best."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def interval_join(points: DataFrame, intervals: DataFrame, key: str, at: str, low: str, high: str, grid: int) -> DataFrame:
    """Points with the intervals [low, high) that hold them, by an equi-join on cells of ``grid`` places."""
    cells = intervals.where(F.col(high) > F.col(low)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / grid), F.floor((F.col(high) - 1) / grid))))
    return points.withColumn("_cell", F.floor(F.col(at) / grid)).join(cells, [key, "_cell"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_cell")


def last_before(points: DataFrame, marks: DataFrame, key: str, at: str, value: str, block: int) -> DataFrame:
    """Points with the ``value`` of the last mark at or before them; both have columns ``key`` and ``at``.

    Places are dealt in blocks; what a block does not know it takes from the last block before with a mark.
    """
    rows = marks.select(key, at, F.col(value).alias("_value"), F.lit(0).alias("_kind")).unionByName(points.select(key, at, F.lit(1).alias("_kind")), allowMissingColumns=True)
    rows = rows.withColumn("_block", F.floor(F.col(at) / block))
    inside = W.partitionBy(key, "_block").orderBy(at, "_kind").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("_seen", F.last("_value", ignorenulls=True).over(inside))
    ends = rows.where("_kind = 0").groupBy(key, "_block").agg(F.max_by("_value", at).alias("_end"))
    all_blocks = rows.select(key, "_block").distinct().join(ends, [key, "_block"], "left")
    before = all_blocks.withColumn("_before", F.last("_end", ignorenulls=True).over(W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).drop("_end")
    return seen.where("_kind = 1").join(before, [key, "_block"]).select(key, at, F.coalesce("_seen", "_before").alias(value))


def numbered(rows: DataFrame, place: str, name: str, block: int = 10_000) -> DataFrame:
    """``rows`` with their number from 0 in order of ``place``, an integer without repeats; places are dealt in blocks."""
    dealt = rows.withColumn("_block", F.floor(F.col(place) / block))
    sizes = dealt.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_block", (F.sum("_n").over(W.orderBy("_block")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_block").orderBy(place)) - 1
    return dealt.withColumn("_inside", inside).join(before, "_block").select(*rows.columns, (F.col("_inside") + F.col("_before")).alias(name))


def next_in_group(rows: DataFrame, group: list[str], place: str, block: int = 10_000) -> DataFrame:
    """(group.., place, next): the next row of the same group in order of place, the first again after the last.

    Groups are dealt in blocks of places, so that a group of any size is no single task.
    """
    dealt = rows.select(*group, place).withColumn("_block", F.floor(F.col(place) / block))
    inside = dealt.withColumn("_next", F.lead(place).over(W.partitionBy(*group, "_block").orderBy(place)))
    firsts = dealt.groupBy(*group, "_block").agg(F.min(place).alias("_first"))
    order = W.partitionBy(*group).orderBy("_block")
    following = firsts.withColumn("_after", F.coalesce(F.lead("_first").over(order), F.min("_first").over(W.partitionBy(*group)))).drop("_first")
    same = [inside[c].eqNullSafe(following[c]) for c in [*group, "_block"]]
    return inside.join(following, same).select(*[inside[c] for c in [*group, place]], F.coalesce("_next", "_after").alias("next"))


def best_donor(pool: DataFrame, place: str, tables: str, frame: str) -> DataFrame:
    """(place, donor, score): the first other payload after each, wrapping, that is most like it.

    Equal tables and frame count 3, tables alone 2, frame alone 1; without any, the next one is taken.
    """
    out = pool.select(place, tables, frame)
    for score, group in ((3, [tables, frame]), (2, [tables]), (1, [frame])):
        found = next_in_group(pool, group, place).where(F.col("next") != F.col(place)).select(place, F.col("next").alias(f"_{score}"))
        out = out.join(found, place, "left")
    last = next_in_group(pool.withColumn("_all", F.lit(0)), ["_all"], place).select(place, F.col("next").alias("_0"))
    score = F.when(F.col("_3").isNotNull(), 3).when(F.col("_2").isNotNull(), 2).when(F.col("_1").isNotNull(), 1).otherwise(0)
    return out.join(last, place).select(place, F.coalesce("_3", "_2", "_1", "_0").alias("donor"), score.alias("score"))
