"""Coefficient blocks in long form: arrays in natural order, worked on by higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def zigzag(n: int = 8) -> list[int]:
    """For each natural position its place along the diagonals, which turn at every edge."""
    order = sorted(((x, y) for y in range(n) for x in range(n)), key=lambda p: (sum(p), p[1] if sum(p) % 2 else p[0]))
    place = {p: i for i, p in enumerate(order)}
    return [place[(x, y)] for y in range(n) for x in range(n)]


def kill(coef: Column, first: int = 10, last: int = 63) -> Column:
    """Coefficients of a zigzag range set to zero."""
    order = F.array(*map(F.lit, zigzag()))
    return F.transform(coef, lambda v, i: F.when(F.element_at(order, i + 1).between(first, last), F.lit(0)).otherwise(v))


def drop(coef: Column, mode: str = "zero") -> Column:
    """A component zeroed, flattened to its DC, or negated without overflow."""
    if mode == "flat":
        return F.transform(coef, lambda v, i: F.when(i == 0, v).otherwise(F.lit(0)))
    if mode == "negate":
        return F.transform(coef, lambda v: F.least(-v, F.lit(32767)))
    return F.transform(coef, lambda v: F.lit(0))


def energy(coef: Column) -> Column:
    """Sum of squares of all but the first coefficient."""
    return F.aggregate(F.slice(coef, F.lit(2), F.size(coef) - 1), F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v)


def zeros(coef: Column) -> Column:
    return F.size(F.filter(coef, lambda v: v == 0))


def dc_from_differences(blocks: DataFrame) -> DataFrame:
    """DC values as running sums of differences in each restart interval of a component."""
    return blocks.withColumn("dc", F.sum("diff").over(W.partitionBy("photo", "interval").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))


def upper_median(values: Column) -> Column:
    """The upper of the two middle values, not their mean."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def dc_offset(blocks: DataFrame, component: int = 2, amount: int = 60, at: float = 50.0, interval: int = 0) -> DataFrame:
    """``blocks`` (photo, comp, mcu, q0, dc) with ``dc`` moved from a share of the photo on, up to the next restart.

    ``amount`` is in levels, so it is divided by the first quantiser; ``interval`` is the number of units between
    restarts, 0 for none. The units of a photo are counted by a join on its aggregate.
    """
    amount = min(max(amount, -4096), 4096)
    total = blocks.groupBy("photo").agg((F.max("mcu") + 1).alias("_total"))
    start = F.least(F.floor(F.col("_total") * F.lit(min(max(at, 0.0), 100.0)) / 100).cast("long"), F.col("_total") - 1)
    end = (F.floor(start / interval) + 1) * interval if interval else F.col("_total")
    delta = rounded(F.lit(float(amount * 8)) / F.greatest("q0", F.lit(1)))
    moved = F.least(F.greatest(F.col("dc") + delta, F.lit(-32767)), F.lit(32767))
    inside = (F.col("comp") == component) & (F.col("mcu") >= start) & (F.col("mcu") < end)
    return blocks.join(total, "photo").withColumn("dc", F.when(inside, moved).otherwise(F.col("dc")).cast("int")).select(*blocks.columns)


def rounded(x: Column) -> Column:
    """Halves away from zero, as a whole number."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def row_corrections(medians: Column, threshold: int, strength: float = 1.0) -> Column:
    """What each row of blocks is off by, from the median steps to the row above: rows are mended from the top down.

    A step counts if it reaches the threshold once the row above is mended; ``medians`` is the array of one photo's rows.
    """

    def step(done: Column, median: Column) -> Column:
        off = median + F.when(F.size(done) > 0, F.element_at(done, -1)).otherwise(F.lit(0).cast("long"))
        return F.concat(done, F.array(F.when(F.abs(off) < threshold, F.lit(0).cast("long")).otherwise(rounded(off * F.lit(float(strength))))))

    return F.aggregate(medians, F.array().cast("array<bigint>"), step)


def repaired(blocks: DataFrame, q0: int = 16, strength: float = 1.0) -> DataFrame:
    """``blocks`` (photo, by, bx, dc) with the levels of each row of blocks brought to those of the row above.

    Rows of a photo are bounded, so their medians are one array; blocks meet what is above them by an equi-join.
    """
    above = blocks.select("photo", (F.col("by") + 1).alias("by"), "bx", F.col("dc").alias("_above"))
    steps = blocks.join(above, ["photo", "by", "bx"]).groupBy("photo", "by").agg(upper_median(F.collect_list((F.col("dc") - F.col("_above")).cast("long"))).alias("median"))
    ordered = steps.groupBy("photo").agg(F.sort_array(F.collect_list(F.struct("by", "median"))).alias("rows"))
    fixed = row_corrections(F.transform("rows", lambda r: r["median"]), max(96 // max(q0, 1), 2), strength)
    off = ordered.select("photo", F.explode(F.arrays_zip(F.transform("rows", lambda r: r["by"]).alias("by"), fixed.alias("off"))).alias("r")).select("photo", "r.by", "r.off")
    level = F.least(F.greatest(F.col("dc") - F.coalesce("off", F.lit(0).cast("long")), F.lit(-2047)), F.lit(2047))
    return blocks.join(off, ["photo", "by"], "left").withColumn("dc", F.when(F.col("off").isNull() | (F.col("off") == 0), F.col("dc")).otherwise(level).cast("int")).select(*blocks.columns)


def painted(coef: Column, weight: Column, mode: str = "zero") -> Column:
    """Coefficients under a brush of weight 0 to 1: faded out, or kept to their first one."""
    faded = lambda v: (v * (F.lit(1.0) - weight)).cast("int")
    return F.transform(coef, lambda v, i: F.when(F.lit(mode == "flat") & (i == 0), v).otherwise(faded(v)))


def mask_weight(mask: dict, strength: Column | float, x: Column, y: Column, width: Column, height: Column) -> Column:
    """The weight of a place (x, y) of a grid under a painted mask {w, h, data} of 0 to 255, whose own grid is laid over the whole.

    Each place takes the mask's cell that it falls into. A mask that isn't whole covers everything.
    """
    w, h, data = int(mask.get("w") or 0), int(mask.get("h") or 0), mask.get("data") or []
    if w <= 0 or h <= 0 or len(data) < w * h:
        return F.lit(1.0) * strength
    cell = F.least(F.floor(y * h / F.greatest(height, F.lit(1))), F.lit(h - 1)) * w + F.least(F.floor(x * w / F.greatest(width, F.lit(1))), F.lit(w - 1))
    return F.element_at(F.array(*[F.lit(float(min(max(int(v), 0), 255))) for v in data[: w * h]]), (cell + 1).cast("int")) / 255.0 * strength


def brushed(coef: Column, weight: Column, mode: str = "zero") -> Column:
    """Coefficients of a block under a brush: detail dropped from the finest on, ``boost``ed, or rounded to ``harsh`` steps; the first one stays."""
    most = lambda v: F.least(F.greatest(v, F.lit(-32767)), F.lit(32767)).cast("int")
    if mode in ("boost", "harsh"):
        f = F.lit(1.0) + weight * (3.0 if mode == "boost" else 15.0)
        change = (lambda v: rounded(v * f)) if mode == "boost" else (lambda v: rounded(rounded(v / f) * f))
        done = F.transform(coef, lambda v, i: F.when(i == 0, v).otherwise(most(change(v))))
    else:
        keep = F.least(F.greatest(rounded(F.lit(64.0) - weight * 63.0), F.lit(1)), F.lit(64))
        order = F.array(*map(F.lit, zigzag()))
        done = F.transform(coef, lambda v, i: F.when(F.element_at(order, i + 1) < keep, v).otherwise(F.lit(0)))
    return F.when(weight > 0, done).otherwise(coef)
