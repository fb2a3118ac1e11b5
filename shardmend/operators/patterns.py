"""Relational shapes that recovery work keeps asking for: histograms, centred frames, top of a group, seeded samples, maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shardmend.functions.prng import Pcg32
from shardmend.operators.marker_steps import drawn


def symbol_counts(payloads: DataFrame, column: str = "bytes") -> DataFrame:
    """(symbol, n): how often each byte occurs. Tasks count their own payloads and send 256 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                if b:
                    total += np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["symbol", "n"])

    return payloads.select(column).mapInArrow(run, "symbol int, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def box_blur(rows: DataFrame, key: list[str], order: list[str], value: str, radius: int) -> DataFrame:
    """``rows`` with the whole mean of ``value`` over a centred frame, which ends cut short; groups must be bounded."""
    frame = W.partitionBy(*key).orderBy(*order).rowsBetween(-radius, radius)
    return rows.withColumn("blurred", F.floor(F.sum(value).over(frame) / F.count(value).over(frame)).cast("long"))


def top_of(rows: DataFrame, key: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group; Spark keeps k rows of a group in each task before it shuffles."""
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def seeded_sample(rows: DataFrame, seed: str, size: str, k: int) -> DataFrame:
    """``rows`` with ``picked``: k of the numbers from 0 to ``size`` - 1 without repeats, in the order of a seeded shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = [drawn(Pcg32(s), n, k) for s, n in zip(batch.column(seed).to_pylist(), batch.column(size).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(picked, pa.list_(pa.int32()))], names=[*batch.schema.names, "picked"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "picked array<int>"]))


def as_map(rows: DataFrame, key: list[str], name: str, value: Column) -> DataFrame:
    """(key.., entries): a map of names to values for each group of few names."""
    return rows.groupBy(*key, name).agg(value.alias("_v")).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "_v")))).alias("entries"))


def differences(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``rows`` with ``n``, ``total`` and ``changed``: bytes that both payloads have, the sum of their absolute differences, how many differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True):
                n = min(len(x or b""), len(y or b""))
                d = np.abs(np.frombuffer((x or b"")[:n], np.uint8).astype(np.int64) - np.frombuffer((y or b"")[:n], np.uint8))
                found.append((n, int(d.sum()), int((d > 0).sum())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], names=[*batch.schema.names, "n", "total", "changed"])

    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "n long, total long, changed long"]))
