"""State by key over a stream: the newest version of each key, and a running frame number.

A row advances its key if its version is higher than all before; rows that come late never do. What advances is given out
once, with its number among the key's frames, which is what seeds of live recipes count up. State is two numbers for each
key, so nothing of the stream's past is read again. ``advancing`` is a stream itself and calls Python for each key of each
trigger; ``keep_advancing`` writes to a folder by joins and windows alone, for streams of many keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shardmend.plans.recipe import Recipe, apply_recipe
from shardmend.streaming.live import cheap_part


def advancing(stream: DataFrame, key: str, version: str) -> DataFrame:
    """The rows of a stream that advance their key, with ``frame``, from 1 on. Null keys are a key; rows without a version never advance.

    Rows of one trigger count in order of version, so the result depends on what arrives in which trigger alone.
    """
    fields = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, count = state.get if state.exists else (None, 0)
        for rows in sorted((f for f in frames), key=lambda f: f[version].min()):
            rows = rows[rows[version].notna()].sort_values(version, kind="stable").drop_duplicates(version)
            rows = rows if newest is None else rows[rows[version] > newest]
            if len(rows):
                rows = rows.assign(frame=range(count + 1, count + 1 + len(rows)))
                newest, count = int(rows[version].iloc[-1]), count + len(rows)
                yield rows
        if newest is not None:
            state.update((newest, count))

    return stream.groupBy(key).applyInPandasWithState(step, f"{fields}, frame long", "newest long, frames long", "append", GroupStateTimeout.NoTimeout)


def keep_advancing(stream: DataFrame, key: str, version: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the rows that advance their key, with ``frame``, to ``sink/rows``, by batch; the state of keys lies beside them.

    As ``advancing``, for what has arrived by now; started again on the same folders it goes on from there. A batch that is
    run again reads the state before it and writes over what it had written.
    """
    columns = stream.columns

    def advance(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        kind = dict(batch.dtypes)
        # The newest state before this batch; a trigger without rows leaves no state of its own.
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/state")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        found = [int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(path)] if fs.exists(path) else []
        known = max((e for e in found if e < epoch), default=None)
        schema = f"_key {kind[key]}, _newest {kind[version]}, _frames long"
        state = spark.createDataFrame([], schema) if known is None else spark.read.schema(schema).parquet(f"{sink}/state/epoch={known}")
        joined = batch.where(F.col(version).isNotNull()).dropDuplicates([key, version]).join(state, F.col(key).eqNullSafe(F.col("_key")), "left")
        fresh = joined.where(F.col("_newest").isNull() | (F.col(version) > F.col("_newest")))
        frame = F.coalesce("_frames", F.lit(0)) + F.row_number().over(W.partitionBy(key).orderBy(version))
        fresh.select(*columns, frame.cast("long").alias("frame")).write.mode("overwrite").parquet(f"{sink}/rows/epoch={epoch}")
        done = spark.read.parquet(f"{sink}/rows/epoch={epoch}").groupBy(F.col(key).alias("_key")).agg(F.max(version).alias("_newest"), F.max("frame").alias("_frames"))
        whole = state.unionByName(done).groupBy("_key").agg(F.max("_newest").alias("_newest"), F.max("_frames").alias("_frames"))
        whole.write.mode("overwrite").parquet(f"{sink}/state/epoch={epoch}")
        for old in found:
            if known is not None and old < known:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/state/epoch={old}"), True)

    return stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_frames(stream: DataFrame, key: str, version: str, recipe: Recipe, seed: int = 0) -> DataFrame:
    """A stream of payloads (.., bytes) that advance, each through the steps of a recipe that keep up, its seeds counted up by its frame."""
    seeded = advancing(stream, key, version).withColumn("_seed", (F.col("frame") - 1 + seed).cast("long"))
    return apply_recipe(seeded, cheap_part(recipe), seed="_seed").drop("_seed")
