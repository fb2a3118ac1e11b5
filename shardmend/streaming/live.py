"""Live payloads: a recipe over a stream of files, counts per second, the latest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardmend.operators.byte_steps import STEPS
from shardmend.plans.recipe import Recipe, Step, apply_recipe, seeded_name

FILES = "path string, modificationTime timestamp, length long, content binary"


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ts, bytes) of files as they arrive in a folder."""
    found = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("modificationTime").alias("ts"), F.col("content").alias("bytes"))


def live_recipe(stream: DataFrame, recipe: Recipe) -> DataFrame:
    """A stream of (.., bytes) through the steps of a recipe that keep up; stateless, so it scales with the batches."""
    return apply_recipe(stream, cheap_part(recipe))


def keeps_up(step: Step) -> bool:
    """Whether a step is cheap enough for a live stream: it works on bytes or segments alone."""
    return step.id in STEPS or seeded_name(step) is not None


def cheap_part(recipe: Recipe) -> Recipe:
    """A recipe with only the steps that keep up."""
    return Recipe([n for n in recipe.nodes if not isinstance(n, Step) or keeps_up(n)], recipe.engine, recipe.source)


def frames_per_second(stream: DataFrame, late: str = "2 seconds") -> DataFrame:
    """(second, frames): counts by event time; a second is given out once the watermark has passed it."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 second")).agg(F.count(F.lit(1)).alias("frames")).select(F.col("window.start").alias("second"), "frames")


def recording_rate(n_frames, seconds):
    """Frames per second of a clip, whole, between 1 and 30; a clip counts for half a second at least."""
    return F.least(F.greatest(F.round(n_frames / F.greatest(seconds, F.lit(0.5))), F.lit(1)), F.lit(30)).cast("int")


def keep_latest(stream: DataFrame, key: str, version: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Write the latest version of each key of every batch to ``sink``, by batch; ``latest`` reads what holds over all of them."""

    def newest(batch: DataFrame, epoch: int) -> None:
        newest_of(batch, key, version).write.mode("overwrite").parquet(f"{sink}/epoch={epoch}")

    return stream.writeStream.foreachBatch(newest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_of(rows: DataFrame, key: str, version: str) -> DataFrame:
    """The row of the highest version of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("row")).select(key, "row.*")


def latest(spark: SparkSession, sink: str, key: str, version: str) -> DataFrame:
    """The highest version of each key over all batches: an older one that arrives later never wins."""
    return newest_of(spark.read.parquet(sink).drop("epoch"), key, version)
