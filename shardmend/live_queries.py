"""Queries over clips and streams: tables stand in for what arrives, and run through Structured Streaming to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardmend import sql_draws
from shardmend.catalogue import digest, query, shared_run, table
from shardmend.photo_queries import SQL_PHOTO, WHOLE, photos
from shardmend.plans.recipe import Recipe, Step
from shardmend.sources import clips
from shardmend.streaming import live, versions


@query("clip_round_trip", f"WITH {SQL_PHOTO} SELECT doc_id // 8 AS clip_id, (row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1)::INTEGER AS idx, md5({WHOLE}) AS digest FROM ph")
def clip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos as frames of clips of eight, written as files and taken apart again."""
    frames = photos(spark, sf_dir).select(F.floor(F.col("photo_id") / 8).alias("clip_id"), (F.col("photo_id") % 8).cast("int").alias("idx"), F.lit(12.5).alias("fps"), "bytes")
    return clips.clip_frames(clips.clips_of_frames(frames, 16, 16)).select("clip_id", "idx", digest().alias("digest"))


_COVERED = sql_draws.by_byte("CASE WHEN k < 1024 THEN format('{:02X}', xor(('0x' || substr(hx, (2 * k + 1)::BIGINT, 2))::BIGINT, (v[k // 4 + 1] >> (8 * (k % 4))) & 255)) ELSE " + sql_draws.OWN + " END")


@query("clip_frame_recipe", f"""
    WITH RECURSIVE {SQL_PHOTO}, p AS (SELECT doc_id, doc_id // 8 AS clip_id, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS idx, {WHOLE} AS hx, len({WHOLE}) // 2 AS n FROM ph),
         {sql_draws.draws("g", "p", "greatest(1, (least(n, 1024) + 3) // 4)", seed="7 + idx")}, c AS (SELECT clip_id, idx, {_COVERED} AS h FROM p JOIN g USING (doc_id))
    SELECT clip_id, idx::INTEGER AS idx, md5(substr(h, 1, 2 * floor(len(h) // 2 * 60.0::DOUBLE / 100)::BIGINT)) AS digest FROM c
""")
def clip_frame_recipe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recipe on each frame of clips of eight, its seeds counted up over the frames: covered by a key stream, then cut short."""
    frames = photos(spark, sf_dir).select(F.floor(F.col("photo_id") / 8).alias("clip_id"), (F.col("photo_id") % 8).cast("int").alias("idx"), F.lit(10.0).alias("fps"), "bytes")
    whole = clips.clips_of_frames(frames, 16, 16)
    recipe = Recipe([Step("ransomware", {"kb": 1}, 7), Step("truncate", {"percent": 60})])
    return clips.framewise(whole, recipe).select("clip_id", "idx", digest().alias("digest"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("live_event_counts", "SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second, count(*) AS frames FROM events GROUP BY date_trunc('second', ts) HAVING date_trunc('second', min(ts)) + INTERVAL 1 SECOND <= (SELECT max(ts) FROM events) - INTERVAL 2 SECOND")
def live_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per second by event time, given out once the watermark has passed them."""
    folder = shared_run(spark)
    counts = live.frames_per_second(events_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts")))
    counts.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/at").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("second timestamp, frames long").parquet(f"{folder}/out").select(F.date_format("second", "yyyy-MM-dd HH:mm:ss").alias("second"), "frames")


@query("live_latest_event", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def live_latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user: late ones of lower number never win."""
    folder = shared_run(spark)
    rows = events_stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    live.keep_latest(rows, "user_id", "event_id", f"{folder}/out", f"{folder}/at").awaitTermination()
    return live.latest(spark, f"{folder}/out", "user_id", "event_id").select("user_id", "event_id", "event_type")



@query("clip_recording_rate", """
    WITH r AS (SELECT user_id, count(*) AS frames, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM events GROUP BY user_id)
    SELECT user_id, frames, least(greatest(floor(frames / greatest(seconds, 0.5::DOUBLE) + 0.5), 1), 30)::INTEGER AS rate FROM r
""")
def clip_recording_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at which each user's events would play as a recording: as fast as they came, within what a clip may have."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    taken = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("frames"), ((F.max(at) - F.min(at)) / F.lit(1e6)).alias("seconds"))
    return taken.select("user_id", "frames", live.recording_rate(F.col("frames"), F.col("seconds")).alias("rate"))


PARTS = 4


@query("live_advancing_frames", f"""
    WITH e AS (SELECT event_id, user_id, event_type, (event_id * 7) % {PARTS} AS part FROM events),
         m AS (SELECT user_id, part, max(event_id) AS newest FROM e GROUP BY ALL),
         b AS (SELECT user_id, part, max(newest) OVER (PARTITION BY user_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m)
    SELECT e.event_id, e.user_id, e.event_type, row_number() OVER (PARTITION BY e.user_id ORDER BY e.event_id) AS frame FROM e JOIN b ON b.user_id = e.user_id AND b.part = e.part WHERE before IS NULL OR event_id > before
""")
def live_advancing_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in four parts, mixed up: those that advance their user, with the user's running number of such."""
    folder = shared_run(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in/*")
    for part in range(PARTS):
        # All that has come since the last trigger is one batch, in as many files as it takes.
        events.where((F.col("event_id") * 7) % PARTS == part).write.parquet(f"{folder}/in/part{part}")
        versions.keep_advancing(stream, "user_id", "event_id", f"{folder}/out", f"{folder}/at").awaitTermination()
    return spark.read.schema(f"{', '.join(f'{n} {t}' for n, t in events.dtypes)}, frame long").parquet(f"{folder}/out/rows").select(*events.columns, "frame")
