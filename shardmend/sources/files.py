"""Payload files: reading folders of them, and telling what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def payload_kind(path: Column, content: Column) -> Column:
    """project, recipe, avi, photo or unknown, by magic bytes first and by extension else."""
    magic = F.hex(F.substring(content, 1, 12))
    name = F.lower(path)
    return (
        F.when(magic.startswith("504B0304"), "project").when(magic.startswith("52494646") & (F.substring(magic, 17, 8) == "41564920"), "avi").when(magic.startswith("FFD8"), "photo")
        .when(name.endswith(".json"), "recipe").when(name.rlike(r"\.(jpe?g|png|gif|bmp|webp)$"), "photo").otherwise("unknown")
    )


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, kind) of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("content").alias("bytes"), payload_kind(F.col("path"), F.col("content")).alias("kind"))
