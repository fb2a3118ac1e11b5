"""The corpus pipeline: quality, line dedup, near-dedup, mixing, packing.

Every stage takes the session, the documents that the stage before kept, and the folder of the tables. All but the last
return the columns of documents; the last adds each row's place in its batch. A stage decides by its own input alone:
line dedup and near-dedup see what is left of the texts, the mix its sources as they are by then.

Null and empty texts, rows without ids, rows that repeat, texts of any length, ties and empty tables are treated as each
stage's operator says in its module; none of them drops a row for being one of these. Columns beside those of documents
are carried along under any names, but for ``_lines`` (line dedup) and ``_pack`` (packing), which are made anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardmend.llm import linededup, mixing, neardup, packing, quality
from shardmend.llm.common import fields, materialise, table, tidied


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, those with a score of 0.5 or more; without labels, all of them."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match earlier ones; none is dropped, even if all its lines go."""
    return linededup.without_repeated_lines(docs).drop("_lines")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of lowest id; rows without id or words all stay.

    Links are those of ``op4_near_duplicates``, whose contract sets two words to a shingle and a similarity of 0.8: one
    changed word then touches two shingles, and copies with a changed word in every twenty or so are still caught.
    """
    return neardup.deduplicated(docs, k=2)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target of their source asks: null sources are one source, rows without words are taken too."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their bucket, batch and slot; rows without words go to the first bucket."""
    return packing.packed(docs, docs.columns).select(*fields(docs.columns), "_pack.*")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The classifier is learned, which SQL cannot express; tests hold the whole result against plain versions of the stages.
ORACLE_SQL = None


@tidied
def written(stage, spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What a stage gives, written; what it wrote on the way is deleted."""
    return materialise(stage(spark, docs, sf_dir))


@tidied
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir) if name == STAGES[-1][0] else written(stage, spark, docs, sf_dir)
    return docs
