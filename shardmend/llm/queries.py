"""The registered queries over the operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shardmend.llm import bestfit, chat, fingerprint, html, importance, infill, licenses, linededup, media, mixing, neardup, packing, quality
from shardmend.llm.common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), ["doc_id"]).select("doc_id", "_pack.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mixture(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", "_mix.taken")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linededup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "text", "n_chars", "_lines.n_lines", "_lines.n_removed")


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(table(spark, sf_dir, "documents"))


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.packed_pieces(table(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digest(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_packing": op2_packing,
    "op3_mixing": op3_mixing,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_license_scans": op7_license_scans,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_html_extraction": op9_html_extraction,
    "op10_media_columns": op10_media_columns,
    "op11_best_fit": op11_best_fit,
    "op12_importance": op12_importance,
    "op13_infill": op13_infill,
}

ORACLE_SQL: dict[str, str] = {
    "op2_packing": packing.ORACLE_SQL,
    "op3_mixing": mixing.ORACLE_SQL,
    "op4_near_duplicates": neardup.ORACLE_SQL,
    "op6_line_dedup": linededup.ORACLE_SQL,
    "op8_chat_formatting": chat.ORACLE_SQL,
    "op12_importance": importance.ORACLE_SQL,
    "op13_infill": infill.ORACLE_SQL,
}
