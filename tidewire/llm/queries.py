"""The operators' queries over whole tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, crf, ctw, html_text, importance, line_dedup, media, mixing, ngram_join, packing, secret_scan, sharding, vectors
from .common import table


def op1_nearest_url_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.op1(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op2_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.op2(table(spark, sf_dir, "documents", "doc_id", "text"))


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op3(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.op4(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.op5(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_line_alignment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.op6(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op7(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))


def op8_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op8(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.op9(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.op10(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op11(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.op12(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


def op13_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op13(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_nearest_url_text,
        op2_curve_packing,
        op3_rendezvous_shards,
        op4_vector_near_dedup,
        op5_ngram_jaccard_join,
        op6_line_alignment_dedup,
        op7_hierarchical_mix,
        op8_media_sniffing,
        op9_context_tree_scoring,
        op10_crf_language,

        op11_tokenizer_alignment,
        op12_importance_resampling,
        op13_grammar_secrets,

    )
}
SQL: dict[str, str] = {
    "op4_vector_near_dedup": vectors.OP4_SQL,
    "op5_ngram_jaccard_join": ngram_join.sql(4, 85, 100),
    "op7_hierarchical_mix": mixing.OP7_SQL,
    "op12_importance_resampling": importance.OP12_SQL,
}
