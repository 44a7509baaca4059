"""A training-data pipeline over the documents table: language ID, line dedup, near-duplicate join, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import crf, line_dedup, mixing, ngram_join, packing
from tidewire.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_EVIDENCE = -10.0  # bits: beyond a thousand to one against all languages, however long the text


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the languages of the labels, lang set to the largest; null texts, texts without letters and texts whose words speak
    by more than ten bits against all of the languages (random letters, other scripts) go. Texts of several languages stay."""
    found = crf.languages(docs.select(*COLUMNS), "doc_id", "text", "lang", evidence=True)
    found = found.where((F.col("lang_pred") != "und") & (F.col("evidence") > LEAST_EVIDENCE))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document holds are deleted; documents left without text go."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), "doc_id", "text")
    out = out.where((F.col("removed_lines") == 0) | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def join_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays, that of the smallest doc_id, then
    of the smallest text hash: documents that share an id but not their text are documents of their own. Documents without
    an id come after all ids, by their text's hash. Rows of equal id and text become one; those without words only if equal in full."""
    at = F.xxhash64("text")
    late = F.lit(1 << 62) + F.pmod(at, F.lit(1 << 61))
    keyed = docs.select(*COLUMNS).withColumn("_key", F.struct(F.coalesce(F.col("doc_id"), late).alias("id"), at.alias("ref")))
    groups = ngram_join.jaccard_join(keyed.select("_key", "text"), "_key", "text", 5, 80, 100)
    first = groups.where(F.col("_key") == F.col("component_id")).select("_key").distinct()
    wordless = F.when(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.to_json(F.struct(*COLUMNS)))
    return keyed.join(first, "_key", "left_semi").withColumn("_row", wordless).dropDuplicates(["_key", "_row"]).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf of the domain-language-source tree cut to its share of four fifths of all tokens; no document twice."""
    levels = {"domain": F.expr(mixing.DOMAIN), "lang_leaf": F.col("lang"), "source_leaf": F.col("source")}
    weights = {"domain": mixing.WEIGHTS["domain"], "lang_leaf": mixing.WEIGHTS["lang"]}
    return mixing.mix(docs.select(*COLUMNS), "doc_id", mixing.n_words(), levels, weights, 0.8, 1, content="text").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 4096 tokens along the curve."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path(), 4096, 2)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("line_dedup", dedup_lines), ("ngram_join", join_ngrams), ("mixing", mix), ("packing", pack),
]
ORACLE_SQL = None  # the language field and the curve have no SQL; the stages are tested against plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
