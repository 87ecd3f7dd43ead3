"""The operators of this subpackage as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import common, context_tree, cross_polytope, html_text, licenses, mixing, packing, quality, records, set_join, tokens, toxicity


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(common.table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_vectors(common.table(spark, sf_dir, "embeddings"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.classes(common.table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents"), tokens.default_tokenizer())


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(common.table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.scored(common.table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(common.table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op10_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "records")
    records.write(common.table(spark, sf_dir, "documents"), path, tokens.default_tokenizer())
    return records.index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_embedding_near_dedup, op3_ngram_jaccard_join, op4_mixing_sources, op5_best_fit_packing, op6_license_scan, op7_lm_scoring, op8_html_extraction, op9_toxicity, op10_token_records)}


def oracle_sql() -> dict[str, str]:
    return {"op2_embedding_near_dedup": cross_polytope.ORACLE, "op3_ngram_jaccard_join": set_join.ORACLE, "op4_mixing_sources": mixing.ORACLE, "op6_license_scan": licenses.oracle()}
