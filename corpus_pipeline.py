"""From raw documents to packed sequences: five stages, each an operator of the llm subpackage.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and all but the last return the
columns of documents. ``run`` applies them in order, writing each result into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakequill.llm import common, mixing, packing, quality, set_join, toxicity


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or leave their compression bands go."""
    return quality.passing(docs)


def toxic_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go. The classifier learns from the labelled training folds of the raw documents."""
    return toxicity.without_toxic(docs, common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of five-word shingles of 0.8 or more, the smallest id stays."""
    return set_join.deduplicated(docs, k=5, num=4, den=5)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.repeated(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_filter),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing_sources", source_mix),
    ("best_fit_packing", packed_sequences),
]

#: SQL can express neither zstandard ratios nor a tokenizer; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
