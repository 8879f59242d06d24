"""A training corpus from raw documents, as five stages; each is written as Parquet before the next one reads it.

Null and blank texts fail the base rule of the first stage. Rows that repeat an id and a text count as one document in
line dedup and near duplicates, so they stay or go together. Null ids, languages and sources are values like others. Texts of any length
are read whole. Columns beyond those of ``documents`` stay, whatever their names; the last stage's own columns get
underscores where theirs are taken. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from driftline.llm.columns import fresh
from driftline.plans.scratch import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or the adaptive rules go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go, all but the first; so do documents of which nothing is left."""
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard 0.8 or more) the smallest doc_id stays."""
    return ngram_join.keep_one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to equal weights; documents stand in a global random order, as often as drawn."""
    mixed = mixing.mix_sources(docs)
    return mixed.withColumnsRenamed(dict(zip(mixed.columns[-2:], fresh(docs.columns, "copy", "shuffle_key"))))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: The stages on sketches, near copies and leaks have no SQL form; the tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
