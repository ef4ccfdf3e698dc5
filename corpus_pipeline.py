"""From raw documents to coded training text, as five written stages."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import op2_lines, op3_quality, op4_decontam, op5_probminhash, op6_bpe
from quillspark.plans.scratch import Scratch, released
from quillspark.plans.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return op3_quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go from the texts; every document stays."""
    return op2_lines.strip_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class stays."""
    return op5_probminhash.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return op4_decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text is coded and decoded again; one row of digests per document."""
    return op6_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near-duplicate removal", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", bpe_codec),
]

#: The robust estimates and the classes of near-duplicates are iterative: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again. What a stage has
    written for itself, and the table before it, goes when its result is written."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with released():
            docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(before)
    return docs
