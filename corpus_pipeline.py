"""A corpus from raw documents to a mix: five stages, each an operator of motifloom.llm.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. Toxic documents go; of near-duplicates the one of the smallest id stays;
documents with a benchmark passage go; personal data are masked; the last stage
gives what the mix takes of each document, where, and its masked text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from motifloom.llm import decontaminate, mixing, pii, simhash, toxicity
from motifloom.llm.common import cut, table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_masking(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def mixing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, with_text=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", pii_masking),
    ("mixing", mixing_plan),
]

#: SQL can't express the classifier, the fingerprints or the field; tests/llm/test_pipeline.py holds the rows against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{name}")
    return docs
