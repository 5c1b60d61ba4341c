"""The queries over the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, merkle, mixing, passages, pii, quality, rules, simhash, substrings, tokens, toxicity, vectorcodes
from .common import table


#: A rank file of byte pieces.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(table(spark, sf_dir, "documents"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


def op13_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.compress(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {"op1_tokens": op1_tokens, "op2_simhash": op2_simhash, "op3_decontaminate": op3_decontaminate, "op4_passages": op4_passages, "op5_toxicity": op5_toxicity, "op6_mixing": op6_mixing, "op7_pii": op7_pii, "op8_rules": op8_rules, "op9_chat": op9_chat, "op10_quality": op10_quality, "op11_merkle": op11_merkle, "op12_substrings": op12_substrings, "op13_vectorcodes": op13_vectorcodes}


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op8_rules": rules.SQL, "op9_chat": chat.SQL, "op11_merkle": merkle.SQL, "op12_substrings": substrings.SQL, "op13_vectorcodes": vectorcodes.SQL}
