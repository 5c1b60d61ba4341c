"""Alignments, substitution matrices, null models and score lists as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sequences import read_fasta


def _long(df: DataFrame) -> DataFrame:
    """(seq_id, weight, col, symbol) from one row (seq_id, weight, row) per sequence."""
    return df.select("seq_id", "weight", F.posexplode(F.split("row", "")).alias("p", "symbol")).where("symbol != ''").select("seq_id", "weight", (F.col("p") + 1).alias("col"), "symbol")


def read_msa(spark: SparkSession, path: str) -> DataFrame:
    """An aligned FASTA: gaps '-' or '.', weights from 'weight=' in headers, else 1."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    weight = F.coalesce(F.nullif(F.regexp_extract(parts[0], r"weight=(\S+)", 1), F.lit("")).cast("double"), F.lit(1.0))
    return _long(raw.select(F.regexp_extract(parts[0], r"^(\S+)", 1).alias("seq_id"), weight.alias("weight"), F.translate(F.regexp_replace(parts[1], r"\s", ""), ".", "-").alias("row")))


def read_msf(spark: SparkSession, path: str) -> DataFrame:
    """GCG/MSF alignments: names and weights, then blocks of rows, joined by name in file order; each file is one row to begin with, its lines are dealt out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\n//", 2).alias("part"))
    named = r"Name:\s+(\S+)[^\n]*?Weight:\s+(\S+)"
    head = F.arrays_zip(F.regexp_extract_all(F.col("part")[0], F.lit(named), F.lit(1)).alias("name"), F.regexp_extract_all(F.col("part")[0], F.lit(named), F.lit(2)).alias("weight"))
    names = raw.select("file", F.inline(head)).groupBy("file", "name").agg(F.max(F.col("weight").cast("double")).alias("weight"))
    lines = raw.select("file", F.posexplode(F.split(F.coalesce(F.get("part", F.lit(1)), F.lit("")), "\n")).alias("at", "line"))
    parts = lines.select("file", F.regexp_extract(F.trim("line"), r"^(\S+)", 1).alias("name"), "at", F.regexp_replace(F.regexp_extract(F.trim("line"), r"^\S+\s+(.*)$", 1), r"\s", "").alias("text"))
    rows = parts.where("name != ''").groupBy("file", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "").alias("row"))
    made = names.join(rows, ["file", "name"], "left").select(F.col("name").alias("seq_id"), "weight", F.translate(F.coalesce("row", F.lit("")), ".~", "--").alias("row"))
    return _long(made)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, score) from a triangular matrix: the letters stand last in each row, rows shorten from the left."""
    lines = [r.value.split() for r in spark.read.text(path).collect()]
    rows = [(x[-1], [float(v) for v in x[:-1]]) for x in lines if len(x) > 1 and len(x[-1]) == 1 and x[-1].isalpha() and all(re.fullmatch(r"-?\d+(\.\d*)?", v) for v in x[:-1])]
    letters, out = [a for a, _ in rows], {}
    for k, (a, values) in enumerate(rows):
        others = letters[k : k + len(values)] if len(values) <= len(letters) - k else letters[: len(values)]
        for b, v in zip(others, values, strict=False):
            out[a, b] = out[b, a] = v
    return spark.createDataFrame([(a, b, v) for (a, b), v in out.items()], "a string, b string, score double")


def read_null_model(spark: SparkSession, path: str) -> dict[str, float]:
    """Residue frequencies, for the twenty letters in the usual order unless the file has four."""
    values = [float(v) for r in spark.read.text(path).collect() for v in r.value.split("#")[0].split() if re.fullmatch(r"\d*\.\d+", v)]
    return dict(zip("ACGT" if len(values) == 4 else "ACDEFGHIKLMNPQRSTVWY", values, strict=False))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """(score): the first field of each line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].cast("double").alias("score")).where("score IS NOT NULL")


def read_xpsa(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, begin, end, fields, aligned) of matches with keyword=value headers."""
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    parts = F.split(F.regexp_replace("value", "^>", ""), "\n", 2)
    pairs = F.regexp_extract_all(parts[0], F.lit(r"(\w+=\S+)"), F.lit(1))
    fields = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.substring_index(p, "=", -1)))))
    return raw.select(F.regexp_extract(parts[0], r"^(\S*)/\d+-\d+", 1).alias("seq_id"), F.regexp_extract(parts[0], r"/(\d+)-", 1).cast("int").alias("begin"), F.regexp_extract(parts[0], r"/\d+-(\d+)", 1).cast("int").alias("end"), fields.alias("fields"), F.regexp_replace(parts[1], r"\s", "").alias("aligned"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Hits of an earlier run: seq_id, motif_ac, begin, end, norm, level, level_tag."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#"))
    c = F.split("value", "\t")
    at = lambda key: F.nullif(F.regexp_extract(F.coalesce(F.get(c, 8), F.lit("")), rf'{key}[ =]"?([^";]*)"?', 1), F.lit(""))
    return raw.select(c[0].alias("seq_id"), F.get(c, 2).alias("motif_ac"), F.get(c, 3).cast("int").alias("begin"), F.get(c, 4).cast("int").alias("end"), F.try_to_number(F.get(c, 5), F.lit("999999D999")).cast("double").alias("norm"), at("Level").cast("int").alias("level"), at("LevelTag").alias("level_tag"))


__all__ = ["read_fasta", "read_gff", "read_matrix", "read_msa", "read_msf", "read_null_model", "read_scores", "read_xpsa"]
