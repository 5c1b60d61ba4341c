"""Motifs as rows: searches of two tables, and table functions for SQL.

A motif is a row with its accession and its entry's text; entries are parsed
where they are used, in tasks, once a worker. Blocks of motifs meet blocks of
sequences by their numbers, so neither side is in a closure or a broadcast and
a group has a bounded share of both.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from ..functions import patterns
from ..sources import motifs as source
from . import kernels as K
from . import search as S

#: Letters of sequences, and of entries' texts, in a block, about.
SEQUENCE_BLOCK, MOTIF_BLOCK = 8 << 20, 16 << 20


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """(ac, text): the entries of a database that have a profile, as they stand."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.concat(F.lit("\n"), F.ltrim("value"), F.lit("\n//")).alias("text"))
    kept = raw.where(F.col("text").rlike("\nID ") & F.col("text").contains("\nMA "))
    return kept.select(F.regexp_extract("text", r"\nAC\s+([^;\n]*)", 1).alias("ac"), F.ltrim("text").alias("text"))


@lru_cache(maxsize=4096)
def motif_of(text: str, level: int = 0, use_prefilter: bool = True) -> S.Motif:
    """The motif of an entry's text, with the cutoffs of a level (an error if it has none)."""
    e = source.parse(text.replace("\n//", "").strip("\n"))
    cut = next((c for c in e.cutoffs if c["level"] == level), None)
    if e.profile is None or cut is None:
        raise ValueError(f"entry {e.ac} has no profile, or no cutoff of level {level}")
    h = cut.get("h_score") if use_prefilter and not e.profile.circular else None
    return S.Motif(e.profile, cut["score"], h, e.ac)


def search_table(df: DataFrame, motifs: DataFrame, key: str = "seq_id", column: str = "sequence", level: int = 0, align: bool = True, limit: int | None = None) -> DataFrame:
    """``search.search`` with the motifs of a table (ac, text).

    Each block of sequences is met by each block of motifs: sequences are
    shuffled as often as there are blocks of motifs, and the other way round. Motifs
    of one accession count each; null and empty sequences have no match.
    """
    letters = df.agg(F.sum(F.length(column))).first()[0] or 0
    size = motifs.agg(F.sum(F.length("text"))).first()[0] or 0
    rows, cols = max(1, -(-letters // SEQUENCE_BLOCK)), max(1, -(-size // MOTIF_BLOCK))
    part = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = df.select(F.col(key).alias("_key"), F.col(column).alias("_sequence"), part(key, rows).alias("_row"), every(cols).alias("_col"))
    right = motifs.select("text", part("ac", cols).alias("_col"), every(rows).alias("_row"))
    kind = T._parse_datatype_string(f"`{key}` {df.schema[key].dataType.simpleString()}, {S.HIT}")

    def meet(seqs: pa.Table, entries: pa.Table) -> pa.Table:
        own = sorted((motif_of(x, level) for x in entries.column("text").to_pylist()), key=lambda m: m.ac)
        batches = seqs.select(["_key", "_sequence"]).rename_columns([key, "_sequence"]).to_batches()
        found = list(S._search(own, align, limit)(iter(batches))) if own else []
        return pa.Table.from_batches(found) if found else pa.table({f.name: pa.nulls(0, t) for f, t in zip(kind.fields, [seqs.schema.field("_key").type, pa.string(), *[pa.int32()] * 7, pa.string()], strict=True)})

    return left.groupBy("_row", "_col").cogroup(right.groupBy("_row", "_col")).applyInArrow(meet, kind)


@lru_cache(maxsize=4096)
def pattern_of(pattern: str) -> re.Pattern:
    return re.compile(patterns.to_regex(pattern))


class MotifMatches:
    """SQL: motif_matches(sequence, entry's text, level)."""

    def eval(self, sequence: str, text: str, level: int) -> Iterator[tuple]:
        if sequence and text:
            motif = motif_of(text, level)
            p = motif.profile
            codes = p.encode(sequence)
            if motif.h_cutoff is None or K.h_scores(p, codes, np.array([0, len(codes)]))[0] >= motif.h_cutoff:
                for n, m in enumerate(K.matches(p, codes, sequence, motif.cutoff), 1):
                    yield motif.ac, n, m.begin, m.end, m.motif_start, m.motif_end, m.score, m.aligned


class PatternMatches:
    """SQL: pattern_matches(sequence, pattern)."""

    def eval(self, sequence: str, pattern: str) -> Iterator[tuple]:
        if sequence and pattern:
            for n, (begin, end) in enumerate(patterns.places(sequence, pattern_of(pattern)), 1):
                yield n, begin + 1, end, sequence[begin:end]


def register(spark: SparkSession) -> None:
    """Makes the table functions known to SQL, for LATERAL joins over sequences and motifs."""
    spark.udtf.register("motif_matches", udtf(MotifMatches, returnType="motif_ac string, match_no int, begin int, end int, motif_start int, motif_end int, raw_score int, aligned string"))
    spark.udtf.register("pattern_matches", udtf(PatternMatches, returnType="match_no int, begin int, end int, matched string"))
