"""Random and shuffled sequences; the same for the same seed, whatever the partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K


def emit(spark: SparkSession, profile: K.Profile, n: int, seed: int = 1, scale: float = 0.02) -> DataFrame:
    """n sequences sampled from a profile: (seq_id, sequence)."""

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"seq_id": [f"emit_{i + 1}" for i in pdf["id"]], "sequence": [K.sample(profile, np.random.default_rng([seed, i]), scale) for i in pdf["id"]]})

    return spark.range(n).mapInPandas(step, "seq_id string, sequence string")


def mutants(df: DataFrame, alphabet: str, distances: list[int], copies: int = 1, seed: int = 1, key: str = "seq_id") -> DataFrame:
    """(key, events, copy, sequence): copies of each sequence after so many random events."""
    each = df.select(F.col(key).cast("string").alias(key), "sequence").withColumn("events", F.explode(F.array(*map(F.lit, distances))))
    each = each.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    each = each.withColumn("_seed", F.xxhash64(F.lit(seed), key, "events", "copy"))

    def step(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["sequence"] = [K.mutate(s or "", alphabet, int(e), np.random.default_rng(int(u) & (1 << 63) - 1)) for s, e, u in zip(pdf["sequence"], pdf["events"], pdf["_seed"], strict=True)]
            yield pdf.drop(columns="_seed")

    return each.mapInPandas(step, f"`{key}` string, sequence string, events int, copy int")


METHODS = ("permutation", "window", "codon", "reverse", "corrupt", "bubble", "scramble", "sample", "rubble", "spoil", "comb")


def randomized(df: DataFrame, method: str, seed: int = 1, width: int = 20, rate: float = 0.1, key: str = "seq_id", copies: int = 1, frequencies: dict[str, float] | None = None, phase: int = 0) -> DataFrame:
    """df with randomised sequences, ``copies`` of each (then with their number, copy), the same for a seed.

    'permutation' of all letters, 'window' of the letters of each stretch of
    ``width``, 'codon' of triplets, 'rubble' of whole stretches (a rest that
    fills none is left out); 'reverse'; 'scramble': all letters drawn anew;
    'corrupt': letters drawn anew at a rate; 'comb': those at place ``phase`` of
    every ``width`` become another letter, in lower case; 'bubble': neighbours
    change places at a rate; 'spoil': letters are taken out at a rate and put in
    elsewhere; 'sample': a stretch of ``width`` letters (all of a shorter sequence),
    with begin and end. Letters are drawn by ``frequencies``, or the sequence's own.
    """
    if method not in METHODS:
        raise ValueError(method)
    if copies != 1:
        df = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    if method == "reverse":
        return df.withColumn("sequence", F.reverse("sequence"))
    letters = np.array(list(frequencies or ""))
    share = np.array(list((frequencies or {}).values()), float)
    share = share / share.sum() if len(share) else None

    def drawn(rng: np.random.Generator, own: np.ndarray, n: int) -> np.ndarray:
        return rng.choice(letters, n, p=share) if len(letters) else rng.choice(own, n) if len(own) else own[:0]

    def one(seq: str, rng: np.random.Generator) -> tuple[str, int]:
        a, begin = np.array(list(seq), "U1"), 0
        if method == "permutation":
            rng.shuffle(a)
        elif method == "window":
            for i in range(0, len(a), width):
                rng.shuffle(a[i : i + width])
        elif method in ("codon", "rubble"):
            size = 3 if method == "codon" else width
            whole = len(a) // size * size
            t = a[:whole].reshape(-1, size).copy()
            rng.shuffle(t)
            a = np.concatenate([t.ravel(), a[whole:] if method == "codon" else a[:0]])
        elif method == "scramble":
            a = drawn(rng, a, len(a))
        elif method == "corrupt":
            at = rng.random(len(a)) < rate
            a[at] = drawn(rng, a, int(at.sum()))
        elif method == "comb":
            pool = letters if len(letters) else np.unique(a)
            for i in range(phase % width, len(a), width):
                other = pool != a[i]
                if other.any():
                    chance = share[other] / share[other].sum() if share is not None else None
                    a[i] = str(rng.choice(pool[other], p=chance)).lower()
        elif method == "spoil":
            rest = a.tolist()
            for _ in range(int(len(rest) * rate) if len(rest) > 1 else 0):
                letter = rest.pop(int(rng.integers(len(rest))))
                rest.insert(int(rng.integers(len(rest) + 1)), letter)
            a = np.array(rest, "U1")
        elif method == "sample":
            begin = int(rng.integers(max(0, len(a) - width) + 1))
            a = a[begin : begin + width]
        else:
            for i in np.flatnonzero(rng.random(max(0, len(a) - 1)) < rate):
                a[[i, i + 1]] = a[[i + 1, i]]
        return "".join(a), begin + 1

    @F.pandas_udf("struct<sequence: string, begin: int>")
    def shuffled(seqs: pd.Series, seeds: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if s is None else one(s, np.random.default_rng(int(u) & (1 << 63) - 1)) for s, u in zip(seqs, seeds, strict=True)], columns=["sequence", "begin"]).astype({"begin": "Int32"})

    own: Column = F.xxhash64(F.lit(seed), F.col(key).cast("string"), *(["copy"] if copies != 1 else []))
    made = df.withColumn("_made", shuffled("sequence", own)).withColumn("sequence", F.col("_made.sequence"))
    if method == "sample":
        made = made.withColumns({"begin": F.col("_made.begin"), "end": F.col("_made.begin") + F.length("sequence") - 1})
    return made.drop("_made")


def subset(df: DataFrame, n: int, seed: int = 1, key: str = "seq_id") -> DataFrame:
    """n records without replacement, by a hash of the key: a top-n, not a full sort."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(n)
