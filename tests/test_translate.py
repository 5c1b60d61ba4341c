"""Translation against a plain program, and of a text too long for a function call a codon."""

import random

from pyspark.sql import functions as F

from motifloom.functions import letters


def plain(seq, step, start):
    table = {a + b + c: letters.CODONS[16 * i + 4 * j + k] for i, a in enumerate("ACGT") for j, b in enumerate("ACGT") for k, c in enumerate("ACGT")}

    def amino(codon):
        four = {table.get(codon[:2] + x, "X") for x in "ACGT"}
        return table.get(codon) or (four.pop() if len(four) == 1 else "X")

    return "".join(amino(seq[i : i + 3]) for i in range(start - 1, len(seq) - 2, step))


def test_equals_plain(spark):
    rng = random.Random(1)
    seqs = [None, "", "A", "AC", "ACG", "é", "ACé", "aCGT", "字ACGTGC"] + ["".join(rng.choices("ACGTNé", [5, 5, 5, 5, 1, 0.2], k=rng.randrange(0, 40))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(seqs)), "k int, s string").repartition(2)
    got = df.select("k", letters.translate_frames(F.col("s")).alias("three"), letters.translate_frames(F.col("s"), 1, (1, 2))[1].alias("one")).collect()
    for r in got:
        seq = seqs[r.k] or ""
        assert r.three == [plain(seq, 3, f) for f in (1, 2, 3)] and r.one == plain(seq, 1, 2), seq


def test_long_text(spark):
    """A million letters: seconds, where one call of a function a codon took time with the square of the length."""
    df = spark.range(1).select(F.repeat(F.lit("ACGTTGCA"), 131_072).alias("s"))
    a, b, c = df.select(letters.translate_frames(F.col("s"))).first()[0]
    whole = "ACGTTGCA" * 131_072
    assert (a[:8], len(a), len(b), len(c)) == (plain(whole[:24], 3, 1), 349_525, 349_525, 349_524) and b[-8:] == plain(whole[1:], 3, 1)[-8:]
