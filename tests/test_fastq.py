"""FASTQ over many splits, long records, qualities that begin with '@'."""

import numpy as np

from motifloom.sources import sequences


def plain(text):
    """Records in file order, line by line: the quality line is the one after '+'."""
    lines, k, out = text.replace("\r", "").split("\n"), 0, []
    while k < len(lines):
        if not lines[k].startswith("@"):
            k += 1
            continue
        header, k, seq = lines[k], k + 1, ""
        while not lines[k].startswith("+"):
            seq, k = seq + lines[k], k + 1
        out.append((header, seq, lines[k + 1]))
        k += 2
    return out


def made(rng, n, ends="\n"):
    text = ""
    for k in range(n):
        size = int(rng.integers(1, 90))
        seq = "".join(rng.choice(list("ACGT"), size))
        quality = "".join(rng.choice(list("@+!I>A"), size))
        width = int(rng.integers(7, 60))
        text += f"@read{k} some{k}{ends}" + "".join(seq[i : i + width] + ends for i in range(0, size, width)) + f"+{'read' if k % 3 else ''}{ends}{quality}{ends}"
    return text


def rows(df):
    return sorted((r.header, r.sequence, r.quality) for r in df.collect())


def test_many_splits(spark, tmp_path):
    rng = np.random.default_rng(3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for k, size in enumerate(("97b", "1000b", "1g")):
            path = tmp_path / f"{k}"
            path.mkdir()
            texts = [made(rng, 60), made(rng, 40, "\r\n"), made(rng, 1).rstrip("\n"), ""]
            for i, text in enumerate(texts):
                (path / f"{i}.fastq").write_text(text, newline="")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            df = sequences.read(spark, str(path), "fastq")
            assert k or df.rdd.getNumPartitions() > 50
            assert rows(df) == sorted(r for t in texts for r in plain(t))
            assert {r.seq_id for r in df.collect()} >= {"read0", "read39"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_record_of_many_lines(spark, tmp_path):
    """100 MB of sequence in lines of 80: no recursion, one value."""
    n = 1_250_000
    (tmp_path / "long.fastq").write_text("@long one\n" + ("ACGT" * 20 + "\n") * n + "+\n@" + "I" * 99 + "\n@short\nAC\n+\nII\n")
    got = {r.seq_id: (r.n, r.q) for r in sequences.read_fastq(spark, str(tmp_path)).selectExpr("seq_id", "length(sequence) AS n", "length(quality) AS q").collect()}
    assert got == {"long": (80 * n, 100), "short": (2, 2)}


def test_fasta_with_carriage_returns(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a one\r\nACGT\r\nAC\r\n>b\r\nGG\r\n", newline="")
    got = sorted((r.seq_id, r.header, r.description, r.sequence) for r in sequences.read_fasta(spark, str(tmp_path)).collect())
    assert got == [("a", "a one", "one", "ACGTAC"), ("b", "b", "", "GG")]
