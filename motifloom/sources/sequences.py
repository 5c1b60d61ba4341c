"""Sequence libraries: FASTA, FASTQ, EMBL and Swiss-Prot text as DataFrames.

Columns: seq_id, description, header, sequence, and by format accession or
quality. Files are split at record separators by the text source, so a large
file is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.letters import clean, header_description, header_id


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records from '>' at a line's begin to the next; the first line is the header, letters of the others the sequence."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    body = F.regexp_replace("value", "^>", "")
    parts = F.split(body, "\n", 2)
    header = F.regexp_replace(parts[0], r"\s+$", "")
    rows = raw.where(F.trim("value") != "").select(header.alias("header"), clean(F.coalesce(F.get(parts, 1), F.lit(""))).alias("sequence"))
    return rows.select(header_id(F.col("header")).alias("seq_id"), header_description(F.col("header")).alias("description"), "header", "sequence")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """Records of '@' header, sequence lines, '+' line and one quality line, which may begin with '@' itself.

    The text source cuts files at each line that begins with '@', so a large file
    is many tasks' work and a record may have any number of lines. What begins so
    is a record if it has a '+' line, else the quality of the record before; a
    record without its quality where a split ends gets it from the next split of
    its file, which meet by a window over the splits' ends only (two rows a split).
    """
    raw = spark.read.option("lineSep", "\n@").text(path)
    pieces = raw.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = pieces.mapInArrow(_fastq_pieces, "kind string, file string, block long, header string, sequence string, quality string")
    open_ = rows.where("kind != 'record'").withColumn("next", F.lead(F.struct("kind", "quality")).over(W.partitionBy("file").orderBy("block", F.col("kind") == "tail")))
    late = open_.where("kind = 'tail'").withColumn("quality", F.when(F.col("next.kind") == "head", F.col("next.quality")).otherwise("")).drop("next")
    every = rows.where("kind = 'record'").unionByName(late)
    header = F.concat(F.lit("@"), "header")
    return every.select(header_id(header).alias("seq_id"), header_description(header).alias("description"), header.alias("header"), clean(F.col("sequence")).alias("sequence"), "quality")


def _fastq_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split, the quality that its first record lacks in the split before (head), and a last record without quality (tail)."""
    names = ["kind", "file", "block", "header", "sequence", "quality"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out, size, at, waiting = [], 0, None, None

    def put(kind, header, sequence, quality):
        nonlocal size
        out.append((kind, *at, header, sequence, quality))
        size += len(sequence or "") + len(quality or "")

    def pack():
        nonlocal size
        made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        size = 0
        return made

    for batch in batches:
        for value, *place in zip(*(batch.column(c) for c in ("value", "file", "block")), strict=True):
            place = [x.as_py() for x in place]
            if place != at:
                if waiting:
                    put("tail", *waiting, None)
                at, waiting, first = place, None, True
            piece = value.as_py().replace("\r", "")
            if first and at[1] == 0:
                piece = piece.lstrip("\n").removeprefix("@")
            lines = piece.split("\n")
            plus = next((k for k, x in enumerate(lines) if k and x[:1] == "+"), None)
            if plus is None:
                text = "@" + lines[0]
                if waiting:
                    put("record", *waiting, text)
                elif first and at[1]:
                    put("head", None, None, text)
                waiting = None
            else:
                if waiting:  # it has no quality at all
                    put("record", *waiting, "")
                waiting = lines[0], "".join(lines[1:plus])
                if plus + 1 < len(lines):
                    put("record", *waiting, lines[plus + 1])
                    waiting = None
            first = False
            if size > 1 << 22 or len(out) > 10_000:
                yield pack()
    if waiting:
        put("tail", *waiting, None)
    if out:
        yield pack()


def read_flat(spark: SparkSession, path: str) -> DataFrame:
    """EMBL and Swiss-Prot entries: ID, first AC, joined DE and the letters after SQ."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.concat(F.lit("\n"), F.ltrim("value")).alias("r")).where(F.col("r").rlike("\nID "))
    lines = lambda code: F.array_join(F.transform(F.regexp_extract_all("r", F.lit(rf"\n{code}\s+([^\n]*)"), F.lit(1)), lambda x: F.trim(x)), " ")
    seq = F.regexp_extract("r", r"(?s)\nSQ [^\n]*\n(.*)$", 1)
    return raw.select(
        F.regexp_extract("r", r"\nID\s+([^\s;]+)", 1).alias("seq_id"), F.regexp_extract("r", r"\nAC\s+([^\s;]+)", 1).alias("accession"), lines("DE").alias("description"),
        F.regexp_extract("r", r"\n(ID[^\n]*)", 1).alias("header"), clean(seq).alias("sequence"),
    )


READERS = {"fasta": read_fasta, "fastq": read_fastq, "embl": read_flat}


def read(spark: SparkSession, path: str, kind: str = "fasta", ids: list[str] | None = None, header: str | None = None) -> DataFrame:
    """Any format; only given ids, or headers that match a regular expression."""
    df = READERS[kind](spark, path)
    df = df.where(F.col("seq_id").isin(ids)) if ids is not None else df
    return df.where(F.col("header").rlike(header)) if header else df


def build_index(spark: SparkSession, path: str, index: str, kind: str = "fasta") -> None:
    """The library as Parquet sorted by id, with the size and time of the files it was made from."""
    files = spark.read.format("binaryFile").load(path).agg(F.sum("length"), F.max("modificationTime").cast("long")).first()
    df = READERS[kind](spark, path).withColumns({"header_len": F.length("header"), "seq_len": F.length("sequence"), "source_size": F.lit(files[0]), "source_time": F.lit(files[1])})
    df.sort("seq_id").write.mode("overwrite").parquet(index)


def read_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The indexed library; an error if the files have changed since."""
    files = spark.read.format("binaryFile").load(path).agg(F.sum("length"), F.max("modificationTime").cast("long")).first()
    df = spark.read.parquet(index)
    made = df.select("source_size", "source_time").first()
    if made is not None and tuple(made) != tuple(files):
        raise ValueError("the library has changed since it was indexed")
    return df.drop("source_size", "source_time")


def random_library(spark: SparkSession, n: int, length: int, frequencies: dict[str, float], seed: int = 1) -> DataFrame:
    """n random sequences of a length, letters by frequency; the same for the same seed and n."""
    total, bound, letter = sum(frequencies.values()), 0.0, F.lit(list(frequencies)[-1])
    steps = []
    for a, f in frequencies.items():
        bound += f / total
        steps.append((bound, a))
    letter = lambda u: _step(u, steps)
    u = lambda i: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(1 << 40)) / float(1 << 40))
    seq = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: letter(u(i))), "")
    return spark.range(n).select(F.concat(F.lit("rand_"), F.col("id") + 1).alias("seq_id"), seq.alias("sequence"))


def _step(u, steps):
    out = F.lit(steps[-1][1])
    for bound, a in reversed(steps[:-1]):
        out = F.when(u < bound, F.lit(a)).otherwise(out)
    return out


def fasta_text(df: DataFrame, width: int = 60) -> DataFrame:
    """One text column: FASTA records wrapped to a width, for ``write.text``."""
    from ..functions.letters import wrap

    head = F.concat(F.lit(">"), F.col("seq_id"), F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""))
    return df.select(F.concat_ws("\n", head, wrap(F.col("sequence"), width)).alias("value"))


def fastq_text(df: DataFrame) -> DataFrame:
    """FASTQ records; a periodic quality where there is none."""
    from ..functions.letters import periodic_quality

    quality = F.coalesce(F.col("quality"), periodic_quality(F.length("sequence"))) if "quality" in df.columns else periodic_quality(F.length("sequence"))
    return df.select(F.concat(F.lit("@"), "seq_id", F.lit("\n"), "sequence", F.lit("\n+\n"), quality).alias("value"))


def sorted_library(df: DataFrame, reverse: bool = False, degap: bool = False, upper: bool = False, complement: bool = False, short_header: bool = False) -> DataFrame:
    """Sorted by header; records of one header are joined in order of their sequence.

    First, as asked for: headers cut at the first blank; sequences without gap
    marks, in upper case, complemented, reversed.
    """
    from ..functions import letters

    s = F.col("sequence")
    s = F.regexp_replace(s, "[.~ -]", "") if degap else s
    s = F.upper(s) if upper else s
    s = letters.complement(s) if complement else s
    s = F.reverse(s) if reverse else s
    header = F.regexp_extract("header", r"^(\S*)", 1) if short_header else F.col("header")
    df = df.select(header.alias("header"), s.alias("sequence"))
    return df.groupBy("header").agg(F.array_join(F.array_sort(F.collect_list("sequence")), "").alias("sequence")).orderBy("header")
