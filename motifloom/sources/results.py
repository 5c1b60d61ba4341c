"""Results as text: one column ``value`` for ``write.text``, by format number or name.

Hits carry motif_ac, motif_id, motif_desc, seq_id, seq_desc, seq_len, match_no,
strand, begin, end, motif_start, motif_end, raw_score, norm_score, level,
level_tag, aligned; places are those of the forward strand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.letters import cigar, quality_slice, ungapped, wrap


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _place() -> Column:
    return F.format_string("%8.3f %7d pos. %7d - %7d", "norm_score", "raw_score", "begin", "end")


def _range() -> Column:
    return F.format_string("[%5d, %5d]", "motif_start", "motif_end")


def _full() -> Column:
    return F.concat_ws(" ", "seq_id", F.nullif(_text("seq_desc"), F.lit("")))


def _with_alignment(head: Column, width: int) -> Column:
    return F.concat_ws("\n", head, wrap(F.col("aligned"), width))


def default(width: int = 60) -> Column:
    name = F.when(F.col("strand") != "+", F.concat("seq_id", F.lit("(-)"))).otherwise(F.col("seq_id"))
    return F.concat_ws(" ", _place(), name, F.nullif(_text("seq_desc"), F.lit("")))


def level_header(width: int = 60) -> Column:
    return _with_alignment(F.concat(F.lit("> L="), "level", F.lit(" "), _place(), F.lit(" "), _range(), F.lit("  "), _full()), width)


def region_header(width: int = 60) -> Column:
    head = F.format_string(">%s/%d-%d motif=%s|%s norm_score=%.3f raw_score=%d seq_end=%d motif_start=%d motif_end=%d", "seq_id", "begin", "end", "motif_ac", "motif_id", "norm_score", "raw_score", F.col("end") - F.col("seq_len") - 1, "motif_start", "motif_end")
    return _with_alignment(head, width)


def place_header(width: int = 60) -> Column:
    return _with_alignment(F.concat(F.lit("> "), _place(), F.lit("  "), _full()), width)


def motif_header(width: int = 60) -> Column:
    return _with_alignment(F.concat(F.lit(">"), "motif_id", F.lit(" L="), "level", F.lit(" "), _place(), F.lit(" "), _range(), F.lit(" "), "motif_ac", F.lit("|"), _text("motif_desc")), width)


def level_line(width: int = 60) -> Column:
    return F.concat(F.lit("L="), "level", F.lit(" "), _place(), F.lit(" "), "motif_ac", F.lit("|"), "motif_id", F.lit(" "), _text("motif_desc"))


def xpsa(width: int = 60) -> Column:
    head = F.format_string(
        ">%s/%d-%d motif=%s|%s norm_score=%.3f raw_score=%d level=%d level_tag=%s motif_start=%d motif_end=%d seq_end=%d strand=%s",
        "seq_id", "begin", "end", "motif_ac", "motif_id", "norm_score", "raw_score", "level", "level_tag", "motif_start", "motif_end", F.col("end") - F.col("seq_len") - 1, "strand",
    )
    return _with_alignment(head, width)


def tsv(width: int = 60) -> Column:
    return F.format_string("%s|%s\t%d\t%d\t%s\t%d\t%d\t%d\t%f\t%s\t%s", "motif_ac", "motif_id", "motif_start", "motif_end", "seq_id", "begin", "end", "raw_score", "norm_score", "strand", "aligned")


def sam(width: int = 60) -> Column:
    """SAM 1.6: the motif is the reference, its positions the places; QUAL where the hits have the record's quality."""
    part = quality_slice(F.col("quality"), F.col("begin"), F.col("end"))
    part = F.when(F.col("strand") == "-", F.reverse(part)).otherwise(part)
    spanned = F.length(F.regexp_replace("aligned", "[a-z]", ""))
    flag = F.when(F.col("strand") == "-", "18").otherwise("2")
    fields = [F.substring_index("seq_id", "|", -1), flag, F.concat("motif_ac", F.lit("|"), "motif_id"), F.col("motif_start").cast("string"), F.lit("255"), cigar(F.col("aligned")), F.lit("*"), F.lit("0"), spanned.cast("string"), ungapped(F.col("aligned")), F.coalesce(part, F.lit("*"))]
    return F.concat_ws("\t", *fields, F.concat(F.lit("AS:i:"), "raw_score"), F.format_string("NS:f:%.2f", F.coalesce(F.col("norm_score").cast("double"), F.lit(0.0))))


def family(width: int = 60) -> Column:
    return F.concat_ws("\t", "seq_id", "motif_ac", F.col("raw_score").cast("string"))


def _quoted(column: str) -> Column:
    """A string literal of Turtle: backslash, quote and line ends escaped."""
    s = F.coalesce(F.col(column).cast("string"), F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), s, F.lit('"'))


#: The line before all Turtle records.
TURTLE_PREFIX = "@prefix : <urn:motif-match:> ."


def turtle(width: int = 60) -> Column:
    return F.concat(F.lit("[] a :Match ; :sequence "), _quoted("seq_id"), F.lit(" ; :motif "), _quoted("motif_ac"), F.lit(" ; :begin "), "begin", F.lit(" ; :end "), "end", F.lit(" ; :score "), F.format_string("%.3f", "norm_score"), F.lit(" ."))


def gff(width: int = 60) -> Column:
    return F.concat_ws("\t", "seq_id", F.lit("motifloom"), "motif_ac", F.col("begin").cast("string"), F.col("end").cast("string"), F.format_string("%.3f", "norm_score"), "strand", F.lit("."), F.concat(F.lit('Name "'), "motif_id", F.lit('" ; Level '), "level", F.lit(' ; RawScore '), "raw_score", F.lit(' ; LevelTag "'), "level_tag", F.lit('"')))


def pff(width: int = 60) -> Column:
    return F.concat_ws("\t", "seq_id", F.col("begin").cast("string"), F.col("end").cast("string"), "motif_ac", F.col("motif_start").cast("string"), F.col("motif_end").cast("string"), F.col("raw_score").cast("string"), F.format_string("%.3f", "norm_score"), F.col("level").cast("string"))


def _matched() -> Column:
    return F.regexp_replace(F.coalesce("aligned", F.lit("")), r"\s", "")


def epff(width: int = 60) -> Column:
    """``pff`` with the level's tag, if there is one, in place of the level, and what matched as a last field."""
    fields = ["seq_id", *(F.col(c).cast("string") for c in ("begin", "end")), F.col("motif_ac"), *(F.col(c).cast("string") for c in ("motif_start", "motif_end", "raw_score")), F.format_string("%.3f", "norm_score"), F.coalesce("level_tag", F.col("level").cast("string")), _matched()]
    return F.concat_ws("\t", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in fields))


def _level_mark() -> Column:
    return F.coalesce(F.concat(F.lit("L="), F.coalesce("level_tag", F.col("level").cast("string"))), F.lit(""))


def fasta_hit(width: int = 60) -> Column:
    """A FASTA record of each match: its letters, without gaps."""
    head = F.concat(F.lit(">"), "seq_id", F.lit("/"), "begin", F.lit("-"), "end", F.lit(" : "), "motif_ac", F.lit(" "), F.coalesce("motif_id", F.lit("")), F.lit(" "), _level_mark())
    return F.concat(F.rtrim(head), F.lit("\n"), wrap(ungapped(_matched()), width))


def aligned_hit(width: int = 60) -> Column:
    """As ``fasta_hit``, with the aligned string, which has one letter or gap for each profile position."""
    return F.concat(F.substring_index(fasta_hit(width), "\n", 1), F.lit("\n"), wrap(_matched(), width))


FORMATS = {0: default, 1: level_header, 2: region_header, 3: place_header, 4: motif_header, 5: level_line, 6: xpsa, 7: tsv, 8: sam, 9: family, 10: turtle, "gff": gff, "pff": pff, "epff": epff, "fasta": fasta_hit, "psa": aligned_hit, "msa": aligned_hit}


def formatted(hits: DataFrame, kind: int | str = 6, width: int = 60) -> DataFrame:
    """One row of text for each hit; quality, strand and normalised score may be missing."""
    defaults = {"quality": F.lit(None).cast("string"), "strand": F.lit("+"), "norm_score": F.lit(None).cast("double"), "level": F.lit(None).cast("int"), "level_tag": F.lit(None).cast("string")}
    hits = hits.withColumns({k: v for k, v in defaults.items() if k not in hits.columns})
    return hits.select(FORMATS[kind](width).alias("value"))


def scan_text(hits: DataFrame, width: int = 60) -> DataFrame:
    """A text for each sequence and motif: a header line, and for each match its places, its letters in lines of a width, and its level.

    Hits without a motif_id or motif_desc have blanks there. Matches are in order.
    """
    for c in ("motif_id", "motif_desc", "level_tag"):
        hits = hits if c in hits.columns else hits.withColumn(c, F.lit(None).cast("string"))
    hits = hits if "level" in hits.columns else hits.withColumn("level", F.lit(None).cast("int"))
    mark = F.when(_level_mark() != "", F.concat(F.lit(" "), _level_mark())).otherwise("")
    lines = F.regexp_extract_all(_matched(), F.lit(f".{{1,{width}}}"), F.lit(0))
    shown = F.transform(lines, lambda x, k: F.concat(F.when(k == 0, "").otherwise(" "), F.when(mark == "", x).otherwise(F.rpad(x, width, " ")), mark))
    places = F.lpad(F.concat("begin", F.lit(" - "), "end"), 13, " ")
    one = F.struct("begin", "end", F.concat(places, F.lit("  "), F.array_join(shown, "\n")).alias("text"))
    head = F.concat(F.lit(">"), "seq_id", F.lit(" : "), "motif_ac", F.lit(" "), F.coalesce("motif_id", F.lit("")), F.lit(" "), F.coalesce("motif_desc", F.lit("")))
    per = hits.withColumn("_head", F.rtrim(head)).groupBy("seq_id", "motif_ac", "_head").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    return per.select("seq_id", "motif_ac", F.concat_ws("\n", "_head", F.transform("_all", lambda x: x["text"])).alias("value"))


def hit_sequences(hits: DataFrame, library: DataFrame, width: int = 60) -> DataFrame:
    """The whole sequence, as FASTA text, once for each motif that has a hit in it."""
    named = hits.select("seq_id", "motif_ac").distinct()
    head = F.concat(F.lit(">"), "seq_id", F.lit(" : "), F.coalesce("description", F.lit("")), F.lit(" : "), "motif_ac")
    return library.join(named, "seq_id").select("seq_id", "motif_ac", F.concat(head, F.lit("\n"), wrap(F.col("sequence"), width)).alias("value"))


def match_list(hits: DataFrame) -> DataFrame:
    """(motif_id, part, seq_ac, value): for each pattern its name, a line for each sequence with the number of its matches, and the totals.

    Sorted by the first three columns the values are the list; parts are 0, 1, 2.
    """
    per = hits.groupBy("motif_id", "seq_ac", "seq_id").agg(F.count("*").alias("n"))
    line = F.concat(F.rpad("seq_ac", 6, " "), F.lit(", "), F.rpad("seq_id", 10, " "), F.lit(", T;       "), F.col("n").cast("string"))
    entries = per.select("motif_id", F.lit(1).alias("part"), "seq_ac", line.alias("value"))
    total = per.groupBy("motif_id").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    sums = total.select("motif_id", F.lit(2).alias("part"), F.lit("").alias("seq_ac"), F.concat(F.lit(" "), F.rpad(F.col("k").cast("string"), 13, " "), F.lit(" "), F.col("n").cast("string")).alias("value"))
    names = total.select("motif_id", F.lit(0).alias("part"), F.lit("").alias("seq_ac"), F.col("motif_id").alias("value"))
    return names.unionByName(entries).unionByName(sums)


def sam_header(motifs) -> list[str]:
    """The header lines of SAM output, from (accession, length) pairs."""
    return ["@HD\tVN:1.6\tSO:unknown", *(f"@SQ\tSN:{ac}\tLN:{n}" for ac, n in motifs)]


def regex_text(hits: DataFrame, regex: str, header: str = "header") -> DataFrame:
    """A pattern's matches as text: header, number, places and regular expression in one line, what matched in the next."""
    return hits.select(F.format_string(f"%s_%s %s-%s {regex.replace('%', '%%')}\n%s", F.col(header), F.col("match_no").cast("string"), F.col("begin").cast("string"), F.col("end").cast("string"), F.col("matched")).alias("value"))


def score_text(scores: DataFrame, key: str = "seq_id") -> DataFrame:
    """A line for each sequence and strand: prefilter score, exact score, key, strand; '-' for what there is not."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("h_score", "score", key, "strand")]
    return scores.select(F.concat_ws("\t", *shown).alias("value"))


def read_search(spark, path: str) -> DataFrame:
    """Hits of a search's own tab-separated text (format 7): motif, its range, sequence, range, raw and normalised score, strand, alignment."""
    kind = "motif string, motif_start int, motif_end int, seq_id string, begin int, end int, raw_score int, norm_score double, strand string, aligned string"
    rows = spark.read.csv(path, schema=kind, sep="\t", quote="", escape="")
    part = F.split("motif", r"\|")
    return rows.select(part[0].alias("motif_ac"), F.get(part, 1).alias("motif_id"), *[c.split()[0] for c in kind.split(", ")[1:]])
