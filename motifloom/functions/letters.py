"""Sequence functions as Column expressions; all but translation stay in generated code."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC nucleotide letters and their complements.
IUPAC = "ACGTUMKRYVBHDSWN"
COMPLEMENT = "TGCAAKMYRBVDHSWN"

#: The standard genetic code, third base fastest, bases in the order A C G T, stops O.
CODONS = "KNKNTTTTRSRSIIMIQHQHPPPPRRRRLLLLEDEDAAAAGGGGVVVVOYOYSSSSOCWCLFLF"


def clean(text: Column) -> Column:
    """Upper-case letters A to Z; everything else is dropped, null stays null."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def complement(seq: Column) -> Column:
    return F.translate(seq, IUPAC, COMPLEMENT)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def strands(seq: Column, which: str = "both") -> Column:
    """Array of (strand, sequence): forward '+', and for 'both' the reverse complement '-'; 'reverse' and 'complement' alone too."""
    make = {
        "forward": [("+", seq)],
        "reverse": [("r", F.reverse(seq))],
        "complement": [("c", complement(seq))],
        "reverse_complement": [("-", reverse_complement(seq))],
        "both": [("+", seq), ("-", reverse_complement(seq))],
    }[which]
    return F.array(*[F.struct(F.lit(s).alias("strand"), c.alias("sequence")) for s, c in make])


def flip(begin: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """Coordinates (1-based, inclusive) on the other direction."""
    return length - end + 1, length - begin + 1


def header_id(header: Column) -> Column:
    """The header up to a blank, without its leading '>' or '@'."""
    return F.regexp_extract(header, r"^[>@]?(\S*)", 1)


def short_id(header: Column) -> Column:
    """What follows the last '|' of the id."""
    return F.substring_index(header_id(header), "|", -1)


def header_description(header: Column) -> Column:
    return F.regexp_extract(header, r"^\S*\s+(.*)$", 1)


def bare_accession(ac: Column) -> Column:
    return F.split(ac, ";")[0]


def codes(seq: Column, alphabet: str) -> Column:
    """Letter numbers in the alphabet from 1; letters outside are 0."""
    return F.transform(F.split(seq, ""), lambda c: F.instr(F.lit(alphabet), c) * (c != "").cast("int"))


def _codons() -> np.ndarray:
    """Amino acids by 25 a + 5 b + c, bases A C G T 0 to 3, any other letter 4; with an unknown third base the one all four share, else X."""
    table = np.full((5, 5, 5), ord("X"), np.uint8)
    table[:4, :4, :4] = np.frombuffer(CODONS[:64].encode(), np.uint8).reshape(4, 4, 4)
    same = (table[:4, :4, :4] == table[:4, :4, :1]).all(axis=2)
    table[:4, :4, 4] = np.where(same, table[:4, :4, 0], ord("X"))
    return table.ravel()


_AMINO = _codons()
_BASE = np.full(256, 4, np.uint8)
_BASE[np.frombuffer(b"ACGT", np.uint8)] = range(4)


def translate_frames(seq: Column, step: int = 3, starts: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Array of proteins: every codon from each start, ``step`` apart (3: six-frame style, 1: interleaved); shorter than a codon: ''.

    A table lookup over the letters of an Arrow batch, about a million at a time.
    """

    def translated(rows: list[str | None]) -> list[list[str]]:
        raw = [(s or "").encode("latin-1", "replace") for s in rows]  # a byte a letter
        base = _BASE[np.frombuffer(b"".join(raw), np.uint8)]
        amino = _AMINO[25 * base[:-2] + 5 * base[1:-1] + base[2:]].tobytes().decode("ascii")
        out, at = [], 0
        for r in raw:
            to = at + len(r)
            out.append([amino[at + s - 1 : max(to - 2, at) : step] for s in starts])
            at = to
        return out

    def frames(column: pa.Array) -> pa.Array:
        out, rows, letters = [], [], 0
        for x in column:
            rows.append(x.as_py())
            letters += len(rows[-1] or "")
            if letters >= 1 << 20:
                out += translated(rows)
                rows, letters = [], 0
        return pa.array(out + translated(rows), pa.list_(pa.string()))

    return F.arrow_udf(frames, "array<string>")(seq)


def cigar(aligned: Column) -> Column:
    """Runs of match (upper case), insertion (lower) and deletion ('-') as M, I, D; outer deletions are dropped."""
    inner = F.regexp_replace(aligned, "^-+|-+$", "")
    runs = F.regexp_extract_all(inner, F.lit("([A-Z]+|[a-z]+|-+)"), F.lit(1))
    kind = lambda r: F.when(r.startswith("-"), "D").when(r.rlike("^[a-z]"), "I").otherwise("M")
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), kind(r))), "")


def ungapped(aligned: Column) -> Column:
    return F.upper(F.regexp_replace(aligned, "-", ""))


def quality_slice(quality: Column, begin: Column, end: Column) -> Column:
    return F.substr(quality, begin, end - begin + 1)


def wrap(text: Column, width: int = 60) -> Column:
    """Lines of at most ``width`` letters."""
    return F.regexp_replace(text, f"(.{{{width}}})(?=.)", "$1\n")


def periodic_quality(length: Column, unit: str = "IIIIHHHHGGGG") -> Column:
    return F.substr(F.repeat(F.lit(unit), F.ceil(length / len(unit)).cast("int")), F.lit(1), length)
