"""PROSITE patterns as regular expressions, and scans with them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ELEMENT = re.compile(r"(?P<core>\[[^\]]*\]|\{[^}]*\}|[A-Za-z])(?P<star>\*)?(?:\((?P<lo>\d+)(?:,(?P<hi>\d+))?\))?")
#: Letters that stand for several: an asparagine or aspartate, a glutamine or glutamate.
AMBIGUOUS = {"B": "BND", "Z": "ZQE"}


def to_regex(pattern: str, groups: bool = False, greedy: bool = True, admit_x: bool = True) -> str:
    """A PROSITE pattern ('<A-x(2,4)-[ST]-{P}>.') as a regular expression.

    Letters admit their ambiguous forms: B also N and D, Z also Q and E, and
    N, D, Q, E also B or Z. ``groups`` captures each element; ``admit_x`` lets
    an unknown X match any named letter. Anchors may stand inside a last or
    first choice: '[G>]' is G or the end.
    """
    text = re.sub(r"\s+", "", pattern).rstrip(".")
    head, tail = text.startswith("<"), text.endswith(">")
    text = text.removeprefix("<").removesuffix(">")
    out = []
    for part in filter(None, text.split("-")):
        m = _ELEMENT.fullmatch(part)
        if not m:
            raise ValueError(f"not a pattern element: {part!r}")
        core = m["core"]
        body = core[1:-1].upper() if core[0] in "[{" else core.upper()
        anchors = "".join(a for s, a in (("<", "^"), (">", "$")) if s in body)
        body = body.replace("<", "").replace(">", "")
        if core[0] == "{":
            letters = f"[^{_widen(body, False)}]"
        elif body == "X":
            letters = "."
        else:
            wide = _widen(body, admit_x)
            letters = wide if len(wide) == 1 else f"[{wide}]"
        if anchors:
            letters = f"(?:{letters}|{anchors})"
        if m["star"]:
            letters += "*"
        if m["lo"]:
            letters += f"{{{m['lo']},{m['hi']}}}" if m["hi"] else f"{{{m['lo']}}}"
        if not greedy and (m["star"] or m["hi"]):
            letters += "?"
        out.append(f"({letters})" if groups else letters)
    return "^" * head + "".join(out) + "$" * tail


def _widen(letters: str, admit_x: bool) -> str:
    out = dict.fromkeys(letters)
    for a, forms in AMBIGUOUS.items():
        if a in out:
            out.update(dict.fromkeys(forms))
        elif any(f in out for f in forms):
            out[a] = None
    if admit_x and "X" not in out:
        out["X"] = None
    return "".join(out)


def regex_count(seq: Column, regex: str) -> Column:
    """Successive matches that don't overlap."""
    return F.regexp_count(seq, F.lit(regex))


#: Bytes of rows that one batch of matches repeats, beside its last row.
REPEATED = 1 << 23


def scan(df: DataFrame, regex: str, column: str = "sequence", max_matches: int | None = None, overlap: bool = True, include: bool = False, max_x: int | None = None, keep: bool = True) -> DataFrame:
    """df with one row for each match: match_no, begin, end (1-based, inclusive), matched.

    ``overlap``: the search goes on one letter after a match's begin, else at
    its end. A match that ends where an earlier one did or before is dropped
    unless ``include``. A pattern anchored at the begin is tried once; an empty
    match moves on by one letter. ``max_x`` bounds the letters X in a match.
    ``keep=False`` leaves the sequence out. Null sequences give no row.
    """

    bound = REPEATED

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rx = re.compile(regex)
        for batch in batches:
            whole, at = batch if keep else batch.drop_columns([column]), batch.schema.get_field_index(column)
            mean = whole.nbytes // max(1, batch.num_rows)
            rows, no, begins, ends, texts, size = [], [], [], [], [], 0

            def pack():
                out = whole.take(pa.array(rows, pa.int64()))  # noqa: B023
                for name, values, kind in (("match_no", no, pa.int32()), ("begin", begins, pa.int32()), ("end", ends, pa.int32()), ("matched", texts, pa.string())):  # noqa: B023
                    out = out.append_column(name, pa.array(values, kind))
                    values.clear()
                rows.clear()  # noqa: B023
                return out

            for i in range(batch.num_rows):
                seq = batch.column(at)[i].as_py() or ""
                for n, (b, e) in enumerate(_matches(rx, seq, max_matches, overlap, include, max_x), 1):
                    rows.append(i)
                    no.append(n)
                    begins.append(b + 1)
                    ends.append(e)
                    texts.append(seq[b:e])
                    size += 64 + e - b + mean + (len(seq) if keep else 0)
                    if size >= bound:
                        yield pack()
                        size = 0
            if rows:
                yield pack()

    from pyspark.sql import types as T

    kept = [f for f in df.schema.fields if keep or f.name != column]
    kinds = T.StructType(kept + [T.StructField(n, t) for n, t in (("match_no", T.IntegerType()), ("begin", T.IntegerType()), ("end", T.IntegerType()), ("matched", T.StringType()))])
    return df.where(F.col(column).rlike(regex)).mapInArrow(step, kinds)


def places(seq: str, rx: re.Pattern) -> list[tuple[int, int]]:
    """Begin and end (from 0, exclusive) of the matches that ``scan`` gives by default."""
    return _matches(rx, seq, None, True, False, None)


def _matches(rx: re.Pattern, seq: str, limit: int | None, overlap: bool, include: bool, max_x: int | None) -> list[tuple[int, int]]:
    out, at, last = [], 0, -1
    while at <= len(seq) and (limit is None or len(out) < limit):
        m = rx.search(seq, at)
        if not m:
            break
        b, e = m.span()
        fits = max_x is None or m[0].count("X") <= max_x
        if fits and e > b and (include or e > last):
            out.append((b, e))
            last = max(last, e)
        if rx.pattern.startswith("^"):
            break
        at = b + 1 if overlap or e == b else e
    return out
