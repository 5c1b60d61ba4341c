"""Searching sequences with profiles: a cascade of prefilter, score and alignment.

The stages are one Arrow step per batch of sequences: only sequences that pass
the cheap prefilter are scored, only those that reach the cutoff are aligned,
and no column but the sequence enters the step's kernels. Many profiles go to
each task in passes of bounded size, so sequences are read once a pass and
nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import inorder
from . import kernels as K

#: Profile cells (positions times letters) carried to tasks in one pass.
PASS_CELLS = 4_000_000


@dataclass(frozen=True)
class Motif:
    """A profile with what deciding on its scores takes."""

    profile: K.Profile
    cutoff: int
    h_cutoff: int | None = None
    ac: str = ""
    unique: bool = False
    order: str = "best"  # matches are taken best first, or accepted from left to right: "sequence"


_TURN = ("begin", "end", "motif_start", "motif_end")


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one array of bytes, a letter each, and where its strings begin; null counts as empty."""
    n, column = len(column), column.cast(pa.string())
    _, off, data = column.buffers()
    starts = np.frombuffer(off, np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.zeros(0, np.uint8)
    if not column.null_count and raw.max(initial=0) < 128:
        return raw, starts - starts[0]
    seqs = [s or "" for s in column.to_pylist()]
    return np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8), np.r_[0, np.cumsum([len(s) for s in seqs])].astype(np.int64)


def _laid(p: K.Profile, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, starts = _letters(column)
    return p.numbers(raw), starts


def _parts(batch: pa.RecordBatch, column: str, letters: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + letters, "right")))
        yield batch.slice(at, to - at)
        at = to


def with_h_score(df: DataFrame, profile: K.Profile, column: str = "sequence", name: str = "h_score") -> DataFrame:
    """df with the prefilter score of each sequence; null and empty ones have 0."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, column):
                yield part.append_column(name, pa.array(K.h_scores(profile, *_laid(profile, part.column(column))).astype(np.int32)))

    return df.mapInArrow(step, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


def folded_h_score(sequence: Column, profile: K.Profile) -> Column:
    """The prefilter score as an expression of built-in functions: a fold over profile positions of the diagonal values by letter.

    Each position makes the array of values anew from the one before, shifted by
    a letter, and adds its best, if positive, to the sum. Null and empty sequences
    have 0.
    """
    if profile.circular:
        raise ValueError(f"circular profiles have no prefilter score: {profile.name}")
    table = F.array(*(F.array(*(F.lit(int(max(v, -(1 << 20)))) for v in row)) for row in profile.match))
    letters = F.filter(F.split(sequence, ""), lambda c: c != "")
    codes = F.transform(letters, lambda c, k: F.struct(F.instr(F.lit(profile.alphabet), c).alias("code"), (k == 0).alias("first")))
    start = F.struct(codes.alias("codes"), F.transform(codes, lambda c: F.lit(0)).alias("values"), F.lit(0).alias("total"))

    def fold(state, row):
        before = F.slice(F.concat(F.array(F.lit(0)), state["values"]), F.lit(1), F.size(state["codes"]))
        least = F.lit(-(1 << 22))
        values = F.zip_with(before, state["codes"], lambda v, c: F.greatest(F.when(c["first"], least).otherwise(F.lit(0)), v + F.get(row, c["code"])))
        best = F.greatest(F.coalesce(F.array_max(values), F.lit(0)), F.lit(0))
        return F.struct(state["codes"].alias("codes"), values.alias("values"), (state["total"] + best).alias("total"))

    return F.aggregate(table, start, fold, lambda state: state["total"])


#: Positions up to which ``with_folded_h_score`` goes by diagonals: a column each, in one generated function.
DIAGONAL = 32


def with_folded_h_score(df: DataFrame, profile: K.Profile, column: str = "sequence", name: str = "h_score") -> DataFrame:
    """df without the sequence, with its prefilter score by built-in functions alone; no Python runs.

    Each sequence gives a row for each diagonal, whose values are columns in generated
    code, and the best of each position is an aggregate; a task's rows of one sequence are
    summed up before the shuffle. Longer profiles go by ``folded_h_score``.
    """
    rest = [c for c in df.columns if c != column]
    if profile.circular or profile.length > DIAGONAL:
        return df.withColumn(name, folded_h_score(F.col(column), profile)).select(*rest, name)
    pad, low = len(profile.alphabet) + 1, -(1 << 28)
    flag = pad + 1  # a sequence's first letter, whose values may be below zero
    rows = [[int(max(v, -(1 << 20))) for v in own] + [low] for own in profile.match]
    letters = F.transform(F.split(column, ""), lambda c, k: F.instr(F.lit(profile.alphabet), c) + (k == 0).cast("int") * flag)
    own = F.when(F.length(column) > 0, letters).otherwise(F.array().cast("array<int>"))
    side = F.array_repeat(F.lit(pad), profile.length - 1)
    made = df.select(*rest, F.monotonically_increasing_id().alias("_row"), F.concat(side, own, side).alias("_codes"), F.coalesce(F.length(column), F.lit(0)).alias("_n"))
    # a place after the last diagonal's is read by nothing; an empty sequence has a diagonal of padding
    each = made.select(*rest, "_row", "_codes", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") + (profile.length - 2), F.lit(0)))).alias("_at"))
    best, v = [], F.lit(0)
    for i, own in enumerate(rows):
        code = F.get("_codes", F.col("_at") + i)
        v = F.greatest((code >= flag).cast("int") * low, v + F.get(F.array(*map(F.lit, own + own)), code))
        best.append(F.max(v).alias(f"_v{i}"))
    found = each.groupBy("_row", *rest).agg(*best)
    total = F.lit(0)
    for i in range(profile.length):
        total = total + F.greatest(F.coalesce(F.col(f"_v{i}"), F.lit(0)), F.lit(0))
    return found.select(*rest, total.alias(name))


def with_score(df: DataFrame, profile: K.Profile, column: str = "sequence", name: str = "score") -> DataFrame:
    """df with the best alignment score of each sequence; null for null, empty and impossible ones."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, column):
                codes, starts = _laid(profile, part.column(column))
                s = K.scores(profile, [codes[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)])
                yield part.append_column(name, pa.array(s.astype(np.int32), mask=s <= K.NEG // 2))

    return df.mapInArrow(step, T.StructType([*df.schema.fields, T.StructField(name, T.IntegerType())]))


#: Turns of a circular profile inside one match.
SUB_HITS = "sub_hits array<struct<begin:int,end:int,motif_start:int,motif_end:int>>"
HIT = "motif_ac string, match_no int, begin int, end int, motif_start int, motif_end int, raw_score int, h_score int, aligned string"


def search(df: DataFrame, motifs: Sequence[Motif], key: str = "seq_id", column: str = "sequence", align: bool = True, limit: int | None = None, repeats: bool = False) -> DataFrame:
    """Matches of any number of motifs: the key's column and those of ``HIT``, one row for each match.

    A motif with a prefilter cutoff is scored only where its prefilter score
    reaches it. Matches of one motif in one sequence have apart protected
    parts and are numbered in order; ``limit`` bounds them. ``align=False``
    stops after scoring: one row for each sequence that reaches the cutoff.
    Circular profiles are searched without a prefilter; with ``repeats`` the
    turns inside each match are given (``SUB_HITS``, none for linear profiles).
    """
    kind = f"`{key}` {df.schema[key].dataType.simpleString()}, {HIT}" + (f", {SUB_HITS}" if repeats else "")
    own = df.select(key, F.col(column).alias("_sequence"))
    unknown = {m.order for m in motifs} - {"best", "sequence"}
    if unknown:
        raise ValueError(f"no such order of matches: {', '.join(unknown)}")
    circular = [m.ac or m.profile.name for m in motifs if m.profile.circular and m.h_cutoff is not None]
    if circular:
        raise ValueError(f"circular profiles have no prefilter: {', '.join(circular)}")
    out = None
    group: list[Motif] = []
    cells = 0
    for m in [*motifs, None]:
        size = m.profile.match.size if m else 0
        if group and (m is None or cells + size > PASS_CELLS):
            found = own.mapInArrow(_search(list(group), align, limit, repeats), kind)
            out = found if out is None else out.unionByName(found)
            group, cells = [], 0
        if m:
            group.append(m)
            cells += size
    return out if out is not None else own.where("false").mapInArrow(_search([], align, limit, repeats), kind)


def _search(motifs: list[Motif], align: bool, limit: int | None, repeats: bool = False):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a walk takes as many steps for many sequences as for one
        letters = 1 << (22 if any(m.order == "sequence" for m in motifs) else 20)
        for batch in batches:
            for part in _parts(batch, "_sequence", letters):
                raw, starts = _letters(part.column("_sequence"))
                known: dict[str, np.ndarray] = {}  # numbers of the letters by alphabet
                rows, hits = [], []
                for motif in motifs:
                    p = motif.profile
                    if p.alphabet not in known:
                        known[p.alphabet] = p.numbers(raw)
                    codes = known[p.alphabet]
                    h = K.h_scores(p, codes, starts) if not p.circular else np.zeros(part.num_rows, np.int64)
                    passed = np.flatnonzero((h >= motif.h_cutoff) if motif.h_cutoff is not None else np.diff(starts) > 0)
                    own = [codes[starts[i] : starts[i + 1]] for i in passed]
                    best = K.scores(p, own, motif.cutoff if align else None)
                    good = np.flatnonzero(best >= motif.cutoff)
                    finder = inorder.all_matches if motif.order == "sequence" else K.all_matches
                    found = finder(p, [own[k] for k in good], [part.column("_sequence")[int(passed[k])].as_py() for k in good], motif.cutoff, motif.unique, limit) if align else [[None]] * len(good)
                    for k, ms in zip(good.tolist(), found, strict=True):
                        i = int(passed[k])
                        for n, m in enumerate(ms, 1):
                            rows.append(i)
                            place = (m.begin, m.end, m.motif_start, m.motif_end, m.score, int(h[i]), m.aligned) if m else (None, None, None, None, int(best[k]), int(h[i]), None)
                            hits.append((motif.ac, n, *place, *([[dict(zip(_TURN, x, strict=True)) for x in m.repeats] if m else []] if repeats else [])))
                if rows:
                    keys = part.column(0).take(pa.array(rows))
                    kinds = [pa.string(), *[pa.int32()] * 7, pa.string(), *([pa.list_(pa.struct([(x, pa.int32()) for x in _TURN]))] if repeats else [])]
                    yield pa.record_batch([keys, *(pa.array(c, t) for c, t in zip(zip(*hits, strict=True), kinds, strict=True))], names=[part.schema.names[0], *(x.split()[0] for x in HIT.split(", ")), *(["sub_hits"] if repeats else [])])

    return step


def survivors(df: DataFrame, hits: DataFrame, key: str = "seq_id") -> DataFrame:
    """The records that a hit names, whole."""
    return df.join(hits.select(key).distinct(), key, "left_semi")


def stage_counts(df: DataFrame, motif: Motif, column: str = "sequence") -> DataFrame:
    """How many records there are, pass the prefilter, and reach the cutoff after it: (n, n_heuristic, n_filter).

    Counted where the cascade runs, a row a batch; only what passes the prefilter
    is scored, and only up to the cutoff.
    """
    p = motif.profile

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, column):
                codes, starts = _laid(p, part.column(column))
                full = np.diff(starts) > 0
                passed = np.flatnonzero(K.h_scores(p, codes, starts) >= motif.h_cutoff) if motif.h_cutoff is not None else np.arange(len(full))
                own = [codes[starts[i] : starts[i + 1]] for i in passed]
                good = int((K.scores(p, own, motif.cutoff) >= motif.cutoff).sum()) if own else 0
                yield pa.record_batch([pa.array([x], pa.int64()) for x in (len(full), len(passed), good)], names=["n", "n_heuristic", "n_filter"])

    each = df.select(column).mapInArrow(step, "n long, n_heuristic long, n_filter long")
    return each.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in each.columns))


def observed(df: DataFrame, motif: Motif, column: str = "sequence") -> tuple[DataFrame, dict[str, Observation]]:
    """df's records that reach the motif's cutoff, with h_score and score, and what each stage saw.

    The counts are metrics of the search itself: after the first action on the
    records each observation's ``get`` has n, for the stages "read", "heuristic"
    and "filter".
    """
    seen = {k: Observation(f"{motif.ac or motif.profile.name}-{k}") for k in ("read", "heuristic", "filter")}
    count = F.count(F.lit(1)).alias("n")
    scored = with_h_score(df.observe(seen["read"], count), motif.profile, column)
    passed = scored.where(F.col("h_score") >= motif.h_cutoff) if motif.h_cutoff is not None else scored
    kept = with_score(passed.observe(seen["heuristic"], count), motif.profile, column).where(F.col("score") >= motif.cutoff)
    return kept.observe(seen["filter"], count), seen


def score_dump(df: DataFrame, profile: K.Profile, key: str = "seq_id", column: str = "sequence", both_strands: bool = False) -> DataFrame:
    """(key, strand, h_score, score) of every sequence, with no cutoff; on both strands if asked for."""
    from ..functions.letters import strands

    own = df.select(key, F.inline(strands(F.col(column)))) if both_strands else df.select(key, F.lit("+").alias("strand"), F.col(column).alias("sequence"))
    return with_score(with_h_score(own, profile), profile).select(key, "strand", "h_score", "score")


def best_family(hits: DataFrame, key: str = "seq_id", score: str = "raw_score") -> DataFrame:
    """The motif of the highest score of each record; equal scores: the first by accession."""
    return hits.groupBy(key).agg(F.min_by("motif_ac", F.struct(-F.col(score), "motif_ac")).alias("family"), F.max(score).alias(score))


def recover(df: DataFrame, motif: Motif, key: str = "seq_id", column: str = "sequence") -> DataFrame:
    """Both strands of DNA searched; places of the '-' strand are given on the forward one."""
    from ..functions.letters import strands

    both = df.select(key, F.length(column).alias("len"), F.inline(strands(F.col(column)))).withColumn("_key", F.struct(key, "len", "strand"))
    hits = search(both, [motif], "_key", "sequence")
    begin = F.when(F.col("_key.strand") == "-", F.col("_key.len") - F.col("end") + 1).otherwise(F.col("begin"))
    end = F.when(F.col("_key.strand") == "-", F.col("_key.len") - F.col("begin") + 1).otherwise(F.col("end"))
    return hits.select(F.col(f"_key.{key}").alias(key), F.col("_key.strand").alias("strand"), "motif_ac", "match_no", begin.alias("begin"), end.alias("end"), "motif_start", "motif_end", "raw_score", "h_score", "aligned")
