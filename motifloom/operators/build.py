"""Building and converting models: column frequencies, weights, profiles, HMMs, frame search, alignments.

What grows with data (columns of large alignments, many sequences) is a
DataFrame step; a single model's tables are small and are made on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import NEG, Profile

#: Background frequencies of the twenty amino acids, in the order ACDEFGHIKLMNPQRSTVWY.
AMINO = "ACDEFGHIKLMNPQRSTVWY"
AMINO_FREQUENCIES = (0.0755, 0.0170, 0.0530, 0.0632, 0.0408, 0.0684, 0.0224, 0.0573, 0.0594, 0.0934, 0.0236, 0.0453, 0.0493, 0.0403, 0.0516, 0.0722, 0.0574, 0.0652, 0.0125, 0.0319)


def null_model(alphabet: str, p0: float = 1.0) -> dict[str, float]:
    """Uniform over ACGT for alphabets under 20 letters, else the amino-acid background; times p0 (1 if not positive)."""
    p0 = p0 if p0 > 0 else 1.0
    if len(alphabet) < 20:
        return {a: 0.25 * p0 for a in "ACGT"}
    total = sum(AMINO_FREQUENCIES)
    return {a: f / total * p0 for a, f in zip(AMINO, AMINO_FREQUENCIES, strict=True)}


def column_frequencies(msa: DataFrame) -> DataFrame:
    """(col, symbol, freq, gap): weighted share of each symbol among known ones in a column, and the column's share of gaps.

    msa: seq_id, weight, col, symbol; '-' is a gap, ' ' lies outside a sequence, 'X' is unknown.
    """
    inside = msa.where("symbol != ' '")
    per = inside.groupBy("col").agg(F.sum("weight").alias("covered"), F.sum(F.when(F.col("symbol") == "X", F.col("weight")).otherwise(0.0)).alias("unknown"), F.sum(F.when(F.col("symbol") == "-", F.col("weight")).otherwise(0.0)).alias("gaps"))
    each = inside.where("symbol NOT IN ('-', 'X')").groupBy("col", "symbol").agg(F.sum("weight").alias("w"))
    return each.join(per, "col").select("col", "symbol", (F.col("w") / F.nullif(F.col("covered") - F.col("unknown"), F.lit(0.0))).alias("freq"), (F.col("gaps") / F.col("covered")).alias("gap"))


def blank_ends(msa: DataFrame) -> DataFrame:
    """Gaps before a sequence's first letter and after its last become blanks (outside the sequence)."""
    letter = F.when(F.col("symbol") != "-", F.col("col"))
    w = W.partitionBy("seq_id")
    outside = (F.col("col") < F.min(letter).over(w)) | (F.col("col") > F.max(letter).over(w)) | F.min(letter).over(w).isNull()
    return msa.withColumn("symbol", F.when(outside, F.lit(" ")).otherwise(F.upper("symbol")))


def position_scores(freqs: DataFrame, matrix: DataFrame, scale: float = 0.1) -> DataFrame:
    """(col, a, score): for each letter the matrix scores to a column's letters, by frequency, times ``scale``."""
    met = freqs.join(matrix, freqs.symbol == matrix.b)
    return met.groupBy("col", "a").agg((F.sum(F.col("score") * F.col("freq")) * scale).alias("score"))


def make_profile(msa: DataFrame, matrix: DataFrame, alphabet: str, mode: str = "semiglobal", F_: float = 100, S: float = 0.1, G: float = 2.1, E: float = 0.2, M: float = 0.333, I: float = 0.1, T: float = 0.01, X: float = 0.5, L: float = 0, H: float | None = None, symmetric: bool = True) -> Profile:  # noqa: E741
    """A profile from an alignment: match scores from column frequencies, gap costs eased in regions that have gaps.

    Columns with a gap share above 1 - X are left out; a run of n columns with
    a share above T has its gap costs times M / (1 + n I). ``mode``: global,
    domain, semiglobal or local, by where an alignment may begin and end.
    """
    own = blank_ends(msa)
    freqs = column_frequencies(own).cache()
    gaps = {r["col"]: r.gap for r in freqs.groupBy("col").agg(F.max("gap").alias("gap")).collect()}
    scored: dict[int, dict[str, float]] = {}
    for r in position_scores(freqs, matrix, S).collect():
        scored.setdefault(r["col"], {})[r["a"]] = r.score
    freqs.unpersist()
    columns = sorted(gaps)
    ease = dict.fromkeys(columns, 1.0)
    run: list[int] = []
    for c in [*columns, None]:
        if c is not None and gaps[c] > T:
            run.append(c)
        elif run:
            ease.update(dict.fromkeys(run, M / (1 + len(run) * I)))
            run = []
    kept = [c for c in columns if gaps[c] <= 1 - X]
    size, r = len(kept), lambda v: int(math.floor(v + 0.5))
    match = np.array([[0] + [r(F_ * scored.get(c, {}).get(a, 0.0)) for a in alphabet] for c in kept], np.int64).reshape(size, len(alphabet) + 1)
    match[:, 0] = int(match[:, 1:].mean()) if size else 0
    extend = np.array([-r(F_ * E * ease[c]) for c in kept], np.int64)
    at = [ease[c] for c in kept]
    between = np.array([min(at[max(0, k - 1)], at[min(size - 1, k)]) for k in range(size + 1)]) if size else np.zeros(1)
    full = lambda v: np.full(size + 1, v, np.int64)
    part = np.array([-r(F_ * G * b / (2 if symmetric else 1)) for b in between], np.int64)
    back = part if symmetric else full(0)
    trans = {"mi": part, "md": part, "im": back, "dm": back, "id": full(NEG), "di": full(NEG)}
    insert = np.array([[-r(F_ * E * b)] * (len(alphabet) + 1) for b in between], np.int64)
    low, high = -r(L * F_), (NEG if H is None else -r(H * F_))
    b0, b1, e0, e1 = full(high), full(high), full(high), full(high)
    b0[0], e0[-1] = low, low
    if mode != "global":
        b1[0], e1[-1] = low, low
    if mode in ("semiglobal", "local"):
        b0[:], e0[:] = low, low
    if mode == "local":
        b1[:], e1[:] = low, low
    tail = min(5, size // 10)
    consensus = "".join(alphabet[int(m[1:].argmax())] if m[1:].max() > 0 else "X" for m in match)
    return Profile(alphabet, match, insert, extend, trans, {"b0": b0, "b1": b1, "e0": e0, "e1": e1}, 1 + tail, size - tail, consensus=consensus)


#: Rows of a group that meets another in one row: about GROUP_BYTES of them, a quarter of BLOCK at least and GROUP at most.
BLOCK, GROUP, GROUP_BYTES = 1024, 8192, 1 << 20


def _planes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of letters as bits: (row, bit of the letter's number, words of 64 columns); letters are numbered anew, from those that occur."""
    width = max(map(len, [*a, *b]), default=0)
    codes = np.zeros((len(a) + len(b), width), np.uint32)
    for k, row in enumerate([*a, *b]):
        own = np.frombuffer((row or "").encode("utf-32-le"), np.uint32)
        codes[k, : len(own)] = own
    seen = np.zeros(int(codes.max(initial=0)) + 1, bool)
    seen[codes] = True
    codes = (np.cumsum(seen, dtype=np.uint32) - 1)[codes]
    bits = max(1, int(seen.sum() - 1).bit_length())
    out = np.zeros((len(codes), bits, -(-width // 64) * 8), np.uint8)
    for bit in range(bits):
        packed = np.packbits((codes >> bit & 1).astype(bool), axis=1)
        out[:, bit, : packed.shape[1]] = packed
    out = out.view(np.uint64)
    return out[: len(a)], out[len(a) :]


def _compared(a: list[str], b: list[str]) -> Iterator[np.ndarray]:
    """For each row of a its Hamming distances to all rows of b: columns whose letters differ in any bit, 64 at a time. What is given is overwritten by the next."""
    x, y = _planes(a, b)
    y = np.ascontiguousarray(y.transpose(1, 2, 0))
    differ, one, total = np.empty(len(b), np.uint64), np.empty(len(b), np.uint64), np.empty(len(b), np.int32)
    for row in x:
        total[:] = 0
        for word in range(x.shape[2]):
            np.bitwise_xor(row[0, word], y[0, word], out=differ)
            for bit in range(1, x.shape[1]):
                np.bitwise_xor(row[bit, word], y[bit, word], out=one)
                np.bitwise_or(differ, one, out=differ)
            total += np.bitwise_count(differ)
        yield total


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Hamming distances of all rows of a to all rows of b."""
    return np.array([d.copy() for d in _compared(a, b)], np.int64).reshape(len(a), len(b))


def _nearest_of(cands: list[str], seqs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least distance of each candidate; where its sequences begin, and the end; the sequences of that distance, candidate by candidate)."""
    least, ties = np.zeros(len(cands), np.int64), []
    for k, d in enumerate(_compared(cands, seqs)):
        least[k] = d.min()
        ties.append(np.flatnonzero(d == least[k]))
    return least, np.cumsum([0, *map(len, ties)]).astype(np.int32), np.concatenate(ties)


def nearest(candidates: DataFrame, sequences: DataFrame) -> DataFrame:
    """(cand_id, distance, seq_ids): for each candidate the sequences at the least Hamming distance, by groups.

    Both have an id and an ``aligned`` string. Rows are gathered into groups of
    about a megabyte; each group of candidates meets each group of sequences, which
    gives a row a candidate, with the least distance in the group and who has it;
    pairs of rows are never made, and no group is broadcast. No sequences: no rows.
    """
    ids, named = sequences.schema["seq_id"].dataType, candidates.schema["cand_id"].dataType

    def groups(df: DataFrame, key: str, name: str) -> tuple[DataFrame, int]:
        n, longest = df.agg(F.count("*"), F.max(F.length("aligned"))).first()
        k = max(1, -(-n // max(BLOCK // 4, min(GROUP, GROUP_BYTES // ((longest or 0) + 32)))))
        return df.groupBy(F.pmod(F.xxhash64(key), F.lit(k)).alias(name)).agg(F.collect_list(F.struct(key, "aligned")).alias(f"{name}_rows")), k

    (cands, n_cand), (seqs, n_seq) = groups(candidates, "cand_id", "c"), groups(sequences, "seq_id", "s")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    met = cands.withColumn("s", every(n_seq)).hint("merge").join(seqs.withColumn("c", every(n_cand)), ["c", "s"]).select("c_rows", "s_rows")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                cands, seqs = batch.column(0)[k].values, batch.column(1)[k].values
                least, starts, at = _nearest_of(cands.field("aligned").fill_null("").to_pylist(), seqs.field("aligned").fill_null("").to_pylist())
                ties = pa.ListArray.from_arrays(pa.array(starts), seqs.field("seq_id").take(pa.array(at)))
                yield pa.record_batch([cands.field("cand_id"), pa.array(least), ties], names=["cand_id", "distance", "seq_ids"])

    each = met.mapInArrow(step, T.StructType([T.StructField("cand_id", named), T.StructField("distance", T.LongType()), T.StructField("seq_ids", T.ArrayType(ids))]))
    best = each.withColumn("least", F.min("distance").over(W.partitionBy("cand_id"))).where("distance = least")
    return best.groupBy("cand_id").agg(F.first("distance").alias("distance"), F.flatten(F.collect_list("seq_ids")).alias("seq_ids"))


def nearest_shares(candidates: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, share): each candidate gives one, in equal parts, to the sequences at the least Hamming distance."""
    near = nearest(candidates, sequences)
    return near.select(F.explode("seq_ids").alias("seq_id"), (1.0 / F.size("seq_ids")).alias("part")).groupBy("seq_id").agg(F.sum("part").alias("share"))


def weights(msa: DataFrame, shuffles: int = 100, total: float = 1.0, seed: int = 1) -> DataFrame:
    """(seq_id, weight): Monte-Carlo nearest-neighbour weights; random rows are drawn column by column from the symbols seen there."""
    rows = msa.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), "").alias("aligned"))
    n = rows.count()
    sets = msa.groupBy("col").agg(F.array_sort(F.collect_set("symbol")).alias("seen"))
    drawn = sets.withColumn("cand_id", F.explode(F.sequence(F.lit(1), F.lit(shuffles * n))))
    pick = F.get("seen", F.pmod(F.xxhash64(F.lit(seed), "cand_id", "col"), F.size("seen")).cast("int"))
    cands = drawn.select("cand_id", "col", pick.alias("symbol")).groupBy("cand_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "symbol"))), lambda x: x["symbol"]), "").alias("aligned"))
    got = nearest_shares(cands, rows)
    return rows.join(got, "seq_id", "left").select("seq_id", (F.coalesce("share", F.lit(0.0)) * total / (shuffles * n)).alias("weight"))


def gap_slots(matches: DataFrame) -> DataFrame:
    """(slot, width): the longest insertion before each match position, over all aligned strings."""
    return _slots(matches).groupBy("slot").agg(F.max(F.length("run")).alias("width"))


def _slots(matches: DataFrame) -> DataFrame:
    """(seq_id, slot, run, symbol): the insertion before each position and the position's own symbol ('' past the last)."""
    pieces = F.regexp_extract_all(F.concat("aligned", F.lit("$")), F.lit(r"([a-z]*[A-Z$-])"), F.lit(1))
    each = matches.select("seq_id", F.posexplode(pieces).alias("slot", "piece"))
    last = F.substr("piece", F.length("piece"), F.lit(1))
    return each.select("seq_id", "slot", F.substr("piece", F.lit(1), F.length("piece") - 1).alias("run"), F.when(last == "$", "").otherwise(last).alias("symbol"))


def to_msa(matches: DataFrame) -> DataFrame:
    """(seq_id, aligned): every match padded to common slots; dots first in the leading slot, last in the trailing one, in the centre of others."""
    slots = _slots(matches)
    widths = slots.groupBy("slot").agg(F.max(F.length("run")).alias("width"))
    last = slots.agg(F.max("slot")).first()[0]
    dots = F.repeat(F.lit("."), F.col("width") - F.length("run"))
    half = F.ceil(F.length("run") / 2).cast("int")
    inner = F.concat(F.substr("run", F.lit(1), half), dots, F.substr("run", half + 1, F.length("run")))
    padded = F.when(F.col("slot") == 0, F.concat(dots, "run")).when(F.col("slot") == last, F.concat("run", dots)).otherwise(inner)
    each = slots.join(widths, "slot").select("seq_id", "slot", F.concat(padded, "symbol").alias("piece"))
    return each.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "piece"))), lambda x: x["piece"]), "").alias("aligned"))


def edited(msa: DataFrame, gap: str = ".", case: str | None = None, longest: int | None = None, column: str = "aligned") -> DataFrame:
    """Rows of an alignment with gaps written as ``gap``, letters in one case ('upper', 'lower'), and runs of
    lower-case letters and dots over ``longest`` cut in their centre (an odd one longer on the left)."""
    out = F.col(column)
    if longest is not None:
        pieces = F.regexp_extract_all(out, F.lit("([a-z.]+|[^a-z.]+)"), F.lit(1))
        left, right = (longest + 1) // 2, longest // 2
        short = lambda x: F.when(x.rlike("^[a-z.]") & (F.length(x) > longest), F.concat(F.substr(x, F.lit(1), F.lit(left)), F.right(x, F.lit(right)))).otherwise(x)
        out = F.array_join(F.transform(pieces, short), "")
    out = F.translate(out, ".-", gap * 2)
    out = F.upper(out) if case == "upper" else F.lower(out) if case == "lower" else out
    return msa.withColumn(column, out)


def _log(p: float, scale: float) -> int:
    return NEG if p <= 0 else int(math.floor(scale * math.log(p) + 0.5))


def hmm_to_profile(emissions: list[dict[str, float]], inserts: list[dict[str, float]], trans: list[dict[str, float]], null: dict[str, float], scale: float = 30 / math.log(2), protect: float = 10.0) -> Profile:
    """Log odds of an HMM's probabilities as a profile; a probability of zero is forbidden.

    trans: for each insert position the chances of 'mm', 'mi', ...; the first
    gives entries, the last exits. ``protect``: percent of the length left free at each end.
    """
    alphabet, size = "".join(null), len(emissions)
    odds = lambda row: [0] + [_log(row.get(a, 0) / null[a], scale) for a in alphabet]
    keys = ("mm", "mi", "md", "im", "ii", "id", "dm", "di", "dd")
    t = {k: np.array([_log(x.get(k, 0.0), scale) for x in trans], np.int64) for k in keys}
    border = {k: np.full(size + 1, NEG, np.int64) for k in ("b0", "b1", "e0", "e1")}
    for k in ("b0", "b1"):
        border[k][0] = 0
    for k in ("e0", "e1"):
        border[k][-1] = 0
    free = min(size // 2, int(size * protect / 100))
    consensus = "".join(max(e, key=e.get) for e in emissions)
    return Profile(alphabet, np.array([odds(e) for e in emissions]), np.array([odds(i) for i in inserts]), np.zeros(size, np.int64), t, border, 1 + free, size - free, consensus=consensus)


def profile_to_hmm(p: Profile, null: dict[str, float], base: float = math.log(2) / 30) -> dict[str, list[dict[str, float]]]:
    """Probabilities from scores: emissions times the null model, steps from each state, all made to sum to one."""

    def normal(row: dict[str, float]) -> dict[str, float]:
        total = sum(row.values())
        return {k: v / total if total else 0.0 for k, v in row.items()}

    chance = lambda v: 0.0 if v <= NEG // 2 else math.exp(base * v)
    emit = lambda row: normal({a: chance(row[i + 1]) * null.get(a, 0.0) for i, a in enumerate(p.alphabet)})
    steps = []
    for k in range(p.length + 1):
        out = {}
        for x in "mid":
            out |= {x + y: v for y, v in normal({y: chance(p.trans[x + y][k]) for y in "mid"}).items()}
        steps.append(out)
    return {"match": [emit(r) for r in p.match], "insert": [emit(r) for r in p.insert], "trans": steps}


def gcg_to_profile(rows: list[tuple[str, list[float], float, float]], alphabet: str, F_: float = 1.0, O: float = 0.0, G: float = 4.5, E: float = 0.05, symmetric: bool = True) -> Profile:  # noqa: E741
    """From (consensus, scores, gap, length) rows in percent: match F v / 100 + O, opening F G gap / 100, extension F E length / 100."""
    r = lambda v: int(math.floor(v + 0.5))
    size = len(rows)
    match = np.array([[0] + [r(v / 100 * F_ + O) for v in s] for _, s, _, _ in rows], np.int64)
    opening = np.array([-r(g / 100 * F_ * G / (2 if symmetric else 1)) for _, _, g, _ in rows] + [0], np.int64)
    extend = np.array([-r(n / 100 * F_ * E) for *_, n in rows], np.int64)
    insert = np.repeat(np.r_[extend, extend[-1:]][:, None], len(alphabet) + 1, axis=1)
    full = lambda v: np.full(size + 1, v, np.int64)
    back = opening if symmetric else full(0)
    trans = {"mi": opening, "md": opening, "im": back, "dm": np.r_[0, back[:-1]], "id": full(NEG), "di": full(NEG)}
    border = {k: full(NEG) for k in ("b0", "b1", "e0", "e1")}
    for k, at in (("b0", 0), ("b1", 0), ("e0", -1), ("e1", -1)):
        border[k][at] = 0
    return Profile(alphabet, match, insert, extend, trans, border, 1 + size // 10, size - size // 10, consensus="".join(c for c, *_ in rows))


def frame_search(p: Profile, frameshift: int = -60, intron: int = -90, intron_extend: int = -1, stop: int = -100, insert_share: float = 1 / 3) -> Profile:
    """A profile for interleaved translations: 3 L - 2 positions, the own ones every third, with costs of frame shifts and introns, and a stop letter 'O'."""
    size = 3 * p.length - 2
    alphabet = p.alphabet + "O"
    match = np.zeros((size, len(alphabet) + 1), np.int64)
    match[::3, :-1], match[::3, -1] = p.match, stop
    insert = np.zeros((size + 1, len(alphabet) + 1), np.int64)
    trans = {k: np.full(size + 1, 0 if k[0] == k[1] else NEG, np.int64) for k in p.trans}
    border = {k: np.full(size + 1, NEG, np.int64) for k in p.border}
    for k in range(p.length):
        at = 3 * k
        own = (np.maximum(p.insert[k], NEG) * insert_share).astype(np.int64)
        insert[at, :-1], insert[at, -1] = own, int(own.mean())
        for key in trans:
            trans[key][at] = p.trans[key][k]
        for key in border:
            border[key][at] = p.border[key][k]
        if k:  # before a position of its own: a shift of frame; after one: an intron
            trans["mi"][at - 1] = trans["im"][at - 1] = frameshift // 2
            trans["ii"][at - 1] = frameshift
        if at + 1 <= size:
            trans["mi"][at + 1] = trans["im"][at + 1] = intron // 2
            trans["ii"][at + 1] = min(-1, intron_extend)
    for key in border:
        border[key][size] = p.border[key][p.length]
    for key in trans:
        trans[key][size] = p.trans[key][p.length]
    delete = np.full(size, frameshift, np.int64)
    delete[::3] = np.maximum(p.delete - 2 * frameshift, NEG)
    return Profile(alphabet, match, insert, delete, trans, border, max(1, 3 * p.n1 - 2), min(size, max(1, 3 * p.last - 2)), p.name, "xx".join(p.consensus))


def iupac_matrix(match: float = 5, mismatch: float = -4) -> dict[tuple[str, str], int]:
    """Mean match or mismatch over the bases two IUPAC letters stand for, rounded half away from zero."""
    sets = {"A": "A", "C": "C", "G": "G", "T": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}
    out = {}
    for a, x in sets.items():
        for b, y in sets.items():
            mean = sum(match if i == j else mismatch for i in x for j in y) / (len(x) * len(y))
            out[a, b] = int(math.copysign(math.floor(abs(mean) + 0.5), mean))
    return out


def compare_parameters(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("ac",), fields: tuple[str, ...] = ("r1", "r2", "score")) -> DataFrame:
    """Both versions' parameters side by side with their differences; motifs of one side only have nulls."""
    a = old.select(*keys, *(F.col(c).alias(f"old_{c}") for c in fields))
    b = new.select(*keys, *(F.col(c).alias(f"new_{c}") for c in fields))
    return a.join(b, list(keys), "full").withColumns({f"{c}_diff": F.col(f"new_{c}") - F.col(f"old_{c}") for c in fields})
