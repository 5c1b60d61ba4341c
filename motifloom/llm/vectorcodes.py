"""Product codes of vectors: a codebook for each part of them, fitted by Yinyang Lloyd rounds in whole numbers.

Entries of a codebook are clustered into groups once. Each part of each vector
keeps an upper bound on the distance to its entry and one lower bound a group on
the distance to the group's other entries. After a round the bounds drift by how
far entries have moved; only groups whose bound no longer lies above the upper
bound are scanned. Distances that decide are squared whole numbers, so bounds
(rounded to the safe side) never change a result, ties included.

A round is one pass of tasks over the vectors, which carry their bounds in a
written table. Each task adds one row with what its reassigned parts change in
the entries' sums, so a round shuffles a row a task, and the driver gets one
number for each component of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Units in 1: a component x is floor(SCALE * x).
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
#: Groups of a codebook's entries.
GROUPS = 4
#: Magnitude in units that components stay below; squared distances of up to 64 of them then fit a long.
LIMIT = 1 << 27
#: Components worked on side by side in a task.
CELLS = 1 << 19


def quantised(values: np.ndarray) -> np.ndarray:
    return np.floor(values.astype(np.float64) * SCALE).astype(np.int64)


def grouped(book: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each entry of one codebook: a few Lloyd rounds on entries, from far apart ones."""
    x, k = book.astype(np.float64), min(groups, len(book))
    if not k:
        return np.zeros(0, np.int64)
    centres = [x[0]]
    while len(centres) < k:
        centres.append(x[np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0).argmax()])
    centres = np.array(centres)
    for _ in range(5):
        of = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(k):
            if (of == g).any():
                centres[g] = x[of == g].mean(axis=0)
    return of


def _up(v: np.ndarray) -> np.ndarray:
    return np.nextafter((v * (1 + 1e-12)).astype(np.float32), np.float32(np.inf))


def _down(v: np.ndarray) -> np.ndarray:
    return np.nextafter(np.where(v > 0, v * (1 - 1e-12), v * (1 + 1e-12)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """State of the parts at one position: entry, upper bound, lower bound of each group."""

    def __init__(self, entry: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.entry, self.upper, self.lower = entry, upper, lower

    @classmethod
    def none(cls, n: int, groups: int) -> Bounds:
        return cls(np.zeros(n, np.uint8), np.full(n, np.inf, np.float32), np.full((n, groups), -np.inf, np.float32))

    def drift(self, moved: np.ndarray, of: np.ndarray) -> None:
        """Entries have moved by so much."""
        self.upper = _up(self.upper.astype(np.float64) + moved[self.entry])
        most = np.array([moved[of == g].max(initial=0.0) for g in range(self.lower.shape[1])])
        self.lower = _down(self.lower.astype(np.float64) - most)

    def reassign(self, x: np.ndarray, book: np.ndarray, of: np.ndarray) -> int:
        """Each part's nearest entry, of equal ones the first; gives the distances that were computed."""
        least = self.lower.min(axis=1)
        open_ = np.flatnonzero(self.upper >= least)
        if not len(open_):
            return 0
        own = ((x[open_] - book[self.entry[open_]]) ** 2).sum(axis=1)
        self.upper[open_] = _up(np.sqrt(own.astype(np.float64)))
        still = self.upper[open_] >= least[open_]
        computed, open_, own = len(own), open_[still], own[still]
        far = np.iinfo(np.int64).max
        table = np.full((len(open_), len(book)), far)
        rows, before = np.arange(len(open_)), self.entry[open_].astype(np.int64)
        table[rows, before] = own
        scan = self.lower[open_] <= self.upper[open_, None]
        for g in range(scan.shape[1]):
            members, at = np.flatnonzero(of == g), np.flatnonzero(scan[:, g])
            if len(at) and len(members):
                table[np.ix_(at, members)] = ((x[open_[at], None] - book[members][None]) ** 2).sum(axis=2)
                computed += len(at) * len(members)
        now = table.argmin(axis=1)  # the first of equal ones
        best = table[rows, now]
        self.entry[open_], self.upper[open_] = now, _up(np.sqrt(best.astype(np.float64)))
        table[rows, now] = far
        for g in range(scan.shape[1]):
            members = np.flatnonzero(of == g)
            rest = table[:, members].min(axis=1, initial=far)
            bound = np.where(rest == far, np.inf, _down(np.sqrt(rest.astype(np.float64))))
            self.lower[open_, g] = np.where(scan[:, g], bound, np.minimum(self.lower[open_, g], np.where(now != before, bound, np.inf)))
        return computed


class Books:
    """All codebooks, with their groups; what a round sends to the tasks."""

    def __init__(self, books: np.ndarray, of: np.ndarray | None = None, moved: np.ndarray | None = None):
        self.books = books  # (parts, entries, width)
        self.of = np.array([grouped(b) for b in books]) if of is None else of
        self.moved = np.zeros(books.shape[:2]) if moved is None else moved
        self.groups = min(GROUPS, books.shape[1])

    @property
    def state_type(self) -> np.dtype:
        p = len(self.books)
        return np.dtype([("entry", np.uint8, (p,)), ("upper", np.float32, (p,)), ("lower", np.float32, (p, self.groups))])

    def step(self, x: np.ndarray, state: np.ndarray) -> None:
        """One round for vectors (n, parts, width) and their states, in place."""
        for p, book in enumerate(self.books):
            b = Bounds(*(state[k][:, p].copy() for k in ("entry", "upper", "lower")))
            b.drift(self.moved[p], self.of[p])
            b.reassign(x[:, p], book, self.of[p])
            state["entry"][:, p], state["upper"][:, p], state["lower"][:, p] = b.entry, b.upper, b.lower

    def fresh(self, n: int) -> np.ndarray:
        state = np.zeros(n, self.state_type)
        state["upper"], state["lower"] = np.inf, -np.inf
        return state

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Books:
        """Entries at the floor of their parts' mean; unused ones stay."""
        books = self.books.copy()
        for p, j in zip(*np.nonzero(counts), strict=True):
            books[p, j] = [int(s) // int(counts[p, j]) for s in sums[p, j]]
        moved = np.sqrt(((books - self.books).astype(np.float64) ** 2).sum(axis=2)) * (1 + 1e-12)
        return Books(books, self.of, moved)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _vectors(part: pa.RecordBatch, parts: int) -> np.ndarray:
    flat = part.column("v").flatten().to_numpy(zero_copy_only=False)
    return quantised(flat).reshape(part.num_rows, parts, -1)


def _binary(state: np.ndarray) -> pa.Array:
    size = state.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(state), [None, pa.py_buffer(np.arange(0, (len(state) + 1) * size, size, dtype=np.int32)), pa.py_buffer(state.tobytes())])


def _round(books: Books, row_cells: int):
    """A pass that reassigns; the last row has the changes of sums and counts, with no vector."""
    parts, entries, width = books.books.shape

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, entries, width + 1), np.int64)
        names, kinds = None, None
        for batch in batches:
            names, kinds = batch.schema.names, batch.schema.types
            for at in range(0, batch.num_rows, max(1, CELLS // row_cells)):
                part = batch.slice(at, max(1, CELLS // row_cells))
                x = _vectors(part, parts)
                known = part.column("state").to_pylist()
                first = known[0] is None
                state = books.fresh(len(x)) if first else np.frombuffer(b"".join(known), books.state_type).copy()
                before = state["entry"].copy()
                books.step(x, state)
                for p in range(parts):
                    new = np.ones(len(x), bool) if first else state["entry"][:, p] != before[:, p]
                    own = np.c_[x[new, p], np.ones(new.sum(), np.int64)]
                    np.add.at(change[p], state["entry"][new, p], own)
                    if not first:
                        np.subtract.at(change[p], before[new, p], own)
                yield pa.record_batch([part.column(0), part.column(1), part.column(2), _binary(state), pa.nulls(part.num_rows, pa.list_(pa.int64()))], names=names)
        if names:
            last = [pa.nulls(1, k) for k in kinds[:4]] + [pa.array([change.ravel().tolist()], pa.list_(pa.int64()))]
            yield pa.record_batch(last, names=names)

    return step


def _final(books: Books, row_cells: int):
    parts = len(books.books)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, CELLS // row_cells)):
                part = batch.slice(at, max(1, CELLS // row_cells))
                x = _vectors(part, parts)
                known = part.column("state").to_pylist()
                state = books.fresh(len(x)) if known[0] is None else np.frombuffer(b"".join(known), books.state_type).copy()
                books.step(x, state)
                near = np.stack([books.books[p][state["entry"][:, p]] for p in range(parts)], axis=1)
                error = ((x - near) ** 2).sum(axis=(1, 2))
                yield pa.record_batch([part.column(0), part.column(1), pa.array([e.tobytes().hex() for e in state["entry"]]), pa.array(error)], names=["id", "label", "code", "error"])

    return step


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error, codebooks_sha256 for each vector that is fit.

    A vector that is null, or has a null, NaN or infinite component, is left
    out. Components are floored to units of 1 / ``SCALE``; each of ``parts`` equal
    parts has a codebook of at most ``entries`` entries, at first the parts of the
    vectors of the smallest keys (null last; of equal keys by components). In
    each of ``rounds`` rounds every part takes its nearest entry (of equally
    near ones the first) and each used entry goes to its parts' mean, floored;
    at the end parts are assigned once more. code: two hexadecimal digits an
    entry; error: squared distances in units, summed; label_error: errors summed
    over equal labels (nulls together).

    The common length is that of the first vector whose length is a multiple of
    ``parts``. Vectors of another length, or with a component of a magnitude of
    2^15 or more, whose squares a long can't hold, have a row with null code and
    error and take no part in codebooks and sums. Equal rows are coded alike,
    each with a row of its own. No vectors: no rows. Other columns are not read
    and may have any name.
    """
    own = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    fit = own.where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    small = F.forall("v", lambda x: F.abs(x) < LIMIT / SCALE)
    order = [F.col("id").asc_nulls_last(), "v"]
    lead = fit.where((F.size("v") > 0) & (F.size("v") % parts == 0) & small).select("id", "v", F.size("v").alias("n"))
    first = lead.orderBy(*order).limit(1).first()
    if first is None:
        odd = fit.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return odd.select(F.col("id").alias(key), "code", "error", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    width = first["n"]
    good = (F.size("v") == width) & small
    start = [r["v"] for r in lead.where(F.col("n") == width).orderBy(*order).limit(entries).collect()]
    books = Books(quantised(np.array(start, np.float64)).reshape(len(start), parts, -1).transpose(1, 0, 2).copy())
    table = fit.where(good).select("id", "label", "v", F.lit(None).cast("binary").alias("state"), F.lit(None).cast("array<bigint>").alias("change"))
    shape = (parts, len(start), width // parts + 1)
    total = np.zeros(shape, object)
    kind = table.schema
    for _ in range(rounds):
        after = cut(table.mapInArrow(_round(books, width), kind), "codes")
        drop_cut(table)
        sums = after.where("change is not null").select(F.posexplode("change").alias("k", "x")).groupBy("k").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        for r in sums.collect():  # parts * entries * (width + 1) numbers at most
            total[np.unravel_index(r["k"], shape)] += int(r["x"])
        books = books.after(total[..., :-1], total[..., -1].astype(np.int64))
        table = after.where("change is null")
        table._cut_path = after._cut_path
    coded = cut(table.mapInArrow(_final(books, width), f"id {kind['id'].dataType.simpleString()}, label {kind['label'].dataType.simpleString()}, code string, error long"), "coded")
    drop_cut(table)
    odd = fit.where(~good).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    rows = coded.unionByName(odd)
    out = rows.join(by_label, rows["label"].eqNullSafe(by_label["_label"]), "left")
    return out.select(F.col("id").alias(key), "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    """The same rows in DuckDB, for vectors of one length."""
    parts = [
        "e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS MATERIALIZED (SELECT id, i // w AS part, i % w AS k, floor({SCALE}::DOUBLE * embedding[i + 1]::DOUBLE)::BIGINT AS x FROM (SELECT id, embedding, len(embedding) // {PARTS} AS w, unnest(range(len(embedding))) AS i FROM e))",
        f"b0 AS MATERIALIZED (SELECT part, id AS j, k, x AS c FROM x WHERE id < {ENTRIES})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"d{r} AS MATERIALIZED (SELECT id, part, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT id, x.part, j, sum((x - c) * (x - c))::BIGINT AS d FROM x JOIN b{r} b ON x.part = b.part AND x.k = b.k GROUP BY ALL) GROUP BY ALL)")
        if r < ROUNDS:
            parts.append(f"s{r} AS (SELECT x.part, j, k, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN d{r} d ON x.id = d.id AND x.part = d.part GROUP BY ALL)")
            parts.append(f"b{r + 1} AS MATERIALIZED (SELECT b.part, b.j, b.k, coalesce((s - ((s % n) + n) % n) // n, c) AS c FROM b{r} b LEFT JOIN s{r} s ON b.part = s.part AND b.j = s.j AND b.k = s.k)")
    parts.append(f"o AS (SELECT id, string_agg(printf('%02x', j), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM d{ROUNDS} GROUP BY id)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, j, k)) FROM b{ROUNDS}) AS codebooks_sha256 FROM e JOIN o USING (id)"""


SQL = _sql()
