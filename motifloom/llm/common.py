"""Shared parts: shared-folder cuts, Arrow chunks, vectorised words and hashes.

Python steps run as ``mapInArrow`` over record batches. A batch is worked on in
chunks of at most ``CHUNK_BYTES`` of text (or one text, if that is longer), so
the memory of a worker doesn't depend on how many rows a batch has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from ..shared import cut, drop_cut, shared_dir

__all__ = ["chunks", "cut", "drop_cut", "keep_rows", "mix", "shared_dir", "shingle_hashes", "table", "text_bytes", "words"]

#: Text bytes worked on at once.
CHUNK_BYTES = 1 << 20
#: The separators of the word class [^\x20\x09-\x0D].
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: The same class for Java and RE2 patterns.
WORD = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes in a string column (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    ends = np.cumsum(np.asarray(pa.compute.binary_length(col).fill_null(0), dtype=np.int64))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def keep_rows(docs: DataFrame, judge: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """The rows of docs that ``judge`` marks in each chunk, with all columns; nothing is shuffled."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(np.asarray(judge(part), bool)))

    return docs.mapInArrow(step, docs.schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    column = column.fill_null("") if column.null_count else column
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind, n + 1 + column.offset)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers.get("n", 0) < n:
        size = max(n, CHUNK_BYTES + 4096)
        with np.errstate(over="ignore"):
            for key, base in (("up", _BASE), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                _powers[key] = np.multiply.accumulate(p)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: (starts, hashes, words before each text).

    Words are runs outside the separators; ``table`` maps bytes first (default:
    lower-case A-Z) and may map more bytes to a space. A word's hash depends on
    its mapped bytes alone.
    """
    data = (_LOWER if table is None else table)[raw]
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    up, down = _power(n)
    with np.errstate(over="ignore"):
        part = (data.astype(np.uint64) + np.uint64(1)) * up
        part[~inside] = 0
        hashes = mix(np.add.reduceat(part, starts) * down[starts])
    return starts, hashes, np.searchsorted(starts, offsets)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes (at every start; the caller masks those over a text's end)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = (out ^ hashes[i : i + n]) * _BASE + np.uint64(i + 1)
    return mix(out)
