"""Benchmark decontamination by SimHash of item-sized windows.

For each item of the benchmark, every window of a document with as many words
as the item and at least one shingle of it gets a SimHash fingerprint. A
multi-index over fingerprint blocks gives, of the items of that length that share
a shingle with a run of windows, all within the Hamming radius, and the exact weighted-shingle similarity of window and item
decides. Windows without a shingle of an item have similarity zero with it, so
passing them over loses nothing. A document with fewer words than the item is
one window as a whole, if it has words enough to reach the threshold.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, keep_rows, shingle_hashes, text_bytes, words

SHINGLE = 5
THRESHOLD = 0.8
#: Two sets with a similarity of 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9.
RADIUS = 22
BLOCKS = 8
#: Benchmark text (bytes) searched for in one pass over the documents.
PASS_BYTES = 4 << 20

_TABLE = np.arange(256, dtype=np.uint8)
_TABLE[65:91] += 32
_TABLE[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def normalise(raw: np.ndarray) -> np.ndarray:
    """Bytes with Latin-1 capitals (À to Þ, written in two bytes) lowered; ASCII is mapped by the word table."""
    if len(raw) < 2:
        return raw
    low = raw[1:]
    capital = (raw[:-1] == 0xC3) & (low >= 0x80) & (low <= 0x9E) & (low != 0x97)
    if not capital.any():
        return raw
    raw = raw.copy()
    raw[1:][capital] += 0x20
    return raw


def simhash(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` shingles."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=total[1:])
    return np.packbits(2 * (total[size:] - total[:-size]) > size, axis=1).view(np.uint64).ravel()


class MultiIndex:
    """Fingerprints by block: those within the radius agree with a query up to radius // blocks bits in some block."""

    def __init__(self, fps: np.ndarray, radius: int, blocks: int):
        assert blocks == 8, "a block is a byte"
        self.fps, self.radius = fps, radius
        values = np.arange(256, dtype=np.uint8)
        near = np.bitwise_count(values[:, None] ^ values[None]) <= radius // blocks
        own = fps.view(np.uint8).reshape(-1, 8)
        self.tables = [near[:, own[:, b]] for b in range(blocks)]

    def query(self, fps: np.ndarray, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs within the radius, all of them; or of the entries ``among``."""
        among = np.arange(len(self.fps)) if among is None else among
        own = fps.view(np.uint8).reshape(-1, 8)
        found = np.zeros((len(fps), len(among)), bool)
        for b, t in enumerate(self.tables):
            found |= t[own[:, b][:, None], among]
        i, j = np.nonzero(found)
        close = np.bitwise_count(fps[i] ^ self.fps[among[j]]) <= self.radius
        return i[close], among[j[close]]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard: sum of the lesser weights over the sum of the greater; two empty ones: 0."""
    both = sum((a & b).values())
    every = sum(a.values()) + sum(b.values()) - both
    return both / every if every else 0.0


class Items:
    """Benchmark items of one pass, ready to be searched for."""

    def __init__(self, ids: list[int], texts: list[str | None], radius: int = RADIUS):
        raw, offsets = text_bytes(pa.array(texts, pa.string()))
        _, hashes, base = words(normalise(raw), offsets, _TABLE)
        self.widths: dict[int, tuple] = {}  # shingle width -> (sorted hashes, items of each)
        self.index: dict[int, tuple] = {}  # words -> (multi-index, items)
        self.ids, self.counts, self.words = ids, {}, np.diff(base)
        by_width, by_words = defaultdict(lambda: defaultdict(set)), defaultdict(list)
        for k in range(len(ids)):
            own = hashes[base[k] : base[k + 1]]
            if len(own):
                width = min(SHINGLE, len(own))
                sh = shingle_hashes(own, width)
                self.counts[k] = Counter(sh.tolist())
                by_words[len(own)].append((k, simhash(sh, len(sh))[0]))
                for h in self.counts[k]:
                    by_width[width][h].add(k)
        for width, owners in by_width.items():
            keys = np.array(sorted(owners), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.widths[width] = (keys, seen, [sorted(owners[h]) for h in keys.tolist()])
        self.entry = {k: e for entries in by_words.values() for e, (k, _) in enumerate(entries)}
        for n, entries in by_words.items():
            self.index[n] = (MultiIndex(np.array([f for _, f in entries], np.uint64), radius, BLOCKS), [k for k, _ in entries])

    def search(self, hashes: np.ndarray, base: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int]]:
        """(text, item, similarity, first word) of each item's best window in each text that reaches the threshold."""
        for width, (keys, seen, posted) in self.widths.items():
            sh = shingle_hashes(hashes, width)
            if not len(sh) or not len(keys):
                continue
            at = np.flatnonzero(seen[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
            spot = np.minimum(np.searchsorted(keys, sh[at]), len(keys) - 1)
            real = keys[spot] == sh[at]
            at, spot = at[real], spot[real]
            text = np.searchsorted(base, at, "right") - 1
            whole = at + width <= base[text + 1]
            at, spot, text = at[whole], spot[whole], text[whole]
            anchors = defaultdict(list)  # (text, words of the item) -> places and items with a shingle there
            for p, s, t in zip(at.tolist(), spot.tolist(), text.tolist(), strict=True):
                for k in posted[s]:
                    anchors[t, int(self.words[k])].append((p, self.entry[k]))
            for (t, n), places in anchors.items():
                if base[t + 1] - base[t] < n:
                    yield from self._whole(sh, width, t, n, np.unique([e for _, e in places]), base, threshold)
                else:
                    yield from self._windows(sh, width, t, n, places, base, threshold)

    def _whole(self, sh, width, t, n, among, base, threshold):
        """A text with fewer words than an item, as it is; the share of its shingles bounds the similarity."""
        low, size = int(base[t]), int(base[t + 1] - base[t]) - width + 1
        if size < threshold * (n - width + 1):
            return
        index, entries = self.index[n]
        own = sh[low : low + size]
        for _, e in zip(*index.query(simhash(own, size), among), strict=True):
            sim = similarity(Counter(own.tolist()), self.counts[entries[e]])
            if sim >= threshold:
                yield t, entries[e], sim, 0

    def _windows(self, sh, width, t, n, places, base, threshold):
        size, low, high = n - width + 1, int(base[t]), int(base[t + 1]) - n
        index, entries = self.index[n]
        best: dict[int, tuple[float, int]] = {}
        begins, k = [], 0
        while k < len(places):  # windows that hold an anchor, as runs of first words, and the items of their anchors
            first, last, among = max(low, places[k][0] - size + 1), min(high, places[k][0]), {places[k][1]}
            while k + 1 < len(places) and places[k + 1][0] - size + 1 <= last + 1:
                k += 1
                last = min(high, places[k][0])
                among.add(places[k][1])
            if last >= first:
                begins.append((first, last, np.array(sorted(among))))
            k += 1
        for first, last, among in begins:
            for part in range(first, last + 1, 4096):
                stop = min(last, part + 4095)
                fps = simhash(sh[part : stop + size], size)
                for w, e in zip(*index.query(fps, among), strict=True):
                    item = entries[e]
                    sim = similarity(Counter(sh[part + w : part + w + size].tolist()), self.counts[item])
                    if sim >= threshold and (item not in best or (sim, -part - w) > best[item]):
                        best[item] = (sim, -part - int(w))
        for item, (sim, begin) in best.items():
            yield t, item, sim, -begin - low


def _passes(benchmark: DataFrame, limit: int) -> Iterator[tuple[list, list]]:
    ids, texts, used = [], [], 0
    for row in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text").toLocalIterator():
        size = len((row.text or "").encode())
        if ids and used + size > limit:
            yield ids, texts
            ids, texts, used = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        used += size
    if ids:
        yield ids, texts


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each item's best window in each row of docs.

    A window has as many words as the item, or all of a text that has fewer. Words are runs of letters and digits in lower case; shingles are five words
    (an item of fewer: all its words). Similarity is the weighted Jaccard of
    the shingles with their counts. The benchmark goes to the tasks in passes
    of at most ``pass_bytes`` of text (or one item), each a scan of docs
    without a shuffle; rows of docs are never gathered.

    Null and empty texts and items match nothing; of equal windows the first
    is given; repeated rows of docs or of the benchmark are each reported; an
    empty table on either side gives no rows. Other columns aren't looked at.
    """
    kind = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.where("false").selectExpr("doc_id", "doc_id AS item_id", "0D AS similarity", "doc_id AS first_word", "doc_id AS n_words")
    for n, (ids, texts) in enumerate(_passes(benchmark, pass_bytes)):
        found = own.mapInArrow(_search(ids, texts, threshold, radius), kind)
        out = found if n == 0 else out.unionByName(found)
    return out


def _search(ids: list, texts: list, threshold: float, radius: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts, radius)
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                _, hashes, base = words(normalise(raw), offsets, _TABLE)
                rows = list(items.search(hashes, base, threshold))
                doc = part.column("doc_id").to_pylist()
                columns = [[doc[t] for t, *_ in rows], [ids[i] for _, i, *_ in rows], [s for *_, s, _ in rows], [b for *_, b in rows], [int(min(items.words[i], base[t + 1] - base[t])) for t, i, *_ in rows]]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return step


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of docs in which no item is found, with all their columns, after one scan for each pass of the benchmark."""
    for ids, texts in _passes(benchmark, pass_bytes):
        docs = keep_rows(docs, _clean(ids, texts, threshold, radius))
    return docs


def _clean(ids: list, texts: list, threshold: float, radius: int):
    made: list[Items] = []

    def judge(part: pa.RecordBatch) -> np.ndarray:
        if not made:
            made.append(Items(ids, texts, radius))
        raw, offsets = text_bytes(part.column("text"))
        _, hashes, base = words(normalise(raw), offsets, _TABLE)
        out = np.ones(part.num_rows, bool)
        out[[t for t, *_ in made[0].search(hashes, base, threshold)]] = False
        return out

    return judge
