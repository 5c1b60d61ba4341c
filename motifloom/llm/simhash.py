"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Of two fingerprints that
differ in at most five bits, some segment differs in at most one, so the two
share a signature: that segment with one bit left out. Every distinct
fingerprint is indexed under all 64 signatures (22 + 21 + 21 places to leave a
bit out), signatures are joined by equality, and each meeting is verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut
from .components import components

#: (lowest bit, width) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints under one signature that one task compares; larger groups are compared in blocks.
BLOCK = 8192


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a whole text: lower-case A-Z, white-space words, shingles with repeats, XXH64 with seed 42."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(ws)
    if not n:
        return 0
    line = b" ".join(ws)
    if n <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in ws])
    begins = [0, *(ends[: n - width]).tolist()]
    digest = xxhash.xxh64_intdigest
    hs = np.array([digest(line[i:j], 42) for i, j in zip(begins, (ends[width - 1 :] - 1).tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hs), 4096):
        part = np.ascontiguousarray(hs[at : at + 4096].astype("<u8")).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hs), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp) with fp the fingerprint as a signed long; null and empty texts have 0."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                fps = np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(step, "doc_id long, fp long")


def signatures(fp: np.ndarray) -> np.ndarray:
    """The 64 signatures of each fingerprint: segment and left-out place above, the segment's other bits below."""
    fp = fp.view(np.uint64)
    out = np.empty((len(fp), 64), np.int64)
    at = 0
    for low, width in SEGMENTS:
        segment = (fp >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for place in range(width):
            out[:, at] = (segment & np.uint64(~(1 << place) & (1 << width) - 1)) | np.uint64(at << 22)
            at += 1
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.asarray(batch.column("fp"))
        for at in range(0, len(fps), 4096):
            part = fps[at : at + 4096]
            yield pa.record_batch([pa.array(signatures(part).ravel()), pa.array(np.repeat(part, 64))], names=["sig", "fp"])


def links_of(sig: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join, under each signature, all fingerprints linked there (a forest; sig is sorted)."""
    fp = fp.view(np.uint64)
    heads = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    sizes = np.diff(np.r_[heads, len(sig)])
    a, b = [], []
    short = np.repeat(sizes <= 32, sizes)
    d = 1
    while True:
        i = np.flatnonzero((sig[d:] == sig[:-d]) & short[d:]) if d < len(sig) else ()
        if not len(i):
            break
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius]
        a.append(fp[i])
        b.append(fp[i + d])
        d += 1
    for head, size in zip(heads[sizes > 32], sizes[sizes > 32], strict=True):
        group = fp[head : head + size]
        label = np.arange(size)
        for i in range(size - 1):
            near = i + 1 + np.flatnonzero(np.bitwise_count(group[i + 1 :] ^ group[i]) <= radius)
            fresh, first = np.unique(label[near], return_index=True)
            other = fresh != label[i]
            if other.any():
                a.append(np.repeat(group[i], other.sum()))
                b.append(group[near[first[other]]])
                label[np.isin(label, fresh[other])] = label[i]
    join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
    return join(a), join(b)


def _match(radius: int, block: int):
    """Over rows sorted by signature: links, and the rows of signatures with over ``block`` fingerprints, numbered."""

    def out(a=(), b=(), sig=(), idx=(), fp=()):
        n, m = len(a), len(sig)
        null = lambda k: pa.nulls(k, pa.int64())
        cat = lambda x, y: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()), y if isinstance(y, pa.Array) else pa.array(y, pa.int64())])
        return pa.record_batch([cat(a, fp), cat(b, null(m)), cat(null(n), sig), cat(null(n), idx)], names=["a", "b", "sig", "idx"])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = f = np.zeros(0, np.int64)
        hot, seen = None, 0  # the signature being passed on, and its rows so far
        for batch in batches:
            k = np.concatenate([k, np.asarray(batch.column("sig"))])
            f = np.concatenate([f, np.asarray(batch.column("fp"))])
            while len(k):
                if hot is not None:
                    n = int(np.searchsorted(k, hot, "right"))
                    if n:
                        yield out(sig=k[:n], idx=np.arange(seen, seen + n), fp=f[:n])
                        k, f, seen = k[n:], f[n:], seen + n
                    if len(k):
                        hot = None
                    continue
                last = int(np.searchsorted(k, k[-1]))
                yield from work(k[:last], f[:last], out)
                k, f = k[last:], f[last:]
                if len(k) > block:
                    hot, seen = k[-1], 0
                    continue
                break
        if len(k):
            yield from work(k, f, out)

    def work(k, f, out):
        if not len(k):
            return
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.r_[heads, len(k)])
        big = np.repeat(sizes > block, sizes)
        if big.any():
            idx = np.arange(len(k)) - np.repeat(heads, sizes)
            yield out(sig=k[big], idx=idx[big], fp=f[big])
        a, b = links_of(k[~big], f[~big], radius) if not big.all() else ((), ())
        if len(a):
            yield out(a=a, b=b)

    return step


def fingerprint_links(fps: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most ``radius`` (up to 5) bits apart.

    Under each signature the links found make a forest with the same connected
    parts as all links there: nothing linked stays apart, and a dense group
    gives no more links than rows. A signature with over ``block``
    fingerprints is dealt out anew in blocks, each pair of blocks a task's
    work, so no task holds more than ``block`` of one group.
    """
    if not 0 <= radius <= 5:
        raise ValueError("one left-out bit in three segments covers radius 0 to 5")
    kinds = "a long, b long, sig long, idx long"
    sorted_by = lambda df: df.repartition(F.col("sig")).sortWithinPartitions("sig", "fp")
    found = cut(sorted_by(fps.select("fp").distinct().mapInArrow(_index, "sig long, fp long")).mapInArrow(_match(radius, block), kinds), "met")
    links, hot = found.where("sig is null").select("a", "b"), found.where("sig is not null")
    if hot.isEmpty():
        return links.distinct()
    half = block // 2
    number = hot.groupBy("sig").agg((F.max("idx") / half).cast("long").alias("last"))
    c, j = (F.col("idx") / half).cast("long"), F.col("j")
    dealt = (
        hot.join(number, "sig")
        .select("sig", F.col("a").alias("fp"), c.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("j"))
        .select(F.xxhash64("sig", F.least("c", j), F.greatest("c", j)).alias("sig"), "fp")
    )
    more = sorted_by(dealt).mapInArrow(_match(radius, 1 << 30), kinds).select("a", "b")
    return links.unionByName(more).distinct()


def near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id.

    Equal fingerprints are gathered first, so exact copies cost one index
    entry however many they are. Two fingerprints link at ``radius`` or fewer
    differing bits; component_id is the smallest doc_id reachable over links,
    the document's own included.

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows stay repeated; rows with a null doc_id share in fingerprints
    but never give the id. Other columns of docs are not looked at. An empty
    table gives an empty result.
    """
    own = cut(fingerprints(docs, width), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(fingerprint_links(nodes, radius))
    # written, so that the join shuffles both sides for itself and the fingerprints of a large component can be split
    named = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "named")
    ids = cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = named.join(ids, "root").select("fp", "component_id")
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4, width: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates, that of the smallest doc_id, with all its columns.

    Of rows that share that doc_id the one of the shortest text stays, of
    equally long ones that of the least hash of text, then of all columns
    (maps aside). Rows with a null doc_id can't be named as copies and stay.
    """
    firsts = near_duplicates(docs, radius, width).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rank = F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.xxhash64("text").alias("t"), F.xxhash64(*plain).alias("a"))
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), rank.alias("rank"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = rows.join(firsts, "id", "left_semi").groupBy("id").agg(F.min_by("row", "rank").alias("row")).select("row.*")
    return kept.unionByName(docs.where("doc_id IS NULL"))
