"""Removal of long byte strings that stand at two places or more of a corpus, by external induced suffix sorting.

The suffixes of all texts are dealt out to shards so that two with equal first
``SIZE`` bytes meet in one: a suffix goes by the least hash of the ``GRAM``-byte
strings within its first SIZE bytes. Neighbouring suffixes mostly have the same
one, so what travels are pieces of text: a run of suffix starts and the SIZE - 1
bytes behind it. A piece whose hash stands nowhere else, in no second place of the
piece either, has no repeat and doesn't travel. Equal pieces are counted before they travel and go to their
shard once. Each shard of about ``SHARD`` bytes is suffix-sorted with common-prefix
values by induction with queues that spill to disk (``inducing``); neighbours
that share SIZE bytes are repeats. A hash with over ``HOT`` different pieces is
dealt out anew, suffix by suffix, by a 128-bit hash of their SIZE bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import inducing
from .common import chunks, cut, mix, text_bytes

#: Bytes of a string that is removed.
SIZE = 400
#: Bytes of the strings by whose hashes suffixes are dealt out.
GRAM = 48
#: Suffix starts in a piece at most.
RUN = 1024
#: Bytes sorted in one task, about.
SHARD = 3 << 20
#: Different pieces of one hash that go to one shard; 5,000 have about 3 MB.
HOT = 5_000
#: Entries that the queues of a shard keep in memory.
MEMORY = 1 << 22
#: Multiplier of the hashes.
BASE = 0x9E3779B97F4A7C15


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` bytes from each place."""
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    part, size, out, done, rest = raw.astype(np.uint64) + np.uint64(1), 1, None, 0, gram
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                if out is None:
                    out = part.copy()
                else:
                    m = min(len(out), len(part) - done)
                    out = out[:m] * power(size) + part[done : done + m]
                done += size
            rest >>= 1
            if rest:
                part = part[:-size] * power(size) + part[size:]
                size *= 2
    return mix(out[: len(raw) - gram + 1])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    size = 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[: len(values) - width + size], values[width - size :]) if size < width else values


def _counts(grams: np.ndarray, key: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
    """How often the least hash of each run stands in the run's piece."""
    room = np.zeros(width - 1, np.uint64)
    most = ~least(~np.concatenate([room, key, room]), width)  # the largest of the least hashes of the windows around each place
    at = np.flatnonzero(most == grams)
    low, high = np.searchsorted(at, starts), np.searchsorted(at, stops)
    of = np.repeat(np.arange(len(starts)), high - low)
    place = np.arange(len(of)) - np.repeat(np.cumsum(high - low) - high, high - low)
    return np.bincount(of, weights=grams[at[place]] == key[starts[of]], minlength=len(starts))


def _cutting(size: int, gram: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                if len(raw) < size:
                    continue
                width = size - gram + 1
                grams = gram_hashes(raw, gram)
                key = least(grams, width)
                begin, end = offsets[:-1], offsets[1:] - size + 1  # of starts with size bytes in their text
                long = np.flatnonzero(end > begin)
                edge = np.zeros(len(key) + 1, np.int8)
                edge[begin[long]] += 1
                edge[end[long]] -= 1
                inside = np.cumsum(edge[:-1]).astype(bool)
                first = inside.copy()
                first[1:] &= ~inside[:-1] | (key[1:] != key[:-1])
                starts = np.flatnonzero(first)
                stop = inside.copy()
                stop[:-1] &= ~inside[1:] | first[1:]
                stops = np.flatnonzero(stop) + 1
                parts = -(-(stops - starts) // RUN)
                if len(parts) and parts.max() > 1:
                    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    starts, stops = np.repeat(starts, parts) + nth * RUN, np.repeat(stops, parts)
                    stops = np.minimum(stops, starts + RUN)
                if not len(starts):
                    continue
                again = _counts(grams, key, starts, stops + width - 1, width) > 1
                view = memoryview(raw)
                own = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), (stops + size - 1).tolist(), strict=True)]
                of = np.searchsorted(offsets, starts, "right") - 1
                uid = np.asarray(part.column("uid"))[of]
                yield pa.record_batch(
                    [pa.array(uid), pa.array(starts - offsets[of]), pa.array((stops - starts).astype(np.int32)), pa.array(key[starts].view(np.int64)), pa.array(np.array(own, np.uint64).view(np.int64)), pa.array(again)],
                    names=["uid", "start", "n", "gram", "piece", "again"],
                )

    return step


def _extracting(size: int):
    """Pieces of texts; asked for as a list of (start, n, gram, piece, known)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                wanted = part.column("wanted")
                of = np.repeat(np.arange(part.num_rows), np.asarray(wanted.value_lengths()))
                flat = wanted.flatten()
                starts, n = np.asarray(flat.field("start")) + offsets[of], np.asarray(flat.field("n"))
                view = memoryview(raw)
                own = [bytes(view[a:b]) for a, b in zip(starts.tolist(), (starts + n + size - 1).tolist(), strict=True)]
                yield pa.record_batch([flat.field("gram"), flat.field("piece"), flat.field("known"), pa.array(own, pa.binary())], names=["gram", "piece", "known", "bytes"])

    return step


def _ranges(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, marks.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _sorting(size: int, memory: int):
    """One shard: its pieces laid end to end, apart by byte 0 (no byte of UTF-8 is 255), and sorted."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws, sizes, rows = [], [], []
        for batch in batches:
            own = batch.column("bytes").to_pylist()
            raws.append(np.frombuffer(b"".join(own), np.uint8))
            sizes.append(np.array([len(x) for x in own], np.int64))
            rows.append(batch.select(["gram", "piece", "known"]))
        if not rows or not sum(b.num_rows for b in rows):
            return
        length = np.concatenate(sizes)
        begin = np.cumsum(length + 1) - length - 1
        text = np.zeros(int((length + 1).sum()), np.uint8)
        inside = np.ones(len(text), bool)
        inside[begin + length] = False
        text[inside] = np.concatenate(raws) + np.uint8(1)
        raws.clear()
        known = np.concatenate([np.asarray(b.column("known")) for b in rows])
        starts = np.zeros(len(text) + 1, np.int8)  # what counts: starts of whole strings in pieces not known to repeat
        starts[begin[~known]] += 1
        starts[(begin + length - size + 1)[~known]] -= 1
        marks = inducing.repeated(text, size, memory) & np.cumsum(starts[:-1]).astype(bool)
        a, b = _ranges(marks)
        of = np.searchsorted(begin, a, "right") - 1
        ids = pa.Table.from_batches(rows).take(pa.array(of))
        out = pa.table({"gram": ids.column("gram"), "piece": ids.column("piece"), "a": pa.array(a - begin[of]), "b": pa.array(b - begin[of])})
        yield from out.to_batches()

    return step


def _single(size: int):
    """The strings of pieces one by one, by a 128-bit hash."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                piece = batch.column("bytes")[k].as_py()
                n = len(piece) - size + 1
                own = [xxhash.xxh3_128_digest(piece[i : i + size]) for i in range(n)]
                yield pa.record_batch([*(batch.column(c).take(pa.array([k] * n)) for c in ("gram", "piece", "known")), pa.array(np.arange(n)), pa.array(own, pa.binary())], names=["gram", "piece", "known", "a", "string"])

    return step


def _removing(size: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw, offsets = text_bytes(part.column("text"))
                of = np.repeat(np.arange(part.num_rows), np.asarray(part.column("spans").value_lengths()))
                flat = part.column("spans").flatten()
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, np.asarray(flat.field("a")) + offsets[of], 1)
                np.add.at(edge, np.asarray(flat.field("b")) + size - 1 + offsets[of], -1)
                gone = np.cumsum(edge[:-1]) > 0
                out = []
                for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    own = gone[x:y]
                    out.append((int(own.sum()), len(_ranges(own)[0]), raw[x:y][~own].tobytes()))
                removed, runs, kept = zip(*out, strict=True)
                yield pa.record_batch([part.column("uid"), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "replace") for x in kept])], names=["uid", "n_removed", "n_spans", "kept_sha256", "kept"])

    return step


def repeats(texts: DataFrame, size: int = SIZE, gram: int = GRAM, shard: int = SHARD, hot: int = HOT, memory: int = MEMORY) -> DataFrame:
    """(uid, a, b): ranges of places from which ``size`` bytes also begin at another place, of texts (uid, text); uids differ."""
    gram = min(gram, size)
    runs = cut(texts.select("uid", "text").mapInArrow(_cutting(size, gram), "uid long, start long, n int, gram long, piece long, again boolean"), "repeats-runs")
    pieces = runs.groupBy("gram", "piece", "n").agg(F.count("*").alias("copies"), F.bool_or("again").alias("again"), F.min(F.struct("uid", "start")).alias("at"))
    found = cut(pieces, "repeats-pieces")
    many = found.groupBy("gram").agg(F.count("*").alias("different"), F.bool_or(F.col("again") & (F.col("copies") == 1)).alias("within")).where("different > 1 OR within")
    rows = found.join(many, "gram").select(F.col("at.uid").alias("uid"), F.struct(F.col("at.start").alias("start"), "n", "gram", "piece", (F.col("copies") > 1).alias("known")).alias("one"), "different")
    wanted = cut(rows.groupBy("uid").agg(F.collect_list(F.when(F.col("different") <= hot, F.col("one"))).alias("wanted"), F.collect_list(F.when(F.col("different") > hot, F.col("one"))).alias("hot")), "repeats-wanted")
    sums = wanted.agg(F.sum(F.aggregate("wanted", F.lit(0).cast("long"), lambda acc, x: acc + x["n"] + size - 1)).alias("bytes"), F.sum(F.size("hot")).alias("hot")).first()
    kind = "gram long, piece long, known boolean, bytes binary"
    asked = lambda c: texts.join(wanted.where(F.size(c) > 0).select("uid", F.col(c).alias("wanted")), "uid").select("text", "wanted").mapInArrow(_extracting(size), kind)
    sets = [found.where("copies > 1").select("gram", "piece", F.lit(0).cast("long").alias("a"), F.col("n").cast("long").alias("b"))]
    if sums["bytes"]:
        n = -(-int(sums["bytes"]) // shard)
        sets.append(cut(asked("wanted").repartition(n, "gram").mapInArrow(_sorting(size, memory), "gram long, piece long, a long, b long"), "repeats-sorted"))
    if sums["hot"]:
        each = cut(asked("hot").mapInArrow(_single(size), "gram long, piece long, known boolean, a long, string binary"), "repeats-single")
        twice = each.groupBy("string").agg(F.count("*").alias("k"), F.bool_or("known").alias("any")).where("k > 1 OR any").select("string")
        sets.append(each.where("NOT known").join(twice, "string").select("gram", "piece", "a", (F.col("a") + 1).alias("b")))
    marks = sets[0]
    for s in sets[1:]:
        marks = marks.unionByName(s)
    return runs.join(marks, ["gram", "piece"]).select("uid", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("b")).alias("b"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, with_text: bool = False, **more) -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the text that is left) for each row of docs.

    Removed is every byte covered by a string of ``size`` bytes that also begins
    at another place of any text, the same one included; strings may overlap and
    are judged on the texts as given. Matches never cross texts. A null text is
    empty; a text shorter than ``size`` loses nothing. Repeated rows are texts of
    their own, so all their bytes go if there are ``size``. kept is bytes decoded
    as UTF-8, a cut character replaced. An empty table gives no rows; other columns
    are not read and may have any name.
    """
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    texts = cut(own.withColumn("uid", F.monotonically_increasing_id()), "repeats-texts")
    spans = repeats(texts, size, **more).groupBy("uid").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    kind = "uid long, n_removed long, n_spans long, kept_sha256 string, kept string"
    fields = ["uid", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    left = texts.join(spans, "uid").select("uid", "text", "spans").mapInArrow(_removing(size), kind).select(*fields)
    whole = texts.select("uid", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"), *([F.col("text")] if with_text else []))
    rows = whole.join(left, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    out = [F.col("key").alias(key), "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")]
    return rows.select(*out, *([F.coalesce("kept", "text").alias("kept")] if with_text else []))


#: The same rows in DuckDB: all strings of SIZE bytes by their digests, from texts as hexadecimal digits.
SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT r, i, md5(substr(x, 2 * i + 1, {2 * SIZE})) AS h FROM (SELECT r, x, unnest(range(len(x) // 2 - {SIZE - 1})) AS i FROM d)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
heads AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + {SIZE} THEN 1 ELSE 0 END AS head FROM again),
runs AS (SELECT r, min(i) AS a, max(i) + {SIZE} AS b FROM (SELECT r, i, sum(head) OVER (PARTITION BY r ORDER BY i) AS run FROM heads) GROUP BY r, run),
placed AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM runs),
left_ AS (SELECT p.r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || any_value(substr(x, 2 * m + 1)) AS kept
  FROM placed p JOIN d ON p.r = d.r JOIN (SELECT r, max(b) AS m FROM runs GROUP BY r) e ON p.r = e.r GROUP BY p.r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN left_ USING (r)"""
