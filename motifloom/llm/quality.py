"""Quality classifier by co-training on two views of a document.

One view is the content of the text: its words by hash, repeats, marks, capitals,
word lengths. The other is what a page says about itself: language, source, length, layout of its
lines. Each has a logistic classifier. Over some rounds each labels those of all
unlabelled documents that it is surest of for the other to learn from: features
are written once, tasks keep their surest rows, and the driver gets so many rows a
label and round. Both are then calibrated on labelled documents and their logits
combined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, cut, drop_cut, shingle_hashes, text_bytes, words

#: Labelled documents that training reads at most.
MAX_LABELLED = 5000
#: Buckets of words in the content view, and its other features.
WORDS, COUNTS = 128, 9
ROUNDS = 4
#: Documents of each label that a view passes to the other in a round, and how sure it has to be.
PASSED, SURE = 150, 0.95
SPAN = 8
LANGS, SOURCES = 8, 32

_SYMBOL, _UPPER, _LOWER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_STOP[[ord(c) for c in "!?;:"]] = True


def content_view(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Content features of texts laid end to end, a row each; a text without a word has zeros."""
    n = len(offsets) - 1
    starts, hashes, base = words(raw, offsets)
    count = np.diff(base).astype(float)
    most = np.maximum(count, 1)
    doc = np.repeat(np.arange(n), np.diff(base))
    per_doc = lambda flag, where=doc: np.bincount(where[flag], minlength=n).astype(float)
    byte = lambda table: np.diff(np.r_[0, np.cumsum(table[raw])][offsets]).astype(float)
    order = np.lexsort((hashes, doc))
    new = np.ones(len(doc), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    unique = per_doc(new, doc[order])
    same = np.zeros(len(doc), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    spans = shingle_hashes(hashes, SPAN)
    whole = np.flatnonzero(doc[: len(spans)] == doc[SPAN - 1 :]) if len(spans) else np.zeros(0, int)
    spans, where = spans[whole], doc[whole]
    order = np.lexsort((spans, where))
    pair = (spans[order][1:] == spans[order][:-1]) & (where[order][1:] == where[order][:-1])
    again = np.zeros(len(whole), bool)
    again[order[1:][pair]] = again[order[:-1][pair]] = True
    edge = np.zeros(len(doc) + SPAN + 1, np.int64)
    np.add.at(edge, whole[again], 1)
    np.add.at(edge, whole[again] + SPAN, -1)
    covered = np.cumsum(edge)[: len(doc)] > 0
    upper, lower = byte(_UPPER), byte(_LOWER)
    size = np.diff(offsets).astype(float)
    bucket = (hashes % np.uint64(WORDS)).astype(np.int64)
    known = np.bincount(doc * WORDS + bucket, minlength=n * WORDS).reshape(n, WORDS)
    return np.c_[
        np.minimum(byte(_SYMBOL) / most, 1),
        np.minimum(byte(_STOP) / most, 1),
        upper / np.maximum(upper + lower, 1),
        np.where(count > 0, 1 - unique / most, 0),
        per_doc(same) / most,
        per_doc(covered) / most,
        np.minimum(byte(_DIGIT) / np.maximum(size, 1), 1),
        np.minimum((size - count) / most, 40) / 10,
        np.log1p(count) / 10,
        np.sqrt(known / most[:, None]),
    ]


def page_view(raw: np.ndarray, offsets: np.ndarray, langs: list, sources: list) -> np.ndarray:
    """Metadata features: language and source by hash, length, lines; null is a value of its own."""
    n, size = len(offsets) - 1, np.diff(offsets).astype(float)
    lines = np.diff(np.r_[0, np.cumsum(raw == 10)][offsets]) + 1.0
    out = np.zeros((n, LANGS + SOURCES + 3))
    for values, low, buckets in ((langs, 0, LANGS), (sources, LANGS, SOURCES)):
        place = {v: low + (xxhash.xxh64_intdigest("" if v is None else f"={v}") % buckets) for v in set(values)}
        out[np.arange(n), [place[v] for v in values]] = 1
    out[:, -3:] = np.c_[np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10]
    return out


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = text_bytes(part.column("text"))
    return content_view(raw, offsets), page_view(raw, offsets, part.column("lang").to_pylist(), part.column("source").to_pylist())


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-6] = 1
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        w, keep = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], ridge), 1e-6]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep), z.T @ (p - y) + keep * w)
            w = w - np.clip(step, -3, 3)
        return cls(mean, scale, w)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.c_[(x - self.mean) / self.scale, np.ones(len(x))] @ self.weight, -30, 30)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(x)))


@dataclass
class Model:
    views: tuple[Logistic, Logistic]
    calibrated: tuple[Logistic, Logistic]
    combined: Logistic

    def score(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of each view, and of both together."""
        logits = [v.logit(x)[:, None] for v, x in zip(self.views, (a, b), strict=True)]
        each = [c.logit(x) for c, x in zip(self.calibrated, logits, strict=True)]
        sure = lambda z: 1 / (1 + np.exp(-z))
        return sure(each[0]), sure(each[1]), self.combined.probability(np.c_[each[0], each[1]])


Pool = Callable[[list[Logistic], list[set], list[int]], list[tuple[list[int], np.ndarray, np.ndarray]]]


def fit(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool | None, rounds: int = ROUNDS) -> Model | None:
    """Co-train on labelled rows of both views and what ``pool`` finds in the unlabelled ones; None without both labels.

    pool(models, taken, most): for each pupil view the rows, with its features and
    labels, that the other view is surest of, ``most`` of each label at most,
    without those ``taken`` before.
    """
    if not len(y) or y.min() == y.max():
        return None
    odd = np.arange(len(y)) % 4 == 3  # a quarter is kept for calibration
    if odd.sum() < 20 or y[odd].min() == y[odd].max() or y[~odd].min() == y[~odd].max():
        learn, judge = np.arange(len(y)), np.arange(len(y))
    else:
        learn, judge = np.flatnonzero(~odd), np.flatnonzero(odd)
    taught = [[(x[learn], y[learn])] for x in labelled]  # what each view has learnt from
    taken: list[set] = [set(), set()]
    models = [Logistic.fit(x[learn], y[learn]) for x in labelled]
    share = y[learn].mean()
    most = [int(PASSED * 2 * (share if label else 1 - share)) + 1 for label in (0, 1)]
    for _ in range(rounds if pool else 0):
        for pupil, (rows, x, label) in enumerate(pool(models, taken, most)):
            taken[pupil].update(rows)
            if len(rows):
                taught[pupil].append((x, label))
        models = [Logistic.fit(*map(np.concatenate, zip(*t, strict=True))) if len(t) > 1 else m for t, m in zip(taught, models, strict=True)]
    logits = [m.logit(x)[:, None] for m, x in zip(models, labelled, strict=True)]
    calibrated = tuple(Logistic.fit(z[judge], y[judge]) for z in logits)
    both = np.c_[tuple(c.logit(z) for c, z in zip(calibrated, logits, strict=True))]
    return Model(tuple(models), calibrated, Logistic.fit(both[judge], y[judge]))


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _own(docs: DataFrame) -> DataFrame:
    col = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), col("text").alias("text"), col("lang").alias("lang"), col("source").alias("source"))


_WIDTH = COUNTS + WORDS
_ALL = _WIDTH + LANGS + SOURCES + 3


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch):
            x = np.c_[_views(part)].astype(np.float32)
            yield pa.record_batch([part.column("uid"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["uid", "y", "x"])


def _matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), _ALL).astype(float)
    return x[:, :_WIDTH], x[:, _WIDTH:]


def _surest(models: list[Logistic], taken: list[set], most: list[int]):
    """Of a task's rows the ``most`` surest of each label, for each pupil by the other view."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {(pupil, label): (np.zeros(0), np.zeros(0, np.int64)) for pupil in (0, 1) for label in (0, 1)}
        for batch in batches:
            uid, views = np.asarray(batch.column("uid")), _matrix(batch.column("x").to_pylist())
            for (pupil, label), (sure, ids) in kept.items():
                p = models[1 - pupil].probability(views[1 - pupil])
                p = p if label else 1 - p
                at = np.flatnonzero(p >= SURE)
                at = at[~np.isin(uid[at], list(taken[pupil]))]
                sure, ids = np.r_[sure, p[at]], np.r_[ids, uid[at]]
                best = np.lexsort((ids, -sure))[: most[label]]
                kept[pupil, label] = sure[best], ids[best]
        for (pupil, label), (sure, ids) in kept.items():
            yield pa.record_batch([pa.array([pupil] * len(ids), pa.int32()), pa.array([label] * len(ids), pa.int32()), pa.array(sure), pa.array(ids)], names=["pupil", "label", "sure", "uid"])

    return step


def unlabelled(features: DataFrame) -> Pool:
    """What views are surest of among all rows of a written table of features."""

    def pool(models: list[Logistic], taken: list[set], most: list[int]):
        each = cut(features.select("uid", "x").mapInArrow(_surest(models, taken, most), "pupil int, label int, sure double, uid long"), "surest")
        best = [each.where((F.col("pupil") == pupil) & (F.col("label") == label)).orderBy(F.desc("sure"), "uid").limit(most[label]) for pupil in (0, 1) for label in (0, 1)]
        rows = reduce(DataFrame.unionByName, best).collect()
        drop_cut(each)
        x = {r.uid: r.x for r in features.where(F.col("uid").isin([r.uid for r in rows])).select("uid", "x").collect()} if rows else {}
        out = []
        for pupil in (0, 1):
            own = sorted((r.uid, r.label) for r in rows if r.pupil == pupil)
            out.append(([u for u, _ in own], _matrix([x[u] for u, _ in own])[pupil], np.array([label for _, label in own])))
        return out

    return pool


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model | None:
    """Fit on at most so many labelled documents, and on all unlabelled ones.

    Labelled ones are the first by a hash of doc_id; held-out ids (crc32 of the
    id as text a multiple of 5) lend no label. The driver gets the features of
    labelled documents and of those that a view passes to the other.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    named = named.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = _own(docs)
    rows = own.join(F.broadcast(named), "doc_id", "left").withColumn("uid", F.monotonically_increasing_id())
    features = cut(rows.select("uid", "y", "text", "lang", "source").mapInArrow(_features, "uid long, y int, x binary"), "features")
    mine = features.where("y IS NOT NULL").orderBy(F.xxhash64("x"), "x").limit(max_labelled).select("y", "x").collect()
    model = fit(_matrix([r.x for r in mine]), np.array([r.y for r in mine]), unlabelled(features.where("y IS NULL")))
    drop_cut(features)
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, p_text, p_page (the views), score (both), keep (score from 0.5).

    Null texts count as empty; null or missing lang and source are values of
    their own. Without a model (labels of one kind only) every probability is
    1 and all is kept. Repeated rows stay; an empty table gives none; other
    columns aren't looked at.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                got = [np.ones(part.num_rows)] * 3 if model is None else model.score(*_views(part))
                got = [np.round(p, 9) for p in got]
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), *(pa.array(p, pa.float64()) for p in got), pa.array(got[2] >= 0.5)], names=["doc_id", "held_out", "p_text", "p_page", "score", "keep"])

    own = _own(docs).withColumn("held_out", held_out(F.col("doc_id")))
    return own.mapInArrow(step, "doc_id long, held_out boolean, p_text double, p_page double, score double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
