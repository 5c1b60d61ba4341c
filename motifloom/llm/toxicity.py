"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

Labels mark whole texts, but a text is toxic by a few of its words; so the SVM
scores words, and a text scores as its highest word. The kernel counts common
subsequences of three characters, weighted by LAMBDA for each character they
span: a word with characters put in, left out or changed stays close to the
one it hides, and words of one stem stay close to each other. The kernel to
some hundred landmarks, whitened, is the feature vector.

Training believes a word if several toxic texts and few others have it, and
takes the believed words together with disguises made of them (letters put in,
left out, doubled, changed, spread) as positives. Negatives are words of texts
that aren't toxic, mined over some rounds: those that score highest join the
negatives and the landmarks, so that the feature vectors tell apart what lies
close. A part of the training texts is kept back to place the boundary.

Only the text is ever an input of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, keep_rows

LAMBDA = 0.9
#: Labelled rows of each class that training reads at most.
MAX_TOXIC, MAX_OTHER = 2000, 3000
#: Landmarks: believed words, words mined from other texts in each round and in all, common words of other texts.
N_TOXIC, N_MINED, N_MINED_ALL, N_COMMON = 120, 220, 640, 40
#: Negatives: those of the highest scores, the most common, others by hash.
HARD, COMMON, PLAIN = 3000, 1500, 1500
#: A word is believed if so many toxic texts have it, and at most this share as many of the others.
BELIEVED, CLEAN_SHARE = 3, 0.3
MOST_BELIEVED = 800
#: Disguises of each of the most frequent believed words, as many as landmarks, and of each other one.
DISGUISES, FEW = 14, 4
ROUNDS = 4
#: Parts in which the training texts reach the driver, one after the other.
PARTS = 64
#: Costs of errors: on a believed word (times the root of its texts), the share of it on a disguise, on another word.
PULL, DISGUISED, PUSH = 40, 0.3, 100
#: A longer word is scored by overlapping pieces of this length, which cover it.
PIECE = 48
#: Words whose scores a worker keeps.
KEEP = 600_000

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INNER = re.compile(r"[\W\d_]+")
#: Digits and marks that stand for letters.
_ALIKE = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?<!\S)\w(?:[\s.*_-]\w){2,}(?!\S)")


def raw_words(text: str | None) -> set[str]:
    """Words of a text as they stand, and words spelled out letter by letter, joined."""
    low = (text or "").lower()
    out = set(low.split())
    for m in _SPACED.finditer(low):
        out.add(_INNER.sub("", m[0]))
    return out


def forms(word: str) -> set[str]:
    """What is scored for a word: without marks at its ends, without any but letters, with letters for alike digits, without one letter that spreads it; in pieces if long."""
    bare = _EDGE.sub("", word)
    ways = {bare}
    if not bare.isalpha():
        ways |= {_INNER.sub("", bare), _INNER.sub("", word.translate(_ALIKE))}
    ways |= {w[::2] for w in ways if len(w) >= 7 and w[1::2] == w[1] * (len(w) // 2)}
    out = set()
    for w in ways:
        out.update([w] if len(w) <= PIECE else (w[i : i + PIECE] for i in range(0, len(w) - PIECE // 2, PIECE // 2)))
    out.discard("")
    return out


def _self(codes: np.ndarray) -> np.ndarray:
    """The kernel of each word with itself; codes: words of equal length, a row each."""
    n, size = codes.shape
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    gap = np.arange(size)[None] - np.arange(size)[:, None]
    run = np.where(gap >= 0, LAMBDA ** np.maximum(gap, 0.0) * LAMBDA**2, 0).astype(np.float32)
    prior = np.ones((n, size + 1, size + 1), np.float32)
    for _ in (1, 2):
        now = np.zeros_like(prior)
        for i in range(1, size + 1):
            now[:, i, 1:] = np.float32(LAMBDA) * now[:, i - 1, 1:] + (same[:, i - 1] * prior[:, i - 1, :-1]) @ run
        prior = now
    return np.float32(LAMBDA**2) * (same * prior[:, :-1, :-1]).sum(axis=(1, 2))


class Kernel:
    """Normalised kernel of words to landmarks; what was computed is kept for later calls."""

    BLOCK = 32

    def __init__(self):
        self.rows: dict[str, int] = {}
        self.columns: dict[str, int] = {}
        self.value = np.zeros((0, 0), np.float32)

    def known(self, landmarks: list[str]) -> None:
        """Landmarks of calls to come."""
        new = [w for w in landmarks if w not in self.columns]
        if new:
            self.value = np.hstack([self.value, self._to(list(self.rows), new)])
        self.columns.update({w: len(self.columns) + i for i, w in enumerate(new)})

    def _to(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(landmarks)), np.float32)
        for at in range(0, len(landmarks) if words else 0, self.BLOCK):
            out[:, at : at + self.BLOCK] = Weights(landmarks[at : at + self.BLOCK])(words)
        return out

    def __call__(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        self.known(landmarks)
        new = list(dict.fromkeys(w for w in words if w not in self.rows))
        if new:
            self.value = np.vstack([self.value, self._to(new, list(self.columns))])
            self.rows.update({w: len(self.rows) + i for i, w in enumerate(new)})
        return self.value[np.ix_([self.rows[w] for w in words], [self.columns[w] for w in landmarks])]


class Weights:
    """Normalised kernels to fixed words, each or as a weighted sum, by one weight for each three characters.

    The kernel is a product of feature vectors, one feature for each three
    characters, so a sum over words needs no loop over them.
    """

    def __init__(self, words: list[str], weights: np.ndarray | None = None):
        marked = [f"^{w}$" for w in words]
        self.code = {c: i + 1 for i, c in enumerate(sorted(set("".join(marked))))}
        self.base = len(self.code) + 1
        self.table = np.zeros((self.base**3, 1 if weights is not None else len(words)), np.float32)
        for n, w in enumerate(marked):
            codes = np.array([[self.code[c] for c in w]])
            i, j, k, decay = self._triples(codes.shape[1])
            at = self._index(codes, i, j, k)[0]
            np.add.at(self.table[:, 0 if weights is not None else n], at, (1 if weights is None else weights[n]) * decay / np.sqrt(_self(codes)[0]))

    @staticmethod
    def _triples(size: int):
        got = _triples.get(size)
        if got is None:
            i, j, k = np.array([(i, j, k) for i in range(size) for j in range(i + 1, size) for k in range(j + 1, size)], np.int64).reshape(-1, 3).T
            got = _triples[size] = (i, j, k, (LAMBDA ** (k - i + 1.0)).astype(np.float32))
        return got

    def _index(self, codes, i, j, k):
        first = codes * self.base
        return (first[:, i] + codes[:, j]) * self.base + codes[:, k]

    def __call__(self, words: list[str]) -> np.ndarray:
        width = self.table.shape[1]
        out = np.zeros((len(words), width), np.float32)
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, ks in by_size.items():
            i, j, k, decay = self._triples(size + 2)
            step = max(1, min(512, 400_000 // max(1, len(i) * (1 + width // 4))))
            for at in range(0, len(ks), step):
                part = ks[at : at + step]
                text = "".join(f"^{words[m]}$" for m in part)
                raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), size + 2)
                kinds, inverse = np.unique(raw, return_inverse=True)
                codes = np.array([self.code.get(chr(c), 0) for c in kinds], np.int32)[inverse].reshape(raw.shape)
                out[part] = (decay @ self.table[self._index(codes, i, j, k)]) / np.sqrt(np.maximum(_self(raw), 1e-12))[:, None]
        return out


_triples: dict = {}


@dataclass
class Model:
    landmarks: list[str]
    white: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    none: float = 0.0  # of a text without words
    folded: Weights | None = field(default=None, repr=False)

    def margins(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros(0)
        self.folded = self.folded or Weights(self.landmarks, self.white @ self.weight)
        return self.folded(words)[:, 0] + self.bias

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, active: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Linear SVM on the rows of x with squared hinge loss, by Newton steps on the active ones (a first guess may be given), in blocks."""
    size = x.shape[1]
    ridge = np.diag(np.r_[np.ones(size), 1e-3])
    w = np.zeros(size + 1)
    active = np.ones(len(x), bool) if active is None else active
    for _ in range(40):
        gram, pull = ridge.copy(), np.zeros(size + 1)
        at = np.flatnonzero(active)
        for i in range(0, len(at), 1024):
            part = at[i : i + 1024]
            z = np.c_[x[part], np.ones(len(part))].astype(float)
            a = z * cost[part, None]
            gram += a.T @ z
            pull += a.T @ y[part]
        w = np.linalg.solve(gram, pull)
        now = y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _platt(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, with smoothed targets."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    t = np.where(y > 0, hi, lo)
    x = np.c_[s, np.ones(len(s))]
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - t) + 1e-3 * np.array([w[0], 0])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def bag_ids(texts: Iterable[str | None], ids: dict[str, int]) -> list[np.ndarray]:
    """The scored forms of each text's words as sorted numbers; new words are numbered in ``ids``."""
    out = []
    for text in texts:
        own = set().union(*map(forms, raw_words(text)))
        out.append(np.array(sorted(ids.setdefault(w, len(ids)) for w in sorted(own)), np.int32))
    return out


def disguises(word: str, letters: str, rng: np.random.Generator, n: int = DISGUISES) -> list[str]:
    """Ways of hiding a word: letters put in (one, two, or one between all), left out, doubled, changed or swapped."""
    out, size = [], len(word)
    pick = lambda: letters[int(rng.integers(len(letters)))]
    for k in range(n):
        i, kind = int(rng.integers(size)), k % 7
        if kind in (0, 4):
            out.append(word[: i + 1] + pick() + word[i + 1 :])
        elif kind == 1:
            out.append(word[:i] + word[i + 1 :] if size > 3 else word + word[-1])
        elif kind == 2:
            out.append(pick().join(word) if k % 14 < 7 else "".join(c + pick() for c in word))
        elif kind == 3:
            out.append(word[:i] + pick() + word[i + 1 :])
        elif kind == 5:
            j = int(rng.integers(size + 1))
            v = word[:j] + pick() + word[j:]
            out.append(v[: i + 1] + pick() + v[i + 1 :])
        else:
            out.append(word[:i] + word[i] + word[i:] if k % 14 < 7 else word[:i] + word[i + 1 : i + 2] + word[i] + word[i + 2 :])
    return [w for w in out if w != word]


def _one_of_copies(bags: list[np.ndarray]) -> list[list[int]]:
    """Texts in groups of near copies: those that share at least 7 of 16 least hashes of their words, found by two of them at once."""
    spread = np.random.default_rng(1).integers(1, 1 << 61, 16, dtype=np.uint64) | np.uint64(1)
    root = list(range(len(bags)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen: dict[tuple, int] = {}
    least = np.zeros((len(bags), 16), np.uint64)
    for i, bag in enumerate(bags):
        if len(bag):
            with np.errstate(over="ignore"):
                least[i] = ((bag.astype(np.uint64) + np.uint64(1))[:, None] * spread * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)).min(axis=0)
        for k in range(0, 16, 2):
            j = seen.setdefault((k, int(least[i, k]), int(least[i, k + 1])), i)
            if j != i and (least[j] == least[i]).sum() >= 7:
                root[find(i)] = find(j)
    groups: dict[int, list[int]] = {}
    for i in range(len(bags)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def fit(bags: list[np.ndarray], toxic: np.ndarray, ids: dict[str, int], rounds: int = ROUNDS) -> Model | None:
    """A model from texts' words (by number) and labels; None without both labels or any word of three letters.

    Near copies count as one text. One of six texts is kept back to place the
    boundary, if both labels are among them ten times; else all place it.
    """
    names = list(ids)
    texts = [(np.unique(np.concatenate([bags[i] for i in g])), int(max(toxic[i] for i in g))) for g in _one_of_copies(bags)]
    back = [(b, t) for b, t in texts if zlib.crc32(b.tobytes()) % 6 == 0]
    if min(sum(t for _, t in back), sum(1 - t for _, t in back)) >= 10:
        texts = [(b, t) for b, t in texts if zlib.crc32(b.tobytes()) % 6]
    else:
        back = texts
    pos, neg = [b for b, t in texts if t], [b for b, t in texts if not t]
    if not pos or not neg:
        return None
    count = lambda bs: np.bincount(np.concatenate(bs), minlength=len(names))
    in_pos, in_neg = count(pos), count(neg)
    long = np.array([len(w) >= 3 for w in names], bool)
    rare = (in_neg / len(neg)) <= CLEAN_SHARE * (in_pos / len(pos)) / 2
    sure = long & rare & (in_neg <= CLEAN_SHARE * in_pos)
    least = next((n for n in (BELIEVED, 2, 1) if (sure & (in_pos >= n)).any()), None)
    if least is None:
        return None
    by = lambda at, key: sorted(at.tolist(), key=lambda i: (-key[i], names[i]))
    believed = by(np.flatnonzero(sure & (in_pos >= least)), in_pos)[:MOST_BELIEVED]
    others = np.flatnonzero((in_neg > 0) & ~sure)
    plain = sorted(others.tolist(), key=lambda i: zlib.crc32(names[i].encode("utf-8", "surrogatepass")))[:PLAIN]
    common = by(others, in_neg)[:COMMON]
    letters = "".join(c for c, _ in Counter("".join(names[i] for i in common)).most_common(26)) or "x"
    rng = np.random.default_rng(0)
    hidden = [(v, i) for k, i in enumerate(believed) for v in disguises(names[i], letters, rng, DISGUISES if k < N_TOXIC else FEW)]
    yes = [names[i] for i in believed] + [v for v, _ in hidden]
    gain = np.sqrt([float(in_pos[i]) for i in believed] + [float(in_pos[i]) for _, i in hidden])
    first = [names[i] for i in believed[:N_TOXIC]]
    pool = [names[i] for i in others.tolist()]
    score = np.zeros(len(pool))
    mined: dict[int, None] = {}
    marks: list[str] = []
    place = {i: k for k, i in enumerate(others.tolist())}
    model, kernel = None, Kernel()
    for k in range(rounds):
        if model is None:  # before any scores: closeness to the believed words
            near = Weights(first, np.ones(len(first)) / len(first))
            score = near(pool)[:, 0]
        top = np.argsort(-score, kind="stable")[:HARD].tolist()
        mined.update(dict.fromkeys(top[: HARD // 2] if k else ()))
        no = sorted({*top, *mined, *(place[i] for i in plain), *(place[i] for i in common)})
        marks = list(dict.fromkeys(marks + [pool[i] for i in top[:N_MINED]]))[-N_MINED_ALL:]
        landmarks = list(dict.fromkeys(first + marks + [names[i] for i in common if len(names[i]) >= 4][:N_COMMON]))
        values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(float))
        keep = values > 1e-3
        white = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
        words = yes + [pool[i] for i in no]
        x = kernel(words, landmarks) @ white
        cost = np.r_[PULL * gain * np.r_[np.ones(len(believed)), np.full(len(hidden), DISGUISED)], PUSH * np.sqrt(in_neg[others[no]])]
        y = np.r_[np.ones(len(yes)), -np.ones(len(no))]
        weight, bias = _svm(x, y, cost, None if model is None else y * np.r_[model.margins(yes), score[no]] < 1)
        model = Model(landmarks, white, weight, bias)
        score = model.margins(pool)
    told = sorted({i for b, _ in back for i in b.tolist()})
    value = np.zeros(len(names))
    value[told] = model.margins([names[i] for i in told])
    top, y = (np.array(c) for c in zip(*((value[b].max(), t) for b, t in back if len(b)), strict=True))
    model.none = float(np.median(top[y == 0]))
    model.slope, _ = _platt(top, y.astype(float))
    model.shift = -model.slope * _boundary(top, y)
    return model


def _boundary(margin: np.ndarray, y: np.ndarray) -> float:
    """Where texts part best by F1: the mean of the boundaries within two thousandths of the best."""
    order = np.argsort(-margin, kind="stable")
    value, hits = margin[order], np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.r_[value[:-1] > value[1:], True]  # equal margins aren't parted
    lower = np.r_[value[1:], value[-1] - 1]
    good = last & (f1 >= f1[last].max() - 0.002)
    return float(((value + lower) / 2)[good].mean())


def training_rows(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER) -> DataFrame:
    """(text, toxic) of at most so many labelled documents, those of the remainders 1 to 4 of crc32(doc_id) mod 5.

    The documents are the first of each class by a hash of doc_id, so a rerun
    takes the same. The ids chosen are bounded and so may be broadcast; of rows
    that share an id one counts, so the rows are bounded as well.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    named = named.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    key = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = named.where("toxic = 1").orderBy(*key).limit(max_toxic).unionByName(named.where("toxic = 0").orderBy(*key).limit(max_other))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(part), "doc_id").repartition(PARTS, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def held_out(doc_id):
    """True where crc32 of the id as text is a multiple of 5 (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, **limits: int) -> Model | None:
    ids: dict[str, int] = {}
    toxic: list[int] = []

    def texts():
        for row in training_rows(docs, labels, **limits).sortWithinPartitions("doc_id").toLocalIterator():
            toxic.append(row.toxic)
            yield row.text

    bags = bag_ids(texts(), ids)
    return fit(bags, np.array(toxic, int), ids)


_kept: dict = {}


def _margins(model: Model, texts: list[str | None]) -> np.ndarray:
    """The highest margin of a word of each text; scores of words are kept from call to call."""
    if _kept.get("model") != (model.landmarks, model.bias):
        _kept.clear()
        _kept.update(model=(model.landmarks, model.bias), scores={})
    bags, known = [raw_words(t) for t in texts], _kept["scores"]
    if len(known) > KEEP:
        known.clear()
    fresh = [w for w in set().union(*bags) if w not in known]
    parts = [forms(w) for w in fresh]
    bare = list(set().union(*parts)) if parts else []
    value = dict(zip(bare, model.margins(bare).tolist(), strict=True))
    for w, ps in zip(fresh, parts, strict=True):
        known[w] = max((value[p] for p in ps), default=-np.inf)
    top = np.array([max(map(known.__getitem__, b), default=-np.inf) for b in bags])
    return np.where(np.isfinite(top), top, model.none)


def _probabilities(model: Model | None, part: pa.RecordBatch) -> np.ndarray:
    if model is None:
        return np.zeros(part.num_rows)
    return np.round(model.probability(_margins(model, part.column("text").to_pylist())), 9)


def _score(model: Model | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                p = _probabilities(model, part)
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return step


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) for each row of docs.

    Null and empty texts, and those of marks alone, score as the middle one of the texts that aren't toxic. Without a model (no
    labels of both kinds) every score is 0. Repeated rows stay; an empty table
    gives none; other columns aren't looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return own.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all their columns and no shuffle; empty and null texts stay."""
    model = train(docs, labels)
    return keep_rows(docs, lambda part: _probabilities(model, part) < 0.5)
