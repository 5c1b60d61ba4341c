"""Personal data by patterns and a skip-chain conditional random field.

The base spans are those of four patterns and their checks. The field adds
spans: its nodes are the tokens with a digit or an at sign and those that repeat
an address's local part; chain links join tokens side by side, skip links join
tokens anywhere in a text that repeat or resemble each other (equal when bare of
marks, equal digits, equal local part), each to the last before it, so links
grow with tokens. Weights are learned from the base spans of a bounded sample by
pseudo-likelihood; loopy belief propagation gives each token's label, so that a
telephone number without its country code is found beside or apart from the
whole one. Base spans always stay. Every other token is clamped to no label.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

KINDS = ("email", "ip", "card", "phone")
#: Documents that training reads at most.
SAMPLE = 3000
#: Characters of a text in it, at most.
SAMPLE_CHARS = 20_000
#: Rounds of message passing, the share of a new message in each, and the probability from which a label counts.
ROUNDS, FRESH, SURE = 20, 0.6, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_MARKS = "\"'.,;:!?()[]{}<>*#"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        begin = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = begin + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((begin, end))
            begin = end + 1
    return out


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """The base matches of each kind: leftmost, apart, failing ones dropped; code points, end exclusive."""
    if not _ANY.search(text):
        return [[], [], [], []]
    digits = lambda m: _NOT_DIGIT.sub("", m[0])
    cards = [m.span() for m in _CARD.finditer(text) if 13 <= len(d := digits(m)) <= 19 and luhn(d)]
    phones = [m.span() for m in _PHONE.finditer(text) if 9 <= len(digits(m)) <= 15] if "+" in text else []
    return [_emails(text) if "@" in text else [], _ips(text), cards, phones]


FEATURES = 21


class Graph:
    """Nodes and links of some texts; gold: the base label of each node (0: none)."""

    def __init__(self):
        self.rows, self.spans, self.features, self.gold = [], [], [], []
        self.chain, self.skip = [], []

    def add(self, row: int, text: str, base: list[list[tuple[int, int]]]) -> None:
        locals_ = {text[a:b].split("@")[0].strip(_MARKS).lower() for a, b in base[0]}
        locals_ = {x for x in locals_ if len(x) >= 5}
        named = [(a, b, k + 1) for k, spans in enumerate(base) for a, b in spans]
        named.sort()
        starts = [a for a, *_ in named]
        last: dict[tuple, int] = {}
        before, before_token = None, ""
        tokens = [(m[0], m.start()) for m in _TOKEN.finditer(text)] if locals_ or _ANY.search(text) else []
        for k, (token, start) in enumerate(tokens):
            bare = token.strip(_MARKS).lower()
            if not (_ANY.search(token) or bare in locals_):
                before, before_token = None, token
                continue
            after = tokens[k + 1][0] if k + 1 < len(tokens) else ""
            node = len(self.rows)
            self.rows.append(row)
            self.spans.append((start, start + len(token)))
            self.features.append(self._features(token, before_token, after))
            # of the base spans the one nearest before the token's end, or one that started earlier and holds it
            gold = 0
            for i in range(bisect_right(starts, start + len(token) - 1) - 1, max(-1, bisect_right(starts, start + len(token) - 1) - 4), -1):
                a, b, kind = named[i]
                if b > start:
                    gold = kind
                    break
            self.gold.append(gold)
            if before is not None:
                self.chain.append((before, node))
            digits = _NOT_DIGIT.sub("", bare)
            keys = [("bare", bare)] + [("digits", digits)] * (len(digits) >= 7) + [("local", bare.split("@")[0])] * (bare.split("@")[0] in locals_)
            linked = set()
            for key in keys:
                if key in last and last[key] not in linked and last[key] != before and len(key[1]) >= 4:
                    linked.add(last[key])
                    self.skip.append((last[key], node))
                last[key] = node
            before, before_token = node, token

    @staticmethod
    def _features(token: str, before: str, after: str) -> list[float]:
        bare = token.strip(_MARKS)
        digits = _NOT_DIGIT.sub("", token)
        n, rest = len(digits), len(bare) - len(digits)
        groups = bare.split(".")
        four = len(groups) == 4 and all(g.isascii() and g.isdigit() and len(g) <= 3 and int(g) <= 255 for g in groups)
        out = [1, "@" in token, bool("@" in bare and _DOMAIN.fullmatch(bare.rpartition("@")[2])), four]
        out += [lo <= n <= hi for lo, hi in ((0, 0), (1, 2), (3, 3), (4, 6), (7, 7), (8, 12), (13, 19), (20, 1 << 30))]
        out += [token.startswith("+"), token.startswith("(") and ")" in token, 13 <= n <= 19 and rest <= 4 and luhn(digits), rest == 0, rest > n]
        out += [before.startswith("+"), before.startswith("(") and before.endswith(")"), after.startswith("("), bool(re.fullmatch(r"[0-9]{3}-[0-9]{4}", bare))]
        return [float(x) for x in out]


def _soft(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    e = np.exp(x)
    return e / e.sum(axis=1, keepdims=True)


def fit(graph: Graph) -> dict[str, np.ndarray] | None:
    """Weights by pseudo-likelihood: each node's label given its features and its neighbours' labels."""
    if not graph.rows:
        return None
    n, labels = len(graph.rows), len(KINDS) + 1
    x = np.zeros((n, FEATURES + 3 * labels))
    x[:, :FEATURES] = graph.features
    gold = np.array(graph.gold)
    one = np.eye(labels)[gold]
    for a, b in graph.chain:
        x[b, FEATURES : FEATURES + labels] += one[a]
        x[a, FEATURES + labels : FEATURES + 2 * labels] += one[b]
    for a, b in graph.skip:
        x[b, FEATURES + 2 * labels :] += one[a]
        x[a, FEATURES + 2 * labels :] += one[b]
    w, pace, speed = np.zeros((x.shape[1], labels)), 0.5, np.zeros((x.shape[1], labels))
    scale = 1 / np.maximum(1.0, np.sqrt((x**2).mean(axis=0)))[:, None]
    for _ in range(600):
        g = x.T @ (_soft(x @ w) - one) / n + 1e-4 * w
        speed = 0.9 * speed - pace * scale * g
        w = w + speed
    a, b, c = (w[FEATURES + k * labels : FEATURES + (k + 1) * labels] for k in range(3))
    return {"unary": w[:FEATURES], "chain": (a + b.T) / 2, "skip": (c + c.T) / 2}


def infer(graph: Graph, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Label probabilities of each node by loopy sum-product messages, all links at once."""
    unary = np.array(graph.features) @ weights["unary"]
    links = np.array([*graph.chain, *graph.skip], int).reshape(-1, 2)
    if not len(links):
        return _soft(unary)
    pair = np.r_[np.repeat(weights["chain"][None], len(graph.chain), 0), np.repeat(weights["skip"][None], len(graph.skip), 0)]
    source, target = np.r_[links[:, 0], links[:, 1]], np.r_[links[:, 1], links[:, 0]]
    pair = np.r_[pair, pair.transpose(0, 2, 1)]
    back = np.r_[np.arange(len(links), 2 * len(links)), np.arange(len(links))]
    message = np.zeros((len(source), unary.shape[1]))
    belief = unary
    for _ in range(ROUNDS):
        told = belief[source] - message[back]
        told -= told.max(axis=1, keepdims=True)
        new = np.log(np.einsum("ea,eab->eb", np.exp(told), np.exp(pair)) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        message = (1 - FRESH) * message + FRESH * new
        belief = unary.copy()
        np.add.at(belief, target, message)
    return _soft(belief)


def added_spans(graph: Graph, texts: list[str], bases: list, weights: dict | None) -> list[list[list[tuple[int, int]]]]:
    """For each text and kind, spans the field adds: runs of tokens of one label, bare of marks, apart from all base spans."""
    out = [[[], [], [], []] for _ in texts]
    if weights is None or not graph.rows:
        return out
    p = infer(graph, weights)
    label = np.where(p.max(axis=1) >= SURE, p.argmax(axis=1), 0)
    chained = set(graph.chain)
    run: list[int] = []

    def close():
        if run:
            row, text = graph.rows[run[0]], texts[graph.rows[run[0]]]
            a, b = graph.spans[run[0]][0], graph.spans[run[-1]][1]
            while a < b and text[a] in _MARKS.replace("(", ""):
                a += 1
            while a < b and text[b - 1] in _MARKS:
                b -= 1
            if a < b and all(b <= c or d <= a for spans in bases[row] for c, d in spans):
                out[row][label[run[0]] - 1].append((a, b))
            run.clear()

    for node in range(len(graph.rows)):
        if run and not (label[node] == label[run[-1]] and (run[-1], node) in chained):
            close()
        if label[node]:
            run.append(node)
    close()
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray] | None:
    """Weights from a bounded sample of documents, chosen by a hash of doc_id at a rate that the row count sets.

    Of those the first by hashes of id and text count, so reruns agree; texts
    of over ``SAMPLE_CHARS`` characters are left out of the sample.
    """
    rate = max(1, -(-docs.count() * 2 // sample))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(rate)) == 0).where(F.col("text").rlike("[0-9@]") & (F.length("text") <= SAMPLE_CHARS))
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), F.xxhash64("text")).limit(sample).collect()
    graph = Graph()
    for k, r in enumerate(sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id, r.text))):
        graph.add(k, r.text, base_spans(r.text))
    return fit(graph)


def _spans(part: pa.RecordBatch, weights: dict | None) -> tuple[list, list, list]:
    texts = [t or "" for t in part.column("text").to_pylist()]
    bases = [base_spans(t) for t in texts]
    graph = Graph()
    for k, (t, b) in enumerate(zip(texts, bases, strict=True)):
        if any(b) or _ANY.search(t):
            graph.add(k, t, b)
    added = added_spans(graph, texts, bases, weights)
    every = [[sorted({*x, *y}) for x, y in zip(b, a, strict=True)] for b, a in zip(bases, added, strict=True)]
    return texts, bases, every


def _listed(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, own in zip(KINDS, spans, strict=True) for a, b in own)


def find(docs: DataFrame, weights: dict | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of base spans; spans has those and the ones
    added. Null texts count as empty. Repeated rows stay; an empty table gives
    none; other columns aren't looked at.
    """
    weights = train(docs, sample) if weights is None else weights

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                _, bases, every = _spans(part, weights)
                counts = np.array([[len(x) for x in b] for b in bases], np.int64).reshape(-1, 4)
                digest = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in bases]
                yield pa.record_batch([part.column("doc_id"), *(pa.array(c) for c in counts.T), pa.array(digest), pa.array(map(_listed, every), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(step, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[list[tuple[int, int]]]) -> str:
    """A text with each span replaced by its kind's name; of spans that overlap the first, then the longest, stands."""
    named = sorted((a, -b, k) for k, own in zip(KINDS, spans, strict=True) for a, b in own)
    out, at = [], 0
    for a, b, kind in named:
        if -b > at:
            out += [text[at:a], f"<{kind.upper()}>"] if a >= at else []
            at = -b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, weights: dict | None = None, sample: int = SAMPLE) -> DataFrame:
    """docs with the spans masked in text and n_chars, where there is one, counted anew; all columns and rows stay, null texts too."""
    weights = train(docs, sample) if weights is None else weights
    at = docs.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts, _, every = _spans(part, weights)
                null = part.column("text").is_null().to_pylist()
                new = pa.array([None if n else masked(t, s) for t, s, n in zip(texts, every, null, strict=True)], pa.string())
                yield part.set_column(at, "text", new)

    out = docs.mapInArrow(step, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
