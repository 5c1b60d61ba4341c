"""Token counts under a unigram model, by dynamic programming on a trie.

The vocabulary file gives byte pieces in order of rank; a piece's score is the
logarithm of its Zipf frequency at that rank. A text is cut into pre-tokens; the
distinct pre-tokens of what a worker has seen stand in a trie of bytes. Each
trie node holds the best score of any segmentation of its prefix and the number
of pieces in it (of equal scores the fewest pieces), computed once for all
pre-tokens that share the prefix; the node where a pre-token ends gives its
count. A pre-token of over ``LONG`` bytes would be a branch of its own: its scores
are computed along it without nodes, by the same rule. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Nodes of the trie at which a worker starts a new one.
MAX_NODES = 500_000
#: Bytes of a pre-token from which it isn't put into the trie.
LONG = 4096
#: Pre-tokens: a run of letters, numerals or other marks with the blank before it, or white space.
PRE_TOKEN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s"


def load(path: str) -> list[bytes]:
    """Pieces in order of rank from a file of base64 and rank on each line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in sorted(pairs, key=lambda p: int(p[1]))]


def zipf(pieces: list[bytes]) -> dict[bytes, float]:
    """Scores by rank; every byte has to be a piece, so that any text can be cut."""
    missing = {bytes([b]) for b in range(256)} - set(pieces)
    if missing:
        raise ValueError(f"no piece for {len(missing)} bytes")
    norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r + 1) - norm for r, p in enumerate(pieces)}


class Trie:
    """Prefixes of the pre-tokens added, with forward scores and counts."""

    def __init__(self, scores: dict[bytes, float]):
        self.scores, self.longest = scores, max(map(len, scores))
        self.finder = None
        self.ends: dict[str, int] = {}  # terminal counts
        self._clear()

    def _clear(self):
        self.ends.clear()
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def add(self, token: str) -> int:
        """The number of pieces in the best segmentation."""
        known = self.ends.get(token)
        if known is not None:
            return known
        word = token.encode("utf-8", "surrogatepass")
        if len(word) > LONG:
            return self._alone(word)
        node, path, child = 0, [0], self.child
        for depth, byte in enumerate(word, 1):
            key = node << 8 | byte
            node = child.get(key, -1)
            if node < 0:
                node = len(self.best)
                child[key] = node
                self._forward(word, depth, path)
            path.append(node)
        self.ends[token] = self.count[node]
        return self.count[node]

    def _forward(self, word: bytes, depth: int, path: list[int]) -> None:
        top, fewest, get = -math.inf, 0, self.scores.get
        for start in range(max(0, depth - self.longest), depth):
            score = get(word[start:depth])
            if score is not None:
                at = path[start]
                total, n = self.best[at] + score, self.count[at] + 1
                if total > top or total == top and n < fewest:
                    top, fewest = total, n
        self.best.append(top)
        self.count.append(fewest)

    def _alone(self, word: bytes) -> int:
        """The count of a long pre-token: the same scores along one branch, of which only the last ``longest`` are kept.

        An automaton finds the pieces that end at each byte.
        """
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for piece, score in self.scores.items():
                self.finder.add_word(piece.decode("latin-1"), (len(piece), score))
            self.finder.make_automaton()
        room = self.longest + 1
        best, count = [0.0] * room, [0] * room
        at, top, fewest = 0, -math.inf, 0
        for end, (size, score) in self.finder.iter(word.decode("latin-1")):
            if end != at:  # matches come by their end, and every byte is a piece
                slot = (at + 1) % room
                best[slot], count[slot] = top, fewest
                at, top, fewest = end, -math.inf, 0
            slot = (end + 1 - size) % room
            total = best[slot] + score
            if total >= top:
                n = count[slot] + 1
                if total > top or n < fewest:
                    top, fewest = total, n
        return fewest

    def fresh(self) -> None:
        if len(self.best) > MAX_NODES:
            self._clear()


_kept: dict = {}


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, n_pretokens of the whole text.

    ``vocabulary`` is the path of a rank file, read where the plan is made; its
    size is that of the file. Null and empty texts have no token. Repeated rows
    stay; an empty table gives none; other columns aren't looked at.
    """
    pieces = load(vocabulary)
    name = hashlib.sha256(b"".join(len(p).to_bytes(4, "big") + p for p in pieces)).hexdigest()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _kept.get("for") != name:
            _kept.update({"for": name, "trie": Trie(zipf(pieces))})
        trie, cut = _kept["trie"], regex.compile(PRE_TOKEN).findall
        ends = trie.ends
        for batch in batches:
            for part in chunks(batch):
                trie.fresh()
                tokens, pres = [], []
                for text in part.column("text").to_pylist():
                    own = cut(text) if text else []
                    size = len(own)
                    more = 0
                    for t in set(own).difference(ends):
                        n = trie.add(t)
                        if t not in ends:  # long ones aren't kept
                            more += n * own.count(t)
                            own = [x for x in own if x != t]
                    tokens.append(sum(map(ends.__getitem__, own)) + more)
                    pres.append(size)
                yield pa.record_batch([part.column("doc_id"), pa.array(np.array(tokens, np.int64)), pa.array(np.array(pres, np.int64))], names=["doc_id", "n_tokens", "n_pretokens"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(step, "doc_id long, n_tokens long, n_pretokens long")
