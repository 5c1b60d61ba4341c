"""Suffix sorting of one shard by induction, with common-prefix values, through queues that spill to disk.

A suffix is of type S if it is smaller than the one that begins a letter later,
else L. The S suffixes whose left neighbour is L are sorted first: their
substrings are sorted by induction and named, and the string of names, if names
repeat, is sorted in the same way (``order``). From them the L suffixes are
induced in ascending order and from those the S suffixes in descending order:
what is taken from a queue puts the suffix to its left into the queue, at its
own letter, behind all that came before. With each suffix goes the length of
the prefix it shares with the one before it, which is one more than the least
such value between the two that induced them.

Queues and lists keep what fits ``memory`` entries; the rest are runs in
anonymous temporary files of the task, which no other task reads and which
vanish with it, like Spark's own spills.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterator

import numpy as np

#: Entries of a queue or list kept in memory, and of a string of names sorted in memory.
MEMORY = 1 << 23
#: Entries worked on at once.
CHUNK = 1 << 16
_ITEM = np.dtype([("pos", np.int64), ("lcp", np.int32)])
_KEYED = np.dtype([("key", np.int64), ("pos", np.int64), ("lcp", np.int32)])


def _in_order(keys: np.ndarray) -> np.ndarray:
    """Stable order of keys; of small ones by radix."""
    small = len(keys) and -(1 << 15) <= keys.min() and keys.max() < 1 << 15
    return np.argsort(keys.astype(np.int16) if small else keys, kind="stable")


def _items(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    out = np.empty(len(pos), _ITEM)
    out["pos"], out["lcp"] = pos, lcp
    return out


class _Run:
    """A sorted part of a queue in a file, read by blocks."""

    def __init__(self, file, at: int, size: int):
        self.file, self.at, self.left, self.block, self.p = file, at, size, np.empty(0, _KEYED), 0
        self._fill()

    def _fill(self) -> None:
        if self.p == len(self.block):
            n = min(self.left, CHUNK)
            self.file.seek(self.at)
            self.block, self.p = np.frombuffer(self.file.read(n * _KEYED.itemsize), _KEYED), 0
            self.at, self.left = self.at + n * _KEYED.itemsize, self.left - n

    def key(self) -> int | None:
        return int(self.block["key"][self.p]) if self.p < len(self.block) else None

    def take(self, key: int) -> np.ndarray:
        to = self.p + int(np.searchsorted(self.block["key"][self.p :], key, "right"))
        part = self.block[self.p : to]
        self.p = to
        self._fill()
        return _items(part["pos"], part["lcp"])


class Queue:
    """A priority queue in bulk: entries of the least key come first, those of one key as they came."""

    def __init__(self, memory: int):
        self.memory, self.held, self.pieces, self.heap, self.runs, self.file = memory, 0, {}, [], [], None

    def push(self, keys: np.ndarray, items: np.ndarray) -> None:
        if not len(keys):
            return
        by = _in_order(keys)
        keys, items = keys[by], items[by]
        heads = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            key = int(keys[a])
            if key not in self.pieces:
                self.pieces[key] = []
                heapq.heappush(self.heap, key)
            self.pieces[key].append(items[a:b])
        self.held += len(keys)
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        at, size = self.file.seek(0, 2), self.held
        for key in sorted(self.pieces):
            for piece in self.pieces[key]:
                out = np.empty(len(piece), _KEYED)
                out["key"], out["pos"], out["lcp"] = key, piece["pos"], piece["lcp"]
                self.file.write(out.tobytes())
        self.file.flush()
        self.runs.append(_Run(self.file, at, size))
        self.pieces, self.heap, self.held = {}, [], 0

    def peek(self) -> int | None:
        keys = [k for k in (r.key() for r in self.runs) if k is not None] + self.heap[:1]
        return min(keys, default=None)

    def pop(self) -> np.ndarray:
        """Some entries of the least key, the earliest."""
        key = self.peek()
        for run in self.runs:  # the older ones first
            if run.key() == key:
                part = run.take(key)
                self.runs = [r for r in self.runs if r.key() is not None]
                return part
        heapq.heappop(self.heap)
        pieces = self.pieces.pop(key)
        part = pieces[0] if len(pieces) == 1 else np.concatenate(pieces)
        self.held -= len(part)
        if len(part) > CHUNK:
            self.pieces[key], self.held = [part[CHUNK:]], self.held + len(part) - CHUNK
            heapq.heappush(self.heap, key)
        return part[:CHUNK]


class Tape:
    """A list of entries that is written once and read forwards or backwards by chunks of one letter."""

    def __init__(self, memory: int):
        self.memory, self.held, self.parts, self.file = memory, 0, [], None

    def append(self, key: int, items: np.ndarray) -> None:
        if self.held + len(items) > self.memory:
            self.file = self.file or tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            self.file.write(items.tobytes())
            self.parts.append((key, at, len(items)))
        else:
            self.held += len(items)
            self.parts.append((key, items, len(items)))

    def read(self, k: int) -> np.ndarray:
        _, at, n = self.parts[k]
        if isinstance(at, np.ndarray):
            return at
        self.file.seek(at)
        return np.frombuffer(self.file.read(n * _ITEM.itemsize), _ITEM)


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S; the empty one, which ends the text, is smaller than all."""
    ends = np.r_[np.flatnonzero(text[1:] != text[:-1]), len(text) - 1]
    rising = np.r_[text[ends[:-1]] < text[ends[:-1] + 1], False]
    return np.repeat(rising, np.diff(np.r_[-1, ends]))


class _Shared:
    """Prefix lengths for what is induced: least values since the last entry that went to the same letter."""

    def __init__(self, cap: int, letters: int):
        self.cap, self.least = cap, np.full(letters, -1, np.int64)  # -1: nothing went there yet

    def induced(self, lcp: np.ndarray, places: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """lcp: of a chunk in order; places in it induce a suffix at each of the letters."""
        out = np.zeros(len(places), np.int32)
        known = self.least >= 0
        before = self.least.copy()
        if len(lcp):
            self.least[known] = np.minimum(self.least[known], lcp.min())
        if not len(places):
            return out
        by = _in_order(letters)
        heads = np.flatnonzero(np.r_[True, letters[by][1:] != letters[by][:-1]])
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(by)], strict=True):
            own, letter = by[a:b], int(letters[by[a]])
            at = places[own]
            low = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            low[0] = min(int(low[0]), int(before[letter])) if before[letter] >= 0 else -1
            out[own] = np.minimum(low + 1, self.cap)
            rest = lcp[at[-1] + 1 :]
            self.least[letter] = rest.min() if len(rest) else self.cap
        return out


def _run_length(text: np.ndarray, p: int, cap: int) -> int:
    part = text[p : p + cap]
    other = np.flatnonzero(part != part[0])
    return int(other[0]) if len(other) else len(part)


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, memory: int, seed_lcp: np.ndarray | None = None, cap: int = 0) -> Iterator[tuple[bool, int, np.ndarray]]:
    """All suffixes from the sorted seeds, in chunks (ascending, letter, entries): those of type L ascending, then those of type S descending.

    An entry's lcp is the length, up to ``cap``, of the prefix shared with the one before in the
    order of the chunks, 0 across letters; of type S, also the last L chunk of a
    letter is given (ascending False), with the value at the seam. Without
    seed_lcp all values are 0.
    """
    n, want = len(text), seed_lcp is not None
    letters = int(text.max()) + 1 if want else 0

    def spread(queue, shared, items, left_is_s, sign):
        pos = items["pos"]
        pred = pos - 1
        places = np.flatnonzero((pos > 0) & (is_s[pred] == left_is_s))
        pred = pred[places]
        keys = text[pred].astype(np.int64)
        lcp = shared.induced(items["lcp"], places, keys) if want else np.zeros(len(places), np.int32)
        queue.push(sign * keys, _items(pred, lcp))

    queue, tape, shared = Queue(memory), Tape(memory), _Shared(cap, letters)
    spread(queue, shared, _items(np.array([n]), np.zeros(1, np.int32)), False, 1)
    at, last = 0, (-1, -1)
    while True:
        key = queue.peek()
        seed = int(text[seeds[at]]) if at < len(seeds) else None
        if key is None and seed is None:
            break
        if seed is None or (key is not None and key <= seed):
            items = queue.pop()
            tape.append(key, items)
            last = key, int(items["pos"][-1])
            yield True, key, items
        else:
            own = np.asarray(seeds[at : at + CHUNK])
            own = own[: int(np.searchsorted(text[own] != seed, True))]
            items = _items(own, seed_lcp[at : at + len(own)] if want else np.zeros(len(own), np.int32))
            if want and (at == 0 or text[seeds[at - 1]] != seed):
                items["lcp"][0] = min(_run_length(text, last[1], cap), _run_length(text, int(own[0]), cap)) if last[0] == seed else 0
            at += len(own)
        spread(queue, shared, items, False, 1)
    queue, shared, at, last, above = Queue(memory), _Shared(cap, letters), len(tape.parts) - 1, (-1, -1), 0
    while True:
        key = queue.peek()
        letter = tape.parts[at][0] if at >= 0 else None
        if key is None and letter is None:
            break
        if letter is None or (key is not None and -key >= letter):
            items = queue.pop()
            last = -key, int(items["pos"][-1])
            yield False, -key, items
        else:
            own = tape.read(at)[::-1]
            items = own.copy()
            first = at + 1 == len(tape.parts) or tape.parts[at + 1][0] != letter
            if want:
                items["lcp"][1:] = own["lcp"][:-1]
                items["lcp"][0] = above
                if first:
                    items["lcp"][0] = min(_run_length(text, last[1], cap), _run_length(text, int(own["pos"][0]), cap)) if last[0] == letter else 0
                    if items["lcp"][0] >= cap:
                        seam = _items(np.array([last[1], items["pos"][0]]), np.array([0, items["lcp"][0]]))
                        yield False, letter, seam
                above = int(own["lcp"][-1])
            at -= 1
        spread(queue, shared, items, True, -1)


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names, by their first ``depth`` names at least, in memory."""
    n = len(names)
    by = np.argsort(names)
    rank = np.empty(n, np.int64)
    new = np.r_[True, names[by][1:] != names[by][:-1]]
    rank[by] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    k = 1
    while k < depth:
        count = np.bincount(rank, minlength=n)
        live = np.flatnonzero(count[rank] > 1)
        if not len(live):
            break
        after = np.where(live + k < n, rank[np.minimum(live + k, n - 1)] + 1, 0)
        key = rank[live] * (n + 1) + after
        by = np.argsort(key)
        key, own = key[by], live[by]
        old = rank[own]
        group = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], np.arange(len(own)), 0))
        inner = np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(own)), 0))
        rank[own] = old + inner - group
        k *= 2
    return np.argsort(rank)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether text has the same letters from a as from b, as many as given."""
    out = np.ones(len(a), bool)
    live, t = np.arange(len(a)), 0
    while len(live):
        same = text[a[live] + t] == text[b[live] + t]
        out[live[~same]] = False
        t += 1
        live = live[same]
        live = live[sizes[live] > t]
    return out


def seeds_of(text: np.ndarray, is_s: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The S suffixes right of an L suffix, sorted by ``depth`` letters at least."""
    at = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(at) < 2:
        return at
    is_seed = np.zeros(len(text), bool)
    is_seed[at] = True
    found = [items["pos"][is_seed[items["pos"]]] for up, _, items in induce(text, is_s, at[np.argsort(text[at], kind="stable")], memory) if not up]
    by = np.concatenate(found)[::-1]  # sorted by their substrings
    size = np.diff(np.r_[at, len(text)])
    index = np.searchsorted(at, by)
    own = size[index]
    differs = np.ones(len(by), bool)
    alike = np.flatnonzero((own[1:] == own[:-1]) & (index[1:] != len(at) - 1) & (index[:-1] != len(at) - 1)) + 1
    differs[alike] = ~_equal(text, by[alike - 1], by[alike], own[alike] + 1)
    names = np.empty(len(at), np.int64)
    names[index] = np.cumsum(differs) - 1
    if differs.all():
        return by
    return at[order(names, depth, memory)]


def order(names: np.ndarray, depth: int, memory: int = MEMORY) -> np.ndarray:
    """The suffixes of a string of whole numbers in order, those that share ``depth`` letters or more in any order among them."""
    if len(names) <= memory:
        return _doubled(names, depth)
    is_s = types(names)
    below: dict[int, list] = {}
    above: dict[int, list] = {}
    for up, letter, items in induce(names, is_s, seeds_of(names, is_s, depth, memory), memory):
        (below if up else above).setdefault(letter, []).append(items["pos"])
    out = []
    for letter in sorted(below.keys() | above.keys()):
        out += below.get(letter, []) + [x[::-1] for x in reversed(above.get(letter, []))]
    return np.concatenate(out)


def shared_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix, up to cap, of the suffixes at a and b; eight letters at a time. text: bytes."""
    padded = np.concatenate([text, np.zeros(cap + 16, np.uint8)])
    words = np.ndarray((len(padded) - 7,), np.dtype("<u8"), buffer=padded, strides=(1,))
    out = np.full(len(a), cap, np.int32)
    for low in range(0, len(a), CHUNK):
        x, y = a[low : low + CHUNK], b[low : low + CHUNK]
        live, t = np.arange(len(x)), 0
        while len(live) and t < cap:
            d = words[np.minimum(x[live] + t, len(words) - 1)] ^ words[np.minimum(y[live] + t, len(words) - 1)]
            some = np.flatnonzero(d)
            bit = d[some] & (~d[some] + np.uint64(1))
            out[low + live[some]] = np.minimum(t + (np.log2(bit.astype(np.float64)).astype(np.int64) >> 3), cap)
            live, t = live[d == 0], t + 8
    return out


def repeated(text: np.ndarray, size: int, memory: int = MEMORY) -> np.ndarray:
    """Whether the string of ``size`` letters from each place of a text of bytes begins at another place too.

    Adjacent suffixes that share ``size`` letters are marked; letters past the end count as byte 0.
    """
    marks = np.zeros(len(text), bool)
    if len(text) < 2:
        return marks
    is_s = types(text)
    seeds = seeds_of(text, is_s, size, memory)
    lcp = np.zeros(len(seeds), np.int32)
    lcp[1:] = shared_prefixes(text, seeds[:-1], seeds[1:], size)
    last = {}
    for up, letter, items in induce(text, is_s, seeds, memory, lcp, size):
        pos, alike = items["pos"], np.flatnonzero(items["lcp"] >= size)
        if len(alike):
            marks[pos[alike]] = True
            marks[pos[alike[alike > 0] - 1]] = True
            if alike[0] == 0 and (up, letter) in last:
                marks[last[up, letter]] = True
        last = {(up, letter): int(pos[-1])}
    return marks
