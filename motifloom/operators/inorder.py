"""Matches accepted from left to right, beside those taken best first.

Every path carries where it begins and which letters it covers inside the
protected positions. The best ending so far is accepted once no live path has
entered the protected positions at or before its protected end, or where the
sequence ends. Its protected letters are then locked and the search goes back,
not to the begin but to a point before which no path that is still alive began.
Among equal ways to a state a start comes first, then a deletion, a match, an
insertion. Sequences stand side by side, each at a letter of its own.

Where a path can start at any position of the profile and inserting costs, no
path lives longer than some letters (``reach``) past which a start beats it. Then
only the stretches around ends that reach the cutoff are walked through, and
these ends are found for all letters at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from . import kernels as K


@dataclass(frozen=True)
class Found:
    """1-based places: of the path, and of its protected part."""

    score: int
    begin: int
    end: int
    protected_begin: int
    protected_end: int


class _Lanes:
    def __init__(self, p: K.Profile, codes: list[np.ndarray], cutoff: int, unique: bool, limit: int | None, heads: np.ndarray, tails: np.ndarray):
        self.p, self.codes, self.cutoff, self.unique, self.limit = p, codes, cutoff, unique, limit
        self.heads, self.tails = heads, tails  # whether a lane begins and ends its sequence
        self.ended = np.zeros(len(codes), bool)  # by a match without a free letter
        self.size = np.array([len(c) for c in codes], np.int64)
        self.locked = [np.zeros(len(c), bool) for c in codes]
        self.found: list[list[Found]] = [[] for _ in codes]
        n, w = len(codes), p.length + 1
        self.score = {s: np.full((n, w), K.NEG, np.int64) for s in "mid"}
        self.record = {s: np.zeros((n, w, 3), np.int64) for s in "mid"}  # begin, first and last protected letter
        self.best = np.zeros((n, 5), np.int64)  # score, begin, protected begin and end, end
        self.at, self.back = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.mark, self.next_back, self.due = (np.zeros(n, np.int64) for _ in range(3))
        self.match = np.vstack([np.full(p.match.shape[1], K.NEG), p.match]).T
        self.insert = p.insert.T
        self.cost = np.r_[0, np.cumsum(p.delete + p.trans["dd"][1:])]
        for k in range(n):
            self.start(k)

    def start(self, k: int) -> None:
        """Lane k anew from its point of return."""
        p, first = self.p, bool(self.heads[k]) and self.back[k] == 0
        none = np.full((1, p.length + 1), K.NEG, np.int64)
        here = self._ready(none, none, np.zeros((1, p.length + 1, 3), np.int64), np.zeros((1, p.length + 1, 3), np.int64), {s: p.enter(s, first) for s in "mid"}, self.back[k : k + 1] + 1, self.size[k : k + 1])
        for s in "mid":
            self.score[s][k], self.record[s][k] = here[0][s][0], here[1][s][0]
        self.best[k] = (K.NEG, 0, 0, 0, 0)
        self.at[k] = self.mark[k] = self.back[k]
        self.next_back[k], self.due[k] = self.back[k] + 1, self.back[k] + self.p.length // 2

    def _ready(self, km, ki, rm, ri, enter, next_, size):
        """States ready to go on, with records, from what matches and insertions give; also what deletions give."""
        p, t, w = self.p, self.p.trans, self.p.length + 1
        fresh = np.stack([next_, size + 1, np.zeros_like(next_)], axis=-1)[:, None].repeat(w, axis=1)
        take = lambda kind, *ways: np.choose(kind[..., None], ways)
        options = np.stack([np.broadcast_to(enter["d"], km.shape), km + t["md"], ki + t["id"]])
        kind = options.argmax(axis=0)  # the first of equal ones
        own = np.maximum(options.max(axis=0), K.NEG)
        own_record = take(kind, fresh, rm, ri)
        place = np.arange(w)
        # of equal ones a start here, else the deletion that goes on
        key = (own - self.cost) * (4 * w) + np.where(kind == 0, 2 * w + place, w - 1 - place)
        top = np.maximum.accumulate(key, axis=1)
        rest = np.mod(top, 4 * w)
        source = np.where(rest >= 2 * w, rest - 2 * w, w - 1 - rest)
        run = np.maximum(np.take_along_axis(own - self.cost, source, axis=1) + self.cost, K.NEG)
        score, record = {"d": run}, {"d": np.take_along_axis(own_record, source[..., None], axis=1)}
        kd = np.full(km.shape, K.NEG, np.int64)
        kd[:, 1:] = np.maximum(run[:, :-1] + p.delete, K.NEG)
        rd = np.zeros_like(rm)
        rd[:, 1:] = record["d"][:, :-1]
        for s in "mi":
            options = np.stack([np.broadcast_to(enter[s], km.shape), kd + t["d" + s], km + t["m" + s], ki + t["i" + s]])
            score[s], record[s] = np.maximum(options.max(axis=0), K.NEG), take(options.argmax(axis=0), fresh, rd, rm, ri)
        for s, low in (("m", p.n1 - 1), ("i", p.n1)):
            part = record[s][:, low : p.last]
            part[..., 1] = np.minimum(part[..., 1], next_[:, None])
            part[..., 2] = next_[:, None]
        return score, record, kd, rd

    def step(self, live: np.ndarray) -> np.ndarray:
        """All live lanes one letter on; gives those still live."""
        p, at = self.p, self.at[live]
        c = np.fromiter((self.codes[k][i] for k, i in zip(live.tolist(), at.tolist(), strict=True)), np.int64, len(live))
        held = np.fromiter((self.locked[k][i] for k, i in zip(live.tolist(), at.tolist(), strict=True)), bool, len(live))
        m, i = self.score["m"][live], self.score["i"][live]
        m[held, p.n1 - 1 : p.last] = K.NEG
        i[held, p.n1 : p.last] = K.NEG
        km, rm = np.full(m.shape, K.NEG, np.int64), np.zeros((*m.shape, 3), np.int64)
        km[:, 1:] = np.maximum(m[:, :-1] + self.match[c, 1:], K.NEG)
        rm[:, 1:] = self.record["m"][live][:, :-1]
        ki, ri = np.maximum(i + self.insert[c], K.NEG), self.record["i"][live]
        row, size = at + 1, self.size[live]
        score, record, kd, rd = self._ready(km, ki, rm, ri, {s: p.enter(s, False) for s in "mid"}, row + 1, size)
        tip = ((row == size) & self.tails[live])[:, None]
        ends = np.stack([k + np.where(tip, p.leave(s, True), p.leave(s, False)) for s, k in (("d", kd), ("m", km), ("i", ki))])
        each = ends.max(axis=0)
        k = each.argmax(axis=1)
        lane = np.arange(len(live))
        top = each[lane, k]
        from_ = np.stack([rd, rm, ri])[ends.argmax(axis=0)[lane, k], lane, k]
        better = top > self.best[live, 0]
        new = np.c_[top, from_[:, 0], np.where(from_[:, 1] > size, from_[:, 0], from_[:, 1]), np.where(from_[:, 2] == 0, row, from_[:, 2]), row]
        self.best[live[better]] = new[better]
        for s in "mid":
            self.score[s][live], self.record[s][live] = score[s], record[s]
        self.at[live] = row
        alive = np.stack([score[s] > K.NEG // 2 for s in "mid"])
        entered = np.where(alive, np.stack([record[s][..., 1] for s in "mid"]), np.iinfo(np.int64).max)
        pending = self.best[live, 0] >= max(self.cutoff, K.NEG // 2 + 1)
        first = np.minimum(entered[:, :, p.n1 :].min(axis=(0, 2)), row)
        accept = pending & ((first > self.best[live, 3]) | (row == size))
        due = np.flatnonzero(~pending & (row >= self.due[live]))
        for j in due.tolist():
            lane_ = live[j]
            earliest = min(int(row[j]), int(entered[:, j, p.n1 + 1 :].min(initial=int(row[j]))))
            if earliest >= self.mark[lane_]:
                self.back[lane_] = self.next_back[lane_] - 1
                begins = [int(record[s][j, :, 0][alive["mid".index(s), j]].min(initial=int(row[j]) + 1)) for s in "mid"]
                self.next_back[lane_], self.mark[lane_] = min(begins), row[j]
            self.due[lane_] += max(1, p.length // 2)
        going = row < size
        for j in np.flatnonzero(accept).tolist():
            lane_ = int(live[j])
            s, begin, low, high, end = self.best[lane_].tolist()
            if self.locked[lane_][low - 1 : high].all():  # it passes over the protected positions: nothing new would come
                going[j], self.ended[lane_] = False, True
                continue
            self.found[lane_].append(Found(s, begin, end, low, high))
            self.locked[lane_][low - 1 : high] = True
            going[j] = not self.unique and (self.limit is None or len(self.found[lane_]) < self.limit)
            if going[j]:
                self.start(lane_)
        return live[going]


def reach(p: K.Profile, cutoff: int) -> int | None:
    """Letters that a path lives at most, and one that ends with the cutoff has; None: no such bound is known.

    A path of n letters matches each position once at most and opens one insertion
    a position, so all others extend insertions. Each state has at least what a
    path gives that started a letter ago and matched the worst letter.
    """
    allowed = lambda x: x[x > K.NEG // 2]
    most = lambda *xs: int(max((allowed(np.asarray(x)).max(initial=K.NEG) for x in xs), default=K.NEG))
    worst = p.match.min(axis=1)
    if p.circular or not (worst > K.NEG // 2).all():
        return None
    lanes = _Lanes(p, [], cutoff, False, None, np.zeros(0, bool), np.zeros(0, bool))
    none = np.full((1, p.length + 1), K.NEG, np.int64)
    blank, one = np.zeros((1, p.length + 1, 3), np.int64), np.ones(1, np.int64)

    def states(km: np.ndarray, ki: np.ndarray) -> dict[str, np.ndarray]:
        return {s: v[0] for s, v in lanes._ready(km, ki, blank.copy(), blank.copy(), {s: p.enter(s, False) for s in "mid"}, one, one)[0].items()}

    fresh = states(none, none)["m"][:-1]
    if not (fresh > K.NEG // 2).all():
        return None
    km = none.copy()
    km[0, 1:] = fresh + worst
    low = states(km, none)
    ki = np.where(low["i"] > K.NEG // 2, low["i"] + p.insert.min(axis=1), K.NEG)[None]
    after = states(km, np.maximum(ki, K.NEG))
    if any(((after[s] > K.NEG // 2) & (low[s] <= K.NEG // 2)).any() for s in "mid"):
        return None
    gain = most(p.insert) + most(p.trans["ii"])
    if gain >= 0 or most(p.insert) <= K.NEG // 2:
        return None
    n = p.length + 1
    top = max(0, most(*(p.enter(s, f) for s in "mid" for f in (True, False)))) + max(0, most(*(p.leave(s, f) for s in "mid" for f in (True, False))))
    top += int(np.maximum(p.match.max(axis=1), 0).sum()) + n * max(0, most(p.insert)) + 4 * n * max(0, most(*p.trans.values())) + int(np.maximum(p.delete, 0).sum())
    floor = min(cutoff, *(int(allowed(low[s]).min(initial=cutoff)) for s in "mid"))
    return 2 * n + max(0, (top - floor) // -gain) + 2


#: Letters whose ends are found at once.
PIECE = 1 << 16


def _stretches(p: K.Profile, codes: list[np.ndarray], cutoff: int) -> list[list[tuple[int, int]]]:
    """For each sequence the stretches, from left to right, that hold all that its matches depend on."""
    far = reach(p, cutoff)
    if far is None:
        return [[(0, len(c))] if len(c) else [] for c in codes]
    pieces = [(k, max(0, at - far), at, min(len(c), at + PIECE)) for k, c in enumerate(codes) for at in range(0, len(c), PIECE)]
    ends: list[np.ndarray] = [np.zeros(0, np.int64)] * len(pieces)
    K.best_ends(p, [codes[k][low:to] for k, low, _, to in pieces], None, np.array([low == 0 for _, low, _, _ in pieces], bool), np.array([to == len(codes[k]) for k, _, _, to in pieces], bool), others=ends, enough=cutoff)
    out: list[list[tuple[int, int]]] = [[] for _ in codes]
    for (k, low, at, _), own in zip(pieces, ends, strict=True):
        own = own + low
        own = own[own > at]
        if not len(own):
            continue
        cuts = np.flatnonzero(np.diff(own) > 4 * far)
        for a, b in zip(own[np.r_[0, cuts + 1]].tolist(), own[np.r_[cuts, len(own) - 1]].tolist(), strict=True):
            begin, end = max(0, a - 2 * far), min(len(codes[k]), b + 2 * far)
            if out[k] and a - (out[k][-1][1] - 2 * far) <= 4 * far:  # one stretch with the last of the piece before
                begin = out[k].pop()[0]
            out[k].append((begin, end))
    return out


def found(p: K.Profile, codes: list[np.ndarray], cutoff: int, unique: bool = False, limit: int | None = None) -> list[list[Found]]:
    """Matches of at least ``cutoff`` in each sequence, in the order of acceptance; one that has no free letter for the protected positions ends the search."""
    if p.circular:
        raise ValueError("circular profiles are searched best first")
    out: list[list[Found]] = [[] for _ in codes]
    if limit is not None and limit <= 0:
        return out
    parts = [(k, a, b) for k, own in enumerate(_stretches(p, codes, cutoff)) for a, b in own]
    lanes = _Lanes(p, [codes[k][a:b] for k, a, b in parts], cutoff, unique, limit, np.array([a == 0 for _, a, _ in parts], bool), np.array([b == len(codes[k]) for k, _, b in parts], bool))
    live = np.flatnonzero(lanes.size > 0)
    while len(live):
        live = lanes.step(live)
    over = np.zeros(len(codes), bool)
    for (k, a, _), own, ended in zip(parts, lanes.found, lanes.ended, strict=True):
        if not over[k]:
            out[k] += [Found(f.score, f.begin + a, f.end + a, f.protected_begin + a, f.protected_end + a) for f in own]
            out[k] = out[k][: 1 if unique else limit]
            over[k] = ended or (unique and len(out[k]) > 0) or (limit is not None and len(out[k]) >= limit)
    return out


def all_matches(p: K.Profile, codes: list[np.ndarray], seqs: list[str], cutoff: int, unique: bool = False, limit: int | None = None) -> list[list[K.Match]]:
    """``found`` with paths: each is sought between its ends, past the letters locked before it. Ordered by place."""
    out = []
    for c, seq, ms in zip(codes, seqs, found(p, codes, cutoff, unique, limit), strict=True):
        locked, own = np.zeros(len(c), bool), []
        for f in ms:
            low = f.begin - 1
            m = K.best_match(p, c[low : f.end], seq[low : f.end], locked[low : f.end], low == 0, f.end == len(c))
            own.append(K.Match(f.score, m.begin + low, f.end, m.motif_start, m.motif_end, f.protected_begin, f.protected_end, m.aligned))
            locked[f.protected_begin - 1 : f.protected_end] = True
        out.append(sorted(own, key=lambda m: (m.begin, m.end)))
    return out
