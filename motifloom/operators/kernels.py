"""Dynamic programming between profiles and sequences, on NumPy arrays.

A profile has L match positions and L + 1 insert positions. All scores are
whole numbers; ``NEG`` stands for a forbidden step.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

NEG = -(1 << 28)
STATES = "mid"
#: Letters worked on side by side: a few arrays of so many numbers fit the cache.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Profile:
    """Scores by position; letters are numbered from 1 in ``alphabet``, 0 is any other letter."""

    alphabet: str
    match: np.ndarray  # (L, letters + 1)
    insert: np.ndarray  # (L + 1, letters + 1)
    delete: np.ndarray  # (L,)
    trans: dict[str, np.ndarray] = field(default_factory=dict)  # 'mm', 'mi', ... (L + 1,)
    border: dict[str, np.ndarray] = field(default_factory=dict)  # 'b0','b1','e0','e1','bm','bi','bd','me','ie','de' (L + 1,)
    n1: int = 1  # protected positions, from 1
    n2: int = 0  # 0: the length
    name: str = ""
    consensus: str = ""
    circular: bool = False  # its end joins its begin (see ``circular``)

    def __post_init__(self):
        n = len(self.match) + 1
        for x in STATES:
            for y in STATES:
                self.trans.setdefault(x + y, np.full(n, 0 if x == y else NEG, np.int64))
        for key in ("b0", "b1", "e0", "e1", "bm", "me"):
            self.border.setdefault(key, np.zeros(n, np.int64))
        for key in ("bi", "bd", "ie", "de"):
            self.border.setdefault(key, np.full(n, NEG, np.int64))

    @property
    def length(self) -> int:
        return len(self.match)

    @property
    def last(self) -> int:
        return self.n2 or self.length

    def encode(self, seq: str) -> np.ndarray:
        return self.numbers(np.frombuffer(seq.encode("latin-1", "replace"), np.uint8))

    def numbers(self, letters: np.ndarray) -> np.ndarray:
        """Numbers of letters given as bytes."""
        table = np.zeros(256, np.uint8)
        for i, a in enumerate(self.alphabet):
            table[ord(a)] = i + 1
        return table[letters]

    def enter(self, state: str, first: bool) -> np.ndarray:
        """Score of starting before each position; at the first residue or later. Not inside or past the protected end."""
        out = np.maximum(self.border["b0" if first else "b1"] + self.border["b" + state], NEG)
        out[self.last :] = NEG
        return out

    def leave(self, state: str, last: bool) -> np.ndarray:
        """Score of ending after each position; not before the protected begin."""
        out = np.maximum(self.border["e0" if last else "e1"] + self.border[state + "e"], NEG)
        out[: self.n1] = NEG
        return out

    def reverse(self) -> Profile:
        """The profile that reads sequences backwards."""
        swap = {"b0": "e0", "b1": "e1", "bm": "me", "bi": "ie", "bd": "de"}
        swap |= {v: k for k, v in swap.items()}
        return replace(
            self,
            match=self.match[::-1],
            insert=self.insert[::-1],
            delete=self.delete[::-1],
            trans={k: self.trans[k[::-1]][::-1] for k in self.trans},
            border={k: self.border[v][::-1] for k, v in swap.items()},
            n1=self.length - self.last + 1,
            n2=self.length - self.n1 + 1,
            consensus=self.consensus[::-1],
        )


def complemented(p: Profile) -> Profile:
    """The profile that reads the complement strand's letters in their place: columns of complementary bases change places."""
    other = dict(zip("ACGTMKRYVBHD", "TGCAKMYRBVDH", strict=True))
    at = [0, *(p.alphabet.index(other.get(a, a)) + 1 if other.get(a, a) in p.alphabet else i + 1 for i, a in enumerate(p.alphabet))]
    return replace(p, match=p.match[:, at], insert=p.insert[:, at])


def linear(match: np.ndarray, alphabet: str, open_gap: int = -12, extend: int = -3, **more) -> Profile:
    """A local profile with one cost of opening and one of extending gaps."""
    size, letters = match.shape
    n = size + 1
    flat = lambda v: np.full(n, v, np.int64)
    trans = {"mi": flat(open_gap), "md": flat(open_gap), "im": flat(0), "dm": flat(0), "id": flat(NEG), "di": flat(NEG)}
    insert = np.full((n, letters), extend, np.int64)
    return Profile(alphabet, match.astype(np.int64), insert, np.full(size, extend, np.int64), trans, **more)


def h_scores(p: Profile, codes: np.ndarray, starts: np.ndarray, floor: np.ndarray | None = None) -> np.ndarray:
    """Prefilter scores of sequences laid end to end (``starts``: their offsets, and the end).

    On each diagonal a running match score is kept from falling below zero,
    but for cells of a sequence's first letter; the best of each profile
    position, if positive, are summed. One vector step for each position, over
    blocks of whole sequences that fit the cache. ``floor``: the least score a
    match position counts (see ``detours``). Circular profiles have no such score.
    """
    if p.circular:
        raise ValueError(f"circular profiles have no prefilter score: {p.name}")
    n = len(starts) - 1
    out = np.zeros(n, np.int64)
    match = np.maximum(p.match, -(1 << 20)).astype(np.int32)
    if floor is not None:
        match = np.maximum(match, np.maximum(floor, -(1 << 20))[:, None].astype(np.int32))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK, "right")) - 1)
        full = np.flatnonzero(np.diff(starts[at : to + 1]) > 0) + at
        if len(full):
            own = codes[starts[at] : starts[to]]
            out[full] = _h_block(match, own, starts[full] - starts[at])
        at = to
    return out


def _h_block(match: np.ndarray, codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    total = np.zeros(len(heads), np.int64)
    row = np.zeros(len(codes), np.int32)
    before = np.empty_like(row)
    for scores in match:
        before[1:] = row[:-1]
        before[heads] = 0
        np.add(before, scores[codes], out=row)
        first = row[heads]
        np.maximum(row, 0, out=row)
        row[heads] = first
        total += np.maximum(np.maximum.reduceat(row, heads), 0)
    return total


def detours(p: Profile) -> np.ndarray:
    """What passing each match position by the cheapest gap costs: by a deletion or by an insertion, without the gap itself."""
    t = p.trans
    return np.maximum(np.maximum(t["md"][:-1] + t["dm"][1:], t["mi"][:-1] + t["im"][:-1]), NEG)


def _deletions(p: Profile, d: np.ndarray) -> np.ndarray:
    """Best deletion states when each may extend the one before: a running maximum after taking off summed costs."""
    cost = np.r_[0, np.cumsum(p.delete + p.trans["dd"][1:])]
    return np.maximum(np.maximum.accumulate(d - cost, axis=-1) + cost, NEG)


def scores(p: Profile, codes: list[np.ndarray], cutoff: int | None = None) -> np.ndarray:
    """Best alignment score of each sequence (no sequence letters: NEG).

    With ``cutoff`` a sequence is left as soon as it reaches it, and then has
    some score from the cutoff to its best.
    """
    return best_ends(p, codes, cutoff=cutoff)[0]


def best_ends(
    p: Profile, codes: list[np.ndarray], locked: list[np.ndarray] | None = None, first: np.ndarray | None = None, last: np.ndarray | None = None, cutoff: int | None = None, others: list | None = None, enough: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(score, letters up to its end) of each sequence's best alignment, the earliest of equal ones; ``others``, a list of
    the sequences' length, is given all ends of alignments as good, or with ``enough`` all of those with that score or more.

    ``first`` and ``last`` tell whether each begins and ends its sequence, or
    is a part of it; letters that are ``locked`` can't be used inside the
    protected positions. Sequences of like length are worked on side by side,
    very long ones by tiles of letters (unless letters are locked or all ends asked for).
    """
    if p.circular:
        from . import circular

        if others is not None:
            raise ValueError("the ends of a circular profile's other alignments aren't kept")
        return circular.best_ends(p, codes, locked, first, last, cutoff)
    n = len(codes)
    score, end = np.full(n, NEG, np.int64), np.zeros(n, np.int64)
    first = np.ones(n, bool) if first is None else np.asarray(first, bool)
    last = np.ones(n, bool) if last is None else np.asarray(last, bool)
    order = sorted((k for k in range(n) if len(codes[k])), key=lambda k: len(codes[k]))
    if locked is None and others is None:
        from . import tiled

        while order and len(codes[order[-1]]) > 2 * tiled.TILE:
            k = order.pop()
            score[k], end[k] = tiled.best_end(p, codes[k], bool(first[k]), bool(last[k]), cutoff)
    at = 0
    while at < len(order):
        to, least = at + 1, len(codes[order[at]])
        while to < len(order) and (to + 1 - at) * len(codes[order[to]]) <= BLOCK and len(codes[order[to]]) <= max(64, least * 5 // 4):
            to += 1
        part = order[at:to]
        score[part], end[part] = _best_ends(p, [codes[k] for k in part], [locked[k] for k in part] if locked else None, first[part], last[part], cutoff, others, part, enough)
        at = to
    return score, end


def _allowed(v) -> bool:
    return v > NEG // 2


def _best_ends(p: Profile, codes: list[np.ndarray], locked: list[np.ndarray] | None, first: np.ndarray, last: np.ndarray, cutoff: int | None, others: list | None, names: list[int], enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The states of one profile position for all letters at once, position after position.

    Along the letters only insertions depend on each other: a running maximum
    after taking off the summed cost of inserting. A state that can't be is None.
    """
    sizes = np.array([len(c) for c in codes])
    n, width, letters = len(codes), int(sizes.max()), p.match.shape[1]
    grid = np.full((n, width + 1), letters, np.uint8)  # column j: after j letters; past the end a letter that nothing matches
    lock = np.zeros((n, width + 1), bool) if locked else None
    for i, c in enumerate(codes):
        grid[i, 1 : len(c) + 1] = c
        if locked:
            lock[i, 1 : len(c) + 1] = locked[i]
    steps = p.insert[_allowed(p.insert)] if p.insert.size else p.insert
    small = width < 1 << 16 and lock is None and np.abs(steps).max(initial=0) + np.abs(p.trans["ii"][_allowed(p.trans["ii"])]).max(initial=0) < 1 << 12
    kind = np.int32 if small and _allowed(p.insert).all() else np.int64
    column = np.arange(width + 1)
    t, size = p.trans, p.length
    start, later = ({s: p.enter(s, x) for s in STATES} for x in (True, False))
    inner, final = ({s: p.leave(s, x) for s in STATES} for x in (False, True))
    best, at, done = np.full(n, NEG, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
    rows = np.arange(n)
    top = np.full((n, width + 1), NEG, kind) if others is not None else None

    def over(*terms):
        out = None
        for x, v in terms:
            if x is not None and _allowed(v):
                y = x + kind(v)
                out = y if out is None else np.maximum(out, y, out=out)
        return out

    def entered(out, state, pos):
        s, v = int(start[state][pos]), int(later[state][pos])
        head = np.where(first[rows], s, v).astype(kind)
        if not _allowed(v) and not _allowed(head).any():
            return out
        if out is None:
            out = np.full((len(rows), width + 1), NEG, kind)
        column0 = np.maximum(out[:, 0], head)
        np.maximum(out, kind(max(v, NEG)), out=out)
        out[:, 0] = column0
        return out

    def note(x, state, pos):
        i, f = int(inner[state][pos]), int(final[state][pos])
        if x is None or not (_allowed(i) or _allowed(f)):
            return
        if state != "m":
            x = np.where((column >= 1) & (column <= sizes[rows, None]), x, kind(NEG))
        tips = np.where(last[rows], f, i)
        if top is not None:
            if _allowed(i):
                body = x + kind(i)
                body[np.arange(len(rows)), sizes[rows]] = NEG
                np.maximum(top, body, out=top)
            at_end = np.arange(len(rows)), sizes[rows]
            top[at_end] = np.maximum(top[at_end], (x[at_end].astype(np.int64) + tips).clip(NEG))
        if (tips == i).all():
            j = x.argmax(axis=1)
            v = x[np.arange(len(rows)), j].astype(np.int64) + i
        else:
            tip = x[np.arange(len(rows)), sizes[rows]].astype(np.int64) + tips
            x = x.copy()
            x[np.arange(len(rows)), sizes[rows]] = NEG
            j = x.argmax(axis=1)
            v = x[np.arange(len(rows)), j].astype(np.int64) + i
            j = np.where(tip > v, sizes[rows], j)
            v = np.maximum(v, tip)
        better = (v > best[rows]) | ((v == best[rows]) & (j < at[rows]))
        best[rows[better]], at[rows[better]] = v[better], j[better]

    m = d = None
    for pos in range(size + 1):
        km = kd = ki = turned = None
        if pos and m is not None:
            km = np.empty((len(rows), width + 1), kind)
            km[:, 0] = NEG
            np.add(m[:, :-1], np.r_[p.match[pos - 1], NEG].astype(kind)[grid[:, 1:]], out=km[:, 1:])
            if lock is not None and p.n1 <= pos <= p.last:
                km[lock] = NEG
        if pos and d is not None and _allowed(p.delete[pos - 1]):
            kd = d + kind(p.delete[pos - 1])
        base = entered(over((km, t["mi"][pos]), (kd, t["di"][pos])), "i", pos)
        if base is not None:
            gain, held = p.insert[pos], lock is not None and p.n1 <= pos < p.last
            if not _allowed(t["ii"][pos]):
                turned = base
            elif (gain == gain[0]).all() and _allowed(gain[0]) and not held:
                cost = (column * (gain[0] + t["ii"][pos])).astype(kind)
                turned = np.maximum.accumulate(base - cost, axis=1)
                turned += cost
            else:
                each = np.r_[gain, gain[0]].astype(np.int64)[grid] + int(t["ii"][pos])
                if held:
                    each[lock] = NEG
                cost = np.cumsum(each, axis=1)
                turned = np.maximum.accumulate(base - cost, axis=1) + cost
            ki = np.empty((len(rows), width + 1), kind)
            ki[:, 0] = NEG
            np.add(np.maximum(turned[:, :-1], NEG), np.r_[gain, gain[0]].astype(kind)[grid[:, 1:]], out=ki[:, 1:], casting="unsafe")
            if held:
                ki[lock] = NEG
            np.maximum(ki, NEG, out=ki)
        for x, state in ((ki, "i"), (km, "m"), (kd, "d")):
            note(x, state, pos)
        m, d = (entered(over((km, t["m" + s][pos]), (ki, t["i" + s][pos]), (kd, t["d" + s][pos])), s, pos) for s in "md")
        for x in (m, d):
            if x is not None:
                np.maximum(x, NEG, out=x)
        if cutoff is not None and (best[rows] >= cutoff).any():  # these have reached it
            live = best[rows] < cutoff
            rows, grid = rows[live], grid[live]
            m, d = (x if x is None else x[live] for x in (m, d))
            lock = lock if lock is None else lock[live]
            if not len(rows):
                break
    if others is not None:
        for r, name in enumerate(names):
            own = top[r, : sizes[r] + 1]
            others[name] = np.flatnonzero((own == best[r]) if enough is None else (own >= enough) & _allowed(own)) if _allowed(best[r]) else np.zeros(0, np.int64)
    return best, at


@dataclass(frozen=True)
class Match:
    """One alignment: 1-based inclusive places; ``aligned`` has matches in upper case, insertions in lower, '-' for deletions."""

    score: int
    begin: int
    end: int
    motif_start: int
    motif_end: int  # counted from the end: -1 is the last position
    protected_begin: int
    protected_end: int
    aligned: str
    repeats: tuple = ()  # of a circular profile's path over the join: (begin, end, motif_start, motif_end) of each turn


def best_match(p: Profile, codes: np.ndarray, seq: str, locked: np.ndarray | None = None, first: bool = True, last: bool = True) -> Match | None:
    """The best alignment and its path; letters that are ``locked`` can't be used inside the protected positions.

    ``first`` and ``last``: whether the letters begin and end the sequence, or are a part of it.
    """
    if p.circular:
        from . import circular

        return circular.best_match(p, codes, seq, locked, first, last)
    n, size = len(codes), p.length
    if not n:
        return None
    t = p.trans
    match, insert, delete = np.vstack([np.full(p.match.shape[1], NEG), p.match]), p.insert, np.r_[NEG, p.delete]
    # came[row, state, position]: 0 start, 1 m, 2 i, 3 d — what precedes the state that is ready to go on
    came = np.zeros((n + 1, 3, size + 1), np.int8)

    def ready(row, km, ki, enter):
        """States after the letters so far; deletions run along the positions."""
        options = np.stack([enter["d"], km + t["md"], ki + t["id"]])
        d = np.maximum(options.max(axis=0), NEG)
        came[row, 2] = options.argmax(axis=0)
        run = _deletions(p, d)
        came[row, 2][run > d] = 3
        kd = np.full(size + 1, NEG, np.int64)
        kd[1:] = run[:-1]
        kd += delete
        made = {"d": run}
        for s, k in (("m", 0), ("i", 1)):
            options = np.stack([enter[s], km + t["m" + s], ki + t["i" + s], kd + t["d" + s]])
            came[row, k] = options.argmax(axis=0)
            made[s] = np.maximum(options.max(axis=0), NEG)
        return made, kd

    none = np.full(size + 1, NEG, np.int64)
    state, _ = ready(0, none, none, {s: p.enter(s, first) for s in STATES})
    later = {s: p.enter(s, False) for s in STATES}
    inner, final = ({s: p.leave(s, x) for s in STATES} for x in (False, last))
    protect = np.zeros(size + 1, bool)
    protect[p.n1 : p.last + 1] = True
    best = (NEG, 0, 0, 0)
    for row in range(1, n + 1):
        c = codes[row - 1]
        km = np.full(size + 1, NEG, np.int64)
        km[1:] = state["m"][:-1]
        km = np.maximum(km + match[:, c], NEG)
        ki = np.maximum(state["i"] + insert[:, c], NEG)
        if locked is not None and locked[row - 1]:
            km[protect] = NEG
            ki[p.n1 : p.last] = NEG
        state, kd = ready(row, km, ki, later)
        out = final if row == n else inner
        for code, k, o in ((2, ki, out["i"]), (1, km, out["m"]), (3, kd, out["d"])):
            at = int((k + o).argmax())
            if k[at] + o[at] > best[0]:
                best = (int(k[at] + o[at]), row, code, at)
    if best[0] <= NEG // 2:
        return None
    score, row, code, at = best
    end, final_at = row, at
    letters: list[str] = []
    inside: list[int] = []
    while True:
        if code == 1:
            letters.append(seq[row - 1].upper())
            if p.n1 <= at <= p.last:
                inside.append(row)
            at, row, k = at - 1, row - 1, 0
        elif code == 2:
            letters.append(seq[row - 1].lower())
            if p.n1 <= at < p.last:
                inside.append(row)
            row, k = row - 1, 1
        else:
            letters.append("-")
            at, k = at - 1, 2
        code = int(came[row, k, at])
        if code == 0:
            break
    begin = row + 1
    return Match(score, begin, end, at + 1, final_at - size - 1, min(inside, default=begin), max(inside, default=end), "".join(reversed(letters)))


def _traced(p: Profile, codes: np.ndarray, seq: str, score: int, end: int, locked: np.ndarray | None, first: bool, last: bool) -> Match | None:
    """The path of an alignment of this score and end, if there is one: sought in a stretch before its end, a longer one if it doesn't have the score."""
    size = 2 * p.length + 8
    while True:
        low = max(0, end - size)
        m = best_match(p, codes[low:end], seq[low:end], None if locked is None else locked[low:end], first and low == 0, last and end == len(codes))
        if low == 0 and (m is None or m.score != score):
            return None
        if m is not None and m.score == score:
            repeats = tuple((b + low, e + low, *rest) for b, e, *rest in m.repeats)
            return replace(m, begin=m.begin + low, end=m.end + low, protected_begin=m.protected_begin + low, protected_end=m.protected_end + low, repeats=repeats)
        size *= 4


def matches(p: Profile, codes: np.ndarray, seq: str, cutoff: int, unique: bool = False, limit: int | None = None) -> list[Match]:
    """``all_matches`` of one sequence."""
    return all_matches(p, [codes], [seq], cutoff, unique, limit)[0]


def all_matches(p: Profile, codes: list[np.ndarray], seqs: list[str], cutoff: int, unique: bool = False, limit: int | None = None) -> list[list[Match]]:
    """Alignments of at least ``cutoff`` in each sequence whose protected parts are apart, in the order of the sequence.

    The best is taken first and the letters of its protected part are locked
    for the next, until none reaches the cutoff; ``unique`` takes only the first,
    ``limit`` so many. Where all positions are protected no alignment reaches
    over a locked stretch, so the parts left and right of it are searched by
    themselves. Each round works on all sequences side by side.
    """
    if p.n1 == 1 and p.last == p.length and not unique and not p.circular:
        return _apart(p, codes, seqs, cutoff, limit)
    found: list[list[Match]] = [[] for _ in codes]
    locked = [np.zeros(len(c), bool) for c in codes]
    live = [k for k in range(len(codes)) if len(codes[k])]
    while live and (limit is None or limit > 0):
        score, end = best_ends(p, [codes[k] for k in live], [locked[k] for k in live])
        again = []
        for k, s, e in zip(live, score.tolist(), end.tolist(), strict=True):
            if s < cutoff or s <= NEG // 2:
                continue
            m = _traced(p, codes[k], seqs[k], s, e, locked[k], True, True)
            if locked[k][m.protected_begin - 1 : m.protected_end].all():  # it passes over the protected positions: nothing new would come
                continue
            found[k].append(m)
            locked[k][m.protected_begin - 1 : m.protected_end] = True
            if not unique and (limit is None or len(found[k]) < limit):
                again.append(k)
        live = again
    return [sorted(ms, key=lambda m: (m.begin, m.end)) for ms in found]


def _apart(p: Profile, codes: list[np.ndarray], seqs: list[str], cutoff: int, limit: int | None) -> list[list[Match]]:
    """``all_matches`` when all positions are protected."""
    found: list[list[Match]] = [[] for _ in codes]
    parts = [(k, 0, len(c)) for k, c in enumerate(codes)]
    while parts := [x for x in parts if x[2] > x[1]]:
        first, last = np.array([a == 0 for _, a, _ in parts]), np.array([b == len(codes[k]) for k, _, b in parts])
        ends: list = [None] * len(parts)
        score, _ = best_ends(p, [codes[k][a:b] for k, a, b in parts], None, first, last, others=ends)
        new = []
        for (k, a, b), s, es, f, t in zip(parts, score.tolist(), ends, first.tolist(), last.tolist(), strict=True):
            if s < cutoff or s <= NEG // 2:
                continue
            low = 0  # of equally good ones the earliest is taken, and the next ones that lie behind it
            for e in es.tolist():
                at = a + low
                m = _traced(p, codes[k][at:b], seqs[k][at:b], s, e - low, None, f and low == 0, t) if e > low else None
                if m is None:
                    continue
                m = replace(m, begin=m.begin + at, end=m.end + at, protected_begin=m.protected_begin + at, protected_end=m.protected_end + at)
                found[k].append(m)
                new.append((k, at, m.protected_begin - 1))
                low = m.protected_end - a
            new.append((k, a + low, b))
        parts = new
    if limit is not None:
        found = [sorted(ms, key=lambda m: (-m.score, m.begin))[:limit] for ms in found]
    return [sorted(ms, key=lambda m: (m.begin, m.end)) for ms in found]


def rescore(p: Profile, aligned: str, first: bool = True, last: bool = True) -> int:
    """Score of a whole-profile alignment string under a profile of the same length; NEG if it has another length."""
    if sum(not c.islower() for c in aligned) != p.length:
        return NEG
    at, state, score = 0, None, 0
    for c in aligned:
        now = "d" if c == "-" else "i" if c.islower() else "m"
        score += int(p.enter(now, first)[at] if state is None else p.trans[state + now][at])
        if now == "d":
            at += 1
            score += int(p.delete[at - 1])
        else:
            code = p.encode(c.upper())[0]
            if now == "m":
                at += 1
            score += int(p.match[at - 1, code] if now == "m" else p.insert[at, code])
        state = now
    return score + int(p.leave(state, last)[at]) if state else NEG


def sample(p: Profile, rng: np.random.Generator, scale: float = 0.02, longest: int = 100) -> str:
    """A random sequence: at each step match, insert or delete by the softmax of scaled scores; over ``longest`` insertions in a row is an error."""
    out, at, state, run = [], 0, "m", 0
    letters = np.array(list(p.alphabet))
    pick = lambda w: int(np.searchsorted(np.cumsum(w) / w.sum(), rng.random(), "right"))
    while at < p.length:
        ways = [np.exp(scale * (max(p.trans[state + "m"][at], -10**6) + p.match[at, 1:].max())), np.exp(scale * (max(p.trans[state + "i"][at], -10**6) + p.insert[at, 1:].max())), np.exp(scale * (max(p.trans[state + "d"][at], -10**6) + p.delete[at]))]
        state = STATES[pick(np.array(ways))]
        if state == "d":
            at += 1
            continue
        row = p.match[at, 1:] if state == "m" else p.insert[at, 1:]
        out.append(letters[min(pick(np.exp(scale * (row - row.max()))), len(letters) - 1)])
        run = run + 1 if state == "i" else 0
        if run > longest:
            raise ValueError("too many insertions in a row")
        at += state == "m"
    return "".join(out)


def mutate(seq: str, alphabet: str, events: int, rng: np.random.Generator, gaps: float = 0.1, longer: float = 0.5) -> str:
    """A sequence after so many random events.

    A share ``gaps`` of the events are deletions of one letter and insertions,
    half each; the others put any letter in a place. The lengths of insertions
    are geometric, each further letter with the chance ``longer``. Two letters
    are left at least.
    """
    letters = list(seq)
    kinds = rng.random(events) / gaps if gaps > 0 else np.full(events, 2.0)
    for kind in kinds.tolist():
        if len(letters) < 2:
            break
        place = int(rng.integers(len(letters)))
        if kind >= 1:
            letters[place] = alphabet[int(rng.integers(len(alphabet)))]
        elif kind >= 0.5 and len(letters) > 2:
            letters.pop(place)
        else:
            new = rng.integers(len(alphabet), size=int(rng.geometric(1 - longer)))
            letters[place:place] = [alphabet[k] for k in new]
    return "".join(letters)
