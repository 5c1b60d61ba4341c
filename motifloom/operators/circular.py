"""Profiles whose end joins their begin: paths that run through a profile any number of times.

The state ready to go on after the last position is also the state before the
first, at the same letter, so positions can't be taken one after the other over
all letters. Here letters follow each other, over all positions of many
sequences side by side; deletions that run over the join are carried on once
more round the profile (a whole turn of deletions never gains).
"""

from __future__ import annotations

import numpy as np

from . import kernels as K


def check(p: K.Profile) -> None:
    """A turn of deletions alone has to cost, else scores have no bound."""
    if K._allowed(p.delete).all() and int((p.delete + p.trans["dd"][1:]).sum()) > 0:
        raise ValueError("a circular profile gains by deleting all of it")


def _turned(p: K.Profile, made: dict[str, np.ndarray], kd: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The states with position 0 also reached from the last one; the last axis is the position."""
    for x in made.values():
        x[..., 0] = np.maximum(x[..., 0], x[..., -1])
    run = K._deletions(p, made["d"])
    if (run > made["d"]).any():
        made["d"] = run
        kd = np.concatenate([np.full((*kd.shape[:-1], 1), K.NEG), np.maximum(run[..., :-1] + p.delete, K.NEG)], axis=-1)
        for s in "mi":
            made[s] = np.maximum(made[s], np.maximum(kd + p.trans["d" + s], K.NEG))
    return made, kd


def best_ends(
    p: K.Profile, codes: list[np.ndarray], locked: list[np.ndarray] | None = None, first: np.ndarray | None = None, last: np.ndarray | None = None, cutoff: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """``kernels.best_ends`` of a circular profile."""
    check(p)
    n, size, t = len(codes), p.length, p.trans
    score, end = np.full(n, K.NEG, np.int64), np.zeros(n, np.int64)
    first = np.ones(n, bool) if first is None else np.asarray(first, bool)
    last = np.ones(n, bool) if last is None else np.asarray(last, bool)
    lengths = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    if not len(order):
        return score, end
    match = np.vstack([np.full(p.match.shape[1], K.NEG), p.match]).T  # (letters, positions)
    insert = p.insert.T
    begin = {s: np.where(first[order, None], p.enter(s, True), p.enter(s, False)) for s in K.STATES}
    later = {s: p.enter(s, False)[None] for s in K.STATES}
    inner, final = ({s: p.leave(s, x)[None] for s in K.STATES} for x in (False, True))

    def ready(km, ki, enter):
        d = np.maximum(np.maximum(np.maximum(enter["d"], km + t["md"]), ki + t["id"]), K.NEG)
        run = K._deletions(p, d)
        kd = np.full(run.shape, K.NEG, np.int64)
        kd[:, 1:] = np.maximum(run[:, :-1] + p.delete, K.NEG)
        made = {"d": run}
        for s in "mi":
            made[s] = np.maximum(np.maximum(np.maximum(enter[s], km + t["m" + s]), np.maximum(ki + t["i" + s], kd + t["d" + s])), K.NEG)
        return _turned(p, made, kd)

    none = np.full((len(order), size + 1), K.NEG, np.int64)
    state, _ = ready(none, none, begin)
    best, at = np.full(len(order), K.NEG, np.int64), np.zeros(len(order), np.int64)
    live = np.arange(len(order))
    tall = lengths[order]
    for j in range(int(tall[0])):
        keep = tall[live] > j
        if cutoff is not None:
            keep &= best[live] < cutoff
        if not keep.all():
            live = live[keep]
            if not len(live):
                break
            state = {s: x[keep] for s, x in state.items()}
        c = np.fromiter((codes[order[r]][j] for r in live), np.int64, len(live))
        km = np.full((len(live), size + 1), K.NEG, np.int64)
        km[:, 1:] = np.maximum(state["m"][:, :-1] + match[c, 1:], K.NEG)
        ki = np.maximum(state["i"] + insert[c], K.NEG)
        if locked is not None:
            held = np.fromiter((locked[order[r]][j] for r in live), bool, len(live))
            km[held, p.n1 : p.last + 1] = K.NEG
            ki[held, p.n1 : p.last] = K.NEG
        state, kd = ready(km, ki, later)
        tip = ((tall[live] == j + 1) & last[order[live]])[:, None]
        out = np.maximum.reduce([(k + np.where(tip, final[s], inner[s])).max(axis=1) for s, k in (("m", km), ("i", ki), ("d", kd))])
        better = out > best[live]
        best[live[better]], at[live[better]] = out[better], j + 1
    score[order], end[order] = np.maximum(best, K.NEG), at
    return score, end


def best_match(p: K.Profile, codes: np.ndarray, seq: str, locked: np.ndarray | None = None, first: bool = True, last: bool = True) -> K.Match | None:
    """The best alignment with its path and its repeats: what lies between two passages over the join."""
    check(p)
    n, size, t = len(codes), p.length, p.trans
    if not n:
        return None
    match, insert = np.vstack([np.full(p.match.shape[1], K.NEG), p.match]), p.insert
    # came[row, state, position]: 0 start, 1 m, 2 i, 3 d, 4 over the join
    came = np.zeros((n + 1, 3, size + 1), np.int8)

    def ready(row, km, ki, enter):
        options = np.stack([enter["d"], km + t["md"], ki + t["id"]])
        d = np.maximum(options.max(axis=0), K.NEG)
        came[row, 2] = options.argmax(axis=0)
        run = K._deletions(p, d)
        came[row, 2][run > d] = 3
        kd = np.r_[K.NEG, np.maximum(run[:-1] + p.delete, K.NEG)]
        made = {"d": run}
        for s, k in (("m", 0), ("i", 1)):
            options = np.stack([enter[s], km + t["m" + s], ki + t["i" + s], kd + t["d" + s]])
            came[row, k] = options.argmax(axis=0)
            made[s] = np.maximum(options.max(axis=0), K.NEG)
        for s, k in (("m", 0), ("i", 1), ("d", 2)):
            if made[s][-1] > made[s][0]:
                came[row, k, 0] = 4
        before = {s: x.copy() for s, x in made.items()}
        made, kd = _turned(p, made, kd)
        for s, k in (("m", 0), ("i", 1), ("d", 2)):
            came[row, k, 1:][made[s][1:] > before[s][1:]] = 3
        return made, kd

    none = np.full(size + 1, K.NEG, np.int64)
    state, _ = ready(0, none, none, {s: p.enter(s, first) for s in K.STATES})
    later = {s: p.enter(s, False) for s in K.STATES}
    inner, final = ({s: p.leave(s, x) for s in K.STATES} for x in (False, last))
    best = (K.NEG, 0, 0, 0)
    for row in range(1, n + 1):
        c = codes[row - 1]
        km = np.r_[K.NEG, np.maximum(state["m"][:-1] + match[1:, c], K.NEG)]
        ki = np.maximum(state["i"] + insert[:, c], K.NEG)
        if locked is not None and locked[row - 1]:
            km[p.n1 : p.last + 1] = K.NEG
            ki[p.n1 : p.last] = K.NEG
        state, kd = ready(row, km, ki, later)
        out = final if row == n else inner
        for code, k, o in ((2, ki, out["i"]), (1, km, out["m"]), (3, kd, out["d"])):
            at = int((k + o).argmax())
            if k[at] + o[at] > best[0]:
                best = (int(k[at] + o[at]), row, code, at)
    if best[0] <= K.NEG // 2:
        return None
    score, end, code, at = best
    row, steps, final_at = end, [], at  # steps: (state, position after it, row after it, over the join before it)
    while code:
        steps.append([code, at, row, False])
        k = {1: 0, 2: 1, 3: 2}[code]
        at, row = at - (code != 2), row - (code != 3)
        code = int(came[row, k, at])
        if code == 4:
            steps[-1][3], at = True, size
            code = int(came[row, k, at])
    start_at, begin = at, row + 1
    steps.reverse()
    letters, inside, parts = [], [], [[begin, begin - 1, start_at + 1, 0]]
    for code, at, row, joined in steps:
        if joined:
            parts[-1][3] = -1
            parts.append([parts[-1][1] + 1, parts[-1][1], 1, 0])
        letters.append("-" if code == 3 else seq[row - 1].upper() if code == 1 else seq[row - 1].lower())
        if code == 1 and p.n1 <= at <= p.last or code == 2 and p.n1 <= at < p.last:
            inside.append(row)
        parts[-1][1] = row if code != 3 else parts[-1][1]
    parts[-1][3] = final_at - size - 1
    repeats = tuple(tuple(x) for x in parts) if len(parts) > 1 else ()
    return K.Match(score, begin, end, start_at + 1, final_at - size - 1, min(inside, default=begin), max(inside, default=end), "".join(letters), repeats)
