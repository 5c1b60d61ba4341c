"""Exact scores of very long sequences in bounded memory: letters by tiles.

Within a tile positions follow each other over all its letters, as for short
sequences. Across a tile's edge go, for each position, the state of a match and
of an insertion after the last letter; deletions stay at their letter. So memory
is that of a tile, whatever the sequence.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K

#: Letters of a tile.
TILE = 1 << 18


def best_end(p: K.Profile, codes: np.ndarray, first: bool = True, last: bool = True, cutoff: int | None = None, tile: int | None = None) -> tuple[int, int]:
    """(score, letters up to its end) of a sequence's best alignment, the earliest of equal ones; with ``cutoff`` the search ends with the tile that reaches it."""
    size, n, tile = p.length, len(codes), tile or TILE
    best, end = K.NEG, 0
    if not n:
        return best, end
    t = p.trans
    enter = {s: p.enter(s, False) for s in K.STATES}
    begin = {s: p.enter(s, first) for s in K.STATES}
    inner, final = ({s: p.leave(s, x) for s in K.STATES} for x in (False, last))
    # states before the first letter: entries, and deletions from them
    run = K._deletions(p, np.maximum(begin["d"], K.NEG))
    kd = np.r_[K.NEG, np.maximum(run[:-1] + p.delete, K.NEG)]
    edge_m, edge_i = (np.maximum(np.maximum(begin[s], kd + t["d" + s]), K.NEG) for s in "mi")
    add = lambda x, v: np.maximum(x + int(v), K.NEG)
    for low in range(0, n, tile):
        own = codes[low : low + tile]
        width, at_end = len(own), low + len(own) == n
        m = d = None
        new_m, new_i = np.empty(size + 1, np.int64), np.empty(size + 1, np.int64)
        for pos in range(size + 1):
            none = np.full(width, K.NEG, np.int64)
            km = np.maximum(m[:-1] + p.match[pos - 1][own], K.NEG) if pos else none
            kd = add(d, p.delete[pos - 1]) if pos else none
            ready = np.empty(width + 1, np.int64)
            ready[0] = edge_i[pos]
            ready[1:] = np.maximum(np.maximum(add(km, t["mi"][pos]), add(kd, t["di"][pos])), enter["i"][pos])
            gain = p.insert[pos][own].astype(np.int64)
            if K._allowed(t["ii"][pos]) and K._allowed(gain).all():
                cost = np.r_[0, np.cumsum(gain + int(t["ii"][pos]))]
                ready = np.maximum.accumulate(ready - cost) + cost
            elif K._allowed(t["ii"][pos]):
                for k in np.flatnonzero(K._allowed(gain)).tolist():
                    ready[k + 1] = max(ready[k + 1], ready[k] + gain[k] + int(t["ii"][pos]))
            np.maximum(ready, K.NEG, out=ready)
            ki = np.maximum(ready[:-1] + gain, K.NEG)
            new_i[pos] = ready[-1]
            for x, s in ((km, "m"), (ki, "i"), (kd, "d")):
                out = add(x, inner[s][pos])
                if at_end:
                    out[-1] = max(int(x[-1]) + int(final[s][pos]), K.NEG)
                k = int(out.argmax())
                if out[k] > best or (out[k] == best and low + k + 1 < end):
                    best, end = int(out[k]), low + k + 1
            m = np.empty(width + 1, np.int64)
            m[0] = edge_m[pos]
            m[1:] = np.maximum(np.maximum(add(km, t["mm"][pos]), add(ki, t["im"][pos])), np.maximum(add(kd, t["dm"][pos]), enter["m"][pos]))
            d = np.maximum(np.maximum(add(km, t["md"][pos]), add(ki, t["id"][pos])), np.maximum(add(kd, t["dd"][pos]), enter["d"][pos]))
            np.maximum(m, K.NEG, out=m)
            np.maximum(d, K.NEG, out=d)
            new_m[pos] = m[-1]
        edge_m, edge_i = new_m, new_i
        if cutoff is not None and best >= cutoff:
            break
    return (best, end) if best > K.NEG // 2 else (K.NEG, 0)
