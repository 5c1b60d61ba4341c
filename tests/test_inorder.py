"""Matches in the order of acceptance against a plain program that starts anew at the first letter after each."""

import numpy as np
import pytest

from motifloom.operators import inorder, search
from motifloom.operators import kernels as K

NEG = K.NEG


def plain(p, codes, cutoff):
    n, L, locked, out = len(codes), p.length, [False] * len(codes), []
    add = lambda a, b: max(int(a) + int(b), NEG)

    def ready(km, ki, enter, nxt):
        """Each cell a pair (score, [begin, first, last])."""
        best = lambda ways: max(range(len(ways)), key=lambda w: (ways[w][0], -w))
        dead, kd, state = (NEG, [0, n + 1, 0]), [], {"m": [], "i": [], "d": []}
        for k in range(L + 1):
            kd.append((add(state["d"][k - 1][0], p.delete[k - 1]), state["d"][k - 1][1]) if k else dead)
            for s in "mid":
                ways = [(int(enter[s][k]), [nxt, n + 1, 0]), (add(kd[k][0], p.trans["d" + s][k]), kd[k][1]), (add(km[k][0], p.trans["m" + s][k]), km[k][1]), (add(ki[k][0], p.trans["i" + s][k]), ki[k][1])]
                state[s].append(ways[best(ways)])
        for s, low in (("m", p.n1 - 1), ("i", p.n1)):
            for k in range(low, p.last):
                v, (b, f, _) = state[s][k]
                state[s][k] = v, [b, min(f, nxt), nxt]
        return state, kd

    dead = (NEG, [0, n + 1, 0])
    while True:
        state, _ = ready([dead] * (L + 1), [dead] * (L + 1), {s: p.enter(s, True) for s in "mid"}, 1)
        top = None
        for j in range(1, n + 1):
            c = codes[j - 1]
            if locked[j - 1]:
                for s, low in (("m", p.n1 - 1), ("i", p.n1)):
                    for k in range(low, p.last):
                        state[s][k] = NEG, state[s][k][1]
            km = [dead] + [(add(state["m"][k - 1][0], p.match[k - 1, c]), state["m"][k - 1][1]) for k in range(1, L + 1)]
            ki = [(add(state["i"][k][0], p.insert[k, c]), state["i"][k][1]) for k in range(L + 1)]
            state, kd = ready(km, ki, {s: p.enter(s, False) for s in "mid"}, j + 1)
            leave = {s: p.leave(s, j == n) for s in "mid"}
            for k in range(L + 1):
                for s, v in (("d", kd), ("m", km), ("i", ki)):
                    e = add(v[k][0], leave[s][k])
                    if e > NEG // 2 and (top is None or e > top[0]):
                        b, f, last = v[k][1]
                        top = e, b, b if f > n else f, last or j, j
            if top and top[0] >= cutoff:
                first = min([j] + [state[s][k][1][1] for s in "mid" for k in range(p.n1, L + 1) if state[s][k][0] > NEG // 2])
                if first > top[3] or j == n:
                    if all(locked[top[2] - 1 : top[3]]):
                        return out
                    out.append(top)
                    for x in range(top[2] - 1, top[3]):
                        locked[x] = True
                    break
        else:
            return out


def profiles(rng, kind):
    size = int(rng.integers(2, 7))
    p = K.linear(rng.integers(-4, 5, (size, 4)), "ABC", int(rng.integers(-9, -1)), int(rng.integers(-3, 0)))
    if kind:
        n1 = int(rng.integers(1, size + 1))
        p = K.Profile("ABC", p.match, rng.integers(-3, 1, (size + 1, 4)), p.delete, {**p.trans, "id": rng.integers(-5, 0, size + 1), "di": rng.integers(-5, 0, size + 1)}, {"b1": rng.integers(-3, 1, size + 1), "bd": rng.integers(-3, 0, size + 1)}, n1, int(rng.integers(n1, size + 1)))
    return p


@pytest.mark.parametrize("kind", [0, 1])
def test_equals_plain(kind):
    rng, many = np.random.default_rng(kind), 0
    for _ in range(40):
        p = profiles(rng, kind)
        codes = [rng.integers(0, 4, int(rng.integers(0, 40))) for _ in range(5)]
        cutoff = int(rng.integers(2, 9))
        got = inorder.found(p, codes, cutoff)
        for c, ms in zip(codes, got, strict=True):
            assert [(m.score, m.begin, m.protected_begin, m.protected_end, m.end) for m in ms] == plain(p, c, cutoff)
            many += len(ms) > 1
            spans = sorted((m.protected_begin, m.protected_end) for m in ms)
            assert kind or all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert many > 10


def test_search_both_ways(spark):
    """A longer match that begins inside the better one: best first takes the better, left to right as well; ties go to the left."""
    p = K.linear(np.array([[-4] + [5 if a == "ABCD".index(c) else -4 for a in range(4)] for c in "ABCD"]), "ABCD", -9, -3)
    lib = spark.createDataFrame([("x", "ABCDABCDXXABCD"), ("y", "ABXCD"), ("z", ""), ("n", None)], "seq_id string, sequence string")
    best = search.search(lib, [search.Motif(p, 12, None, "M")]).drop("match_no").collect()
    order = search.search(lib, [search.Motif(p, 12, None, "M", order="sequence")]).drop("match_no").collect()
    assert sorted(map(tuple, best)) == sorted(map(tuple, order)) and len(order) == 3
    one = search.search(lib, [search.Motif(p, 12, None, "M", unique=True, order="sequence")]).collect()
    assert [(r.seq_id, r.begin) for r in one] == [("x", 1)]
    with pytest.raises(ValueError):
        search.search(lib, [search.Motif(p, 12, None, "M", order="other")])
