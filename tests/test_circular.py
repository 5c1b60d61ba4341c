"""Circular profiles against a plain program, letter by letter, whose joins are followed until nothing changes."""

import numpy as np
import pytest

from motifloom.operators import circular, postprocess, search
from motifloom.operators import kernels as K
from motifloom.operators.search import Motif

NEG = K.NEG


def profile(rng, size, more=True):
    p = K.linear(rng.integers(-4, 5, (size, 4)), "ABC", int(rng.integers(-9, -1)), int(rng.integers(-3, 0)), circular=True)
    if more:
        p.trans["id"][:] = rng.integers(-5, 0, size + 1)
        p.trans["di"][:] = rng.integers(-5, 0, size + 1)
        p.insert[:] = rng.integers(-3, 1, p.insert.shape)
        for k in ("b0", "b1", "e0", "e1"):
            p.border[k][:] = rng.integers(-3, 1, size + 1)
        p.border["bd"][:], p.border["de"][:], p.border["bi"][:], p.border["ie"][:] = -1, -2, -2, -1
    return p


def plain(p, codes, locked=None, first=True, last=True):
    L, best = p.length, (NEG, 0)
    add = lambda a, b: max(a + b, NEG)

    def close(km, ki, enter):
        kd = [NEG] * (L + 1)
        y = {s: [max(enter[s][k], add(km[k], p.trans["m" + s][k]), add(ki[k], p.trans["i" + s][k])) for k in range(L + 1)] for s in "mid"}
        while True:
            before = [*y["m"], *y["i"], *y["d"], *kd]
            for k in range(1, L + 1):
                kd[k] = max(kd[k], add(y["d"][k - 1], p.delete[k - 1]))
            for s in "mid":
                for k in range(L + 1):
                    y[s][k] = max(y[s][k], add(kd[k], p.trans["d" + s][k]))
                y[s][0] = max(y[s][0], y[s][L])
            if before == [*y["m"], *y["i"], *y["d"], *kd]:
                return y, kd

    y, _ = close([NEG] * (L + 1), [NEG] * (L + 1), {s: p.enter(s, first).tolist() for s in "mid"})
    for j, c in enumerate(codes):
        km = [NEG] + [add(y["m"][k - 1], p.match[k - 1, c]) for k in range(1, L + 1)]
        ki = [add(y["i"][k], p.insert[k, c]) for k in range(L + 1)]
        if locked is not None and locked[j]:
            km = [NEG if p.n1 <= k <= p.last else v for k, v in enumerate(km)]
            ki = [NEG if p.n1 <= k < p.last else v for k, v in enumerate(ki)]
        y, kd = close(km, ki, {s: p.enter(s, False).tolist() for s in "mid"})
        out = {s: p.leave(s, last and j + 1 == len(codes)).tolist() for s in "mid"}
        top = max(add(v[k], out[s][k]) for s, v in (("m", km), ("i", ki), ("d", kd)) for k in range(L + 1))
        if top > best[0]:
            best = int(top), j + 1
    return best


def walked(p, m, n):
    """Score of a match along its aligned string, over the join as often as it goes."""
    k, state, score, row = m.motif_start - 1, None, 0, m.begin - 1
    for c in m.aligned:
        now = "d" if c == "-" else "i" if c.islower() else "m"
        if k == p.length and now != "i" and state is not None:
            score_at = p.trans[state + now][k]
            k = 0
        else:
            score_at = p.enter(now, row == 0)[k] if state is None else p.trans[state + now][k]
        score += int(score_at)
        code = p.encode(c.upper())[0]
        k += now != "i"
        row += now != "d"
        score += int(p.delete[k - 1] if now == "d" else p.match[k - 1, code] if now == "m" else p.insert[k, code])
        state = now
    assert row == m.end
    return score + int(p.leave(state, row == n)[k])


@pytest.mark.parametrize("more", [False, True])
def test_scores_and_paths(more):
    rng = np.random.default_rng(int(more))
    for k in range(40):
        p = profile(rng, int(rng.integers(1, 6)), more)
        seqs = ["".join(rng.choice(list("ABCX"), int(rng.integers(0, 25)))) for _ in range(6)]
        codes = [p.encode(s) for s in seqs]
        locked = [rng.random(len(s)) < 0.2 for s in seqs] if k % 2 else None
        score, end = K.best_ends(p, codes, locked)
        for i, s in enumerate(seqs):
            want = plain(p, codes[i], locked[i] if locked else None)
            assert (int(score[i]), int(end[i])) == want
            m = K.best_match(p, codes[i], s, locked[i] if locked else None)
            assert (m.score if m else NEG) == want[0] or want[0] <= NEG // 2
            if m and not more:
                assert walked(p, m, len(s)) == m.score
            if m and m.repeats:
                assert m.repeats[0][0] == m.begin and m.repeats[-1][1] == m.end
                assert all(b[0] == a[1] + 1 and b[2] == 1 and a[3] == -1 for a, b in zip(m.repeats, m.repeats[1:]))


def test_search_gives_turns(spark):
    p = K.linear(np.array([[-5, 6, -5, -5], [-5, -5, 6, -5], [-5, -5, -5, 6]]), "ABC", -8, -3, circular=True)
    lib = spark.createDataFrame([("a", "XXABCABCABXX"), ("b", "BCAB" + "X" * 20 + "CABCABC"), ("c", "XXX"), ("d", None), ("e", "ABCABXCABC")], "seq_id string, sequence string")
    hits = search.search(lib, [Motif(p, 18, None, "C"), Motif(K.linear(p.match, "ABC", -8, -3), 12, None, "L")], repeats=True)
    got = {(r.seq_id, r.motif_ac, r.begin): (r.end, r.raw_score, r.motif_start, r.motif_end, r.aligned, [tuple(x) for x in r.sub_hits]) for r in hits.collect()}
    assert got["a", "C", 3] == (10, 48, 1, -2, "ABCABCAB", [(3, 5, 1, -1), (6, 8, 1, -1), (9, 10, 1, -2)])
    assert got["b", "C", 1] == (4, 24, 2, -2, "BCAB", [(1, 2, 2, -1), (3, 4, 1, -2)]) and got["b", "C", 25][1] == 42
    assert got["e", "C", 1][0] == 10 and all(v[5] == [] for k, v in got.items() if k[1] == "L")
    assert {k[0] for k in got if k[1] == "C"} == {"a", "b", "e"}
    rows = postprocess.unroll(hits.where("motif_ac = 'C' AND seq_id = 'a'")).select("begin", "end").collect()
    assert sorted(map(tuple, rows)) == [(3, 5), (6, 8), (9, 10)]
    scored = {r.seq_id: r.score for r in search.with_score(lib, p).collect()}
    assert scored["a"] == 48 and scored["d"] is None


def test_no_entry_point_takes_them_as_linear(spark):
    p = K.linear(np.array([[0, 1, 2]]), "AB", circular=True)
    lib = spark.createDataFrame([("x", "AB")], "seq_id string, sequence string")
    with pytest.raises(ValueError):
        search.search(lib, [Motif(p, 1, 5)])
    for f in (search.with_h_score, search.score_dump):
        with pytest.raises(Exception, match="no prefilter"):
            f(lib, p).collect()
    with pytest.raises(ValueError):
        circular.check(K.Profile("A", np.array([[0, 1]]), np.zeros((2, 2)), np.array([3])))
    assert search.with_score(lib, p).first().score == 3  # A and B: one turn each
    assert search.survivors(lib, search.search(lib, [Motif(p, 3)])).count() == 1
