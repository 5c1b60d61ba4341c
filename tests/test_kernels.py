import itertools

import numpy as np
import pytest

from motifloom.operators import kernels as K

RNG = np.random.default_rng(7)


def random_profile(size=6, free=False):
    p = K.linear(RNG.integers(-6, 8, (size, 5)), "ACGT", -7, -2)
    if free:
        trans = {k: RNG.integers(-9, 1, size + 1) for k in p.trans}
        border = {k: np.where(RNG.random(size + 1) < 0.3, K.NEG, RNG.integers(-5, 1, size + 1)) for k in p.border}
        border["b0"][0] = border["bm"][0] = border["e0"][-1] = border["me"][-1] = 0
        return K.Profile("ACGT", p.match, RNG.integers(-4, 2, (size + 1, 5)), RNG.integers(-4, 0, size), trans, border, 2, size - 1)
    return p


def textbook(p, codes):
    """Best path by plain recursion over (letters read, positions passed, state)."""
    from functools import cache

    n, size = len(codes), p.length

    @cache
    def go(row, at, state):
        """Best score of what follows in ``state`` at a place with at least one step made."""
        out = K.NEG
        if row > 0:
            out = int(p.leave(state, row == n)[at])
        for now in "mid":
            t = int(p.trans[state + now][at])
            if t > K.NEG // 2:
                out = max(out, t + step(row, at, now))
        return out

    @cache
    def step(row, at, now):
        if now == "d":
            return int(p.delete[at]) + go(row, at + 1, "d") if at < size else K.NEG
        if row == n or now == "m" and at == size:
            return K.NEG
        c = int(codes[row])
        return int(p.match[at, c]) + go(row + 1, at + 1, "m") if now == "m" else int(p.insert[at, c]) + go(row + 1, at, "i")

    best = K.NEG
    for row in range(n + 1):
        for at in range(size + 1):
            for now in "mid":
                best = max(best, int(p.enter(now, row == 0)[at]) + step(row, at, now))
    return best


@pytest.mark.parametrize("free", [False, True])
def test_scores_equal_textbook(free):
    for _ in range(60):
        p = random_profile(free=free)
        seqs = ["".join(RNG.choice(list("ACGTN"), RNG.integers(1, 11))) for _ in range(5)]
        got = K.scores(p, [p.encode(s) for s in seqs])
        for s, g in zip(seqs, got, strict=True):
            want = textbook(p, tuple(p.encode(s)))
            assert g == want or (g <= K.NEG // 2 and want <= K.NEG // 2), (s, g, want)


def test_one_equals_many_and_both_directions():
    p = random_profile()
    seqs = ["".join(RNG.choice(list("ACGT"), RNG.integers(1, 60))) for _ in range(300)]
    many = K.scores(p, [p.encode(s) for s in seqs])
    assert many.tolist() == [int(K.scores(p, [p.encode(s)])[0]) for s in seqs]
    r = p.reverse()
    assert many.tolist() == K.scores(r, [r.encode(s[::-1]) for s in seqs]).tolist()


def test_path_has_the_score():
    for _ in range(100):
        p = random_profile(free=False)
        s = "".join(RNG.choice(list("ACGT"), RNG.integers(4, 30)))
        m = K.best_match(p, p.encode(s), s)
        assert m.score == K.scores(p, [p.encode(s)])[0]
        assert m.aligned.replace("-", "").upper() == s[m.begin - 1 : m.end]
        assert sum(not c.islower() for c in m.aligned) == p.length + m.motif_end + 1 - m.motif_start + 1
        if m.motif_start == 1 and m.motif_end == -1:
            assert K.rescore(p, m.aligned, False, False) == m.score


def test_matches_are_apart():
    p = K.linear(np.array([[-3] + [7 if a == "ACGT".index(c) else -3 for a in range(4)] for c in "ACGTAC"]), "ACGT", -9, -2)
    s = "TTACGTACGGGACGTACTTACGGTACTT"
    found = K.matches(p, p.encode(s), s, 25)
    assert [s[m.begin - 1 : m.end] for m in found] == ["ACGTAC", "ACGTAC", "ACGGTAC"]
    assert found[2].aligned in ("ACgGTAC", "ACGgTAC")
    assert len(K.matches(p, p.encode(s), s, 25, unique=True)) == 1 and len(K.matches(p, p.encode(s), s, 25, limit=2)) == 2
    for a, b in itertools.pairwise(found):
        assert a.protected_end < b.protected_begin


def slow_h(p, codes):
    best = [0] * p.length
    row = [0] * p.length
    for j, c in enumerate(codes):
        new = []
        for i in range(p.length):
            v = int(p.match[i, c]) + (row[i - 1] if j and i else 0)
            new.append(v if j == 0 else max(0, v))
        row = new
        best = [max(b, v) for b, v in zip(best, row, strict=True)]
    return sum(best)


def test_h_scores():
    p = random_profile(16)
    seqs = ["", "A", *["".join(RNG.choice(list("ACGTN"), RNG.integers(1, 50))) for _ in range(40)], ""]
    codes = [p.encode(s) for s in seqs]
    starts = np.r_[0, np.cumsum([len(c) for c in codes])]
    assert K.h_scores(p, np.concatenate(codes), starts).tolist() == [slow_h(p, c) for c in codes]


def test_sampling_and_mutation():
    p = K.linear(np.array([[-9] + [200 if a == i % 4 else -200 for a in range(4)] for i in range(12)]), "ACGT", -300, -100)
    s = K.sample(p, np.random.default_rng(1))
    assert s == "ACGT" * 3 and s == K.sample(p, np.random.default_rng(1))
    m = [K.mutate(s, "ACGT", 3, np.random.default_rng(k)) for k in range(200)]
    assert len({len(x) for x in m}) > 3 and np.mean([x == s for x in m]) < 0.2
