"""Matches from left to right in stretches around the ends that reach the cutoff: those of the whole walk."""

import time

import numpy as np
import pytest

from motifloom.operators import inorder
from motifloom.operators import kernels as K

WORD = K.linear(np.array([[-4] + [5 if a == "ABCD".index(c) else -4 for a in range(4)] for c in "ABCD"]), "ABCD", -9, -3)


@pytest.mark.parametrize("limit", [None, 2])
def test_equals_the_whole_walk(monkeypatch, limit):
    rng, several = np.random.default_rng(7), 0
    for piece in (50, 1 << 16):
        monkeypatch.setattr(inorder, "PIECE", piece, raising=False)
        codes = [rng.choice(5, int(n), p=[0.4, 0.15, 0.15, 0.15, 0.15]) for n in rng.integers(0, 700, 6)]
        for cutoff in (11, 16):
            got = inorder.found(WORD, codes, cutoff, limit=limit)
            several += sum(len(x) > 1 for x in inorder._stretches(WORD, codes, cutoff))
            with monkeypatch.context() as m:
                m.setattr(inorder, "reach", lambda *_: None)
                assert inorder.found(WORD, codes, cutoff, limit=limit) == got
    assert several > 0


def test_no_bound():
    assert inorder.reach(WORD, 16) < 100
    free = K.linear(WORD.match, "ABCD", -9, 0)  # inserting costs nothing once begun: a path may live on
    assert inorder.reach(free, 16) is None
    codes = [free.encode("ABXXXXXXXXXXXXXXXXXXXXXXXXXXCDABCD")]
    assert [(m.score, m.end) for m in inorder.found(free, codes, 11)[0]]


def test_long_sequence_in_seconds():
    seq = "X" * 300_000 + "ABCD" + "X" * 300_000 + "ABCD"
    began = time.perf_counter()
    assert [(m.begin, m.end) for m in inorder.found(WORD, [WORD.encode(seq)], 16)[0]] == [(300_001, 300_004), (600_005, 600_008)]
    assert time.perf_counter() - began < 20
