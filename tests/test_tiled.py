"""Tiles give the scores of the whole, in memory that doesn't grow with the sequence."""

import subprocess
import sys

import numpy as np
import pytest

from motifloom.operators import kernels as K
from motifloom.operators import tiled


def profile(rng, kind):
    size = int(rng.integers(1, 7))
    p = K.linear(rng.integers(-4, 5, (size, 4)), "ABC", int(rng.integers(-9, -1)), int(rng.integers(-3, 0)))
    if kind:
        insert = rng.integers(-3, 1, (size + 1, 4))
        insert[rng.random(insert.shape) < 0.2 * (kind - 1)] = K.NEG
        trans = {**p.trans, "id": rng.integers(-5, 0, size + 1), "di": rng.integers(-5, 0, size + 1)}
        border = {k: rng.integers(-4, 1, size + 1) for k in ("b0", "b1", "e0", "e1", "bd", "de", "bi", "ie")}
        p = K.Profile("ABC", p.match, insert, p.delete, trans, border)
    return p


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_equal_the_whole(kind):
    rng = np.random.default_rng(kind)
    for _ in range(60):
        p = profile(rng, kind)
        codes = rng.integers(0, 4, int(rng.integers(1, 70)))
        first, last = rng.random(2) < 0.5
        score, end = K.best_ends(p, [codes], None, np.array([first]), np.array([last]))
        for tile in (1, 3, 16, 100):
            got = tiled.best_end(p, codes, bool(first), bool(last), None, tile)
            assert got[0] == score[0] and (got[1] == end[0] or score[0] == K.NEG)
        if score[0] > K.NEG:
            assert score[0] >= tiled.best_end(p, codes, bool(first), bool(last), int(score[0]) - 1, 5)[0] >= score[0] - 1


def test_memory_does_not_grow():
    """20 million letters in a process of its own."""
    code = """
import resource, numpy as np
from motifloom.operators import kernels as K
rng = np.random.default_rng(1)
p = K.linear(rng.integers(-4, 5, (16, 5)), "ACGT", -9, -3)
codes = rng.integers(1, 5, 20_000_000).astype(np.uint8)
K.scores(p, [codes[:1_000_000]])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert K.scores(p, [codes])[0] > 30
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert float(out.stdout) < 80
