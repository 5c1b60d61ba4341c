"""Codes against plain Lloyd rounds; bounds never change a result."""

import hashlib
import math

import numpy as np
import pytest
from oracle import differences

from motifloom.llm import queries, vectorcodes


def plain(rows, parts, entries, rounds):
    """{vec_id: (code, error, label_error, digest)} with every distance computed."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0], r[1]))
    x = [[[math.floor(4096 * v) for v in r[1]][p * len(r[1]) // parts : (p + 1) * len(r[1]) // parts] for p in range(parts)] for r in kept]
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    near = lambda v, p: min((far(v, c), j) for j, c in enumerate(books[p]))
    for _ in range(rounds):
        of = [[near(v[p], p)[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for j in range(len(books[p])):
                own = [v[p] for v, o in zip(x, of) if o[p] == j]
                if own:
                    books[p][j] = [sum(c) // len(own) for c in zip(*own)]
    ends = [[near(v[p], p) for p in range(parts)] for v in x]
    total = {}
    for r, e in zip(kept, ends):
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in e)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted((r[0], "".join(f"{j:02x}" for _, j in e), sum(d for d, _ in e), total[r[2]], digest) for r, e in zip(kept, ends))


KIND = "vec_id long, embedding array<float>, label int, code string, state string"


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(k), np.float32(rng.normal(size=8) * [0.001, 1, 4][seed]).tolist(), [None, 1, 2][k % 3]) for k in range(180)]
    rows += [(k, [0.5, -0.25] * 4, 1) for k in range(200, 230)] + [(200, [0.5, -0.25] * 4, 1)]
    rows += [(300, None, 1), (301, [0.0, None] * 4, 1), (302, [float("nan")] * 8, 1), (303, [float("inf")] + [0.0] * 7, None)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND).repartition(5)
    for parts, entries in ((4, 5), (2, 16), (8, 1)):
        got = sorted(tuple(r) for r in vectorcodes.compress(df, parts=parts, entries=entries, rounds=4).collect())
        assert got == plain(rows, parts, entries, 4)


def test_other_vectors(spark):
    """Fewer vectors than entries; other lengths and too large components are passed through without a code."""
    rows = [(1, [1.0] * 8, 1), (2, [2.0] * 8, None), (3, [1.0] * 5, 1), (4, [40000.0] * 8, 1), (5, [], 1), (None, [2.0] * 8, 3)]
    got = {r.vec_id: r for r in vectorcodes.compress(spark.createDataFrame([(*r, "", "") for r in rows], KIND)).collect()}
    assert got[1].code == "00" * 8 and got[2].code == got[None].code == "01" * 8 and got[1].error == 0
    assert all(got[k].code is None and got[k].error is None for k in (3, 4, 5)) and len(got) == 6
    assert vectorcodes.compress(spark.createDataFrame([], KIND)).count() == 0


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 30, size=(500, 4)) for c in range(0, 8000, 500)]).astype(np.int64)
    book = x[::500].copy()
    of = vectorcodes.grouped(book)
    state, counts = vectorcodes.Bounds.none(len(x), int(of.max()) + 1), []
    for _ in range(5):
        counts.append(state.reassign(x, book, of))
        want = ((x[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (state.entry == want).all()
        after = np.array([x[want == j].sum(axis=0) // max(1, (want == j).sum()) for j in range(len(book))])
        state.drift(np.sqrt(((after - book) ** 2).sum(axis=1)), of)
        book = after
    assert counts[-1] < counts[0] / 4


def test_sql(spark):
    a, b, here, there = differences(spark, "/root/testdata/sf0.001", queries.op13_vectorcodes, vectorcodes.SQL)
    assert a == b and not here and not there
