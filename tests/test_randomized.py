from collections import Counter

import pytest

from motifloom.operators import generate

ROWS = [("a", "ACDEFGHIKLMNPQRSTVWYACDEFGHIKLMNPQRSTVWYAC"), ("b", "AC"), ("c", ""), ("d", None), ("e", "AAAAAAAAAA")]


def test_methods(spark):
    df = spark.createDataFrame(ROWS, "seq_id string, sequence string")
    before = dict(ROWS)
    for method in generate.METHODS:
        got = generate.randomized(df, method, 3, width=5, rate=0.4).collect()
        again = generate.randomized(df.repartition(3), method, 3, width=5, rate=0.4).collect()
        new = {r.seq_id: r.sequence for r in got}
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str) and new["c"] == "" and new["d"] is None
        a, old = new["a"], before["a"]
        if method in ("permutation", "window", "codon", "bubble", "spoil", "reverse"):
            assert Counter(a) == Counter(old) and a != old
        if method == "rubble":
            blocks = lambda s: sorted(s[i : i + 5] for i in range(0, 40, 5))
            assert len(a) == 40 and blocks(a) == blocks(old)
        if method == "comb":
            assert all((x.islower() and x.upper() != y) if i % 5 == 0 else x == y for i, (x, y) in enumerate(zip(a, old))) and new["e"] == before["e"]
        if method == "sample":
            r = next(r for r in got if r.seq_id == "a")
            assert old[r.begin - 1 : r.end] == a and len(a) == 5 and new["b"] == "AC"
        if method in ("scramble", "corrupt"):
            assert len(a) == len(old) and set(a) <= set(old) and a != old
    with pytest.raises(ValueError):
        generate.randomized(df, "other")


def test_copies_and_frequencies(spark):
    df = spark.createDataFrame(ROWS, "seq_id string, sequence string")
    got = generate.randomized(df, "scramble", copies=3, frequencies={"X": 1.0, "Y": 0.0}).collect()
    assert {(r.seq_id, r.copy) for r in got} == {(k, c) for k, _ in ROWS for c in (1, 2, 3)}
    assert all(r.sequence is None or set(r.sequence) <= {"X"} for r in got)
    assert len({r.sequence for r in generate.randomized(df.where("seq_id = 'a'"), "permutation", copies=4).collect()}) == 4
