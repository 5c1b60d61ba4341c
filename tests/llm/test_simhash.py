import itertools

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import simhash
from motifloom.llm.components import components


def slow_fingerprint(text):
    import re

    ws = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 4]) for i in range(len(ws) - 3)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_groups(rows):
    fps = [(i, slow_fingerprint(t)) for i, t in rows]
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {(i, f"{f:016x}", find(i)) for i, f in fps}


@given(st.text(alphabet="aAbÉ \t\n \u0085\x1c", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def corpus():
    rng = np.random.default_rng(1)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocab, 200)) for _ in range(12)]
    rows = []
    for i in range(90):
        ws = base[i % 12].split()
        for _ in range(i % 5):
            ws[rng.integers(len(ws))] = "x"
        rows.append((i, " ".join(ws)))
    return rows + [(90, None), (91, ""), (92, " \n"), (93, "One two"), (94, "one TWO"), (95, "wörter " * 9000)]


def test_groups_equal_brute_force(spark):
    rows = corpus()
    got = simhash.near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")).collect()
    assert {tuple(r) for r in got} == slow_groups(rows) and len(got) == len(rows)


@pytest.mark.parametrize("block", [2, 6, 8192])
def test_links_in_blocks(spark, block):
    rng = np.random.default_rng(2)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.int64)
    fps = {int(c) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 5))) for c in centre for _ in range(60)}
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), block=block)
    got = {r.node: r.root for r in components(links).collect()}
    root = {f: f for f in fps}
    for _ in fps:
        for a, b in itertools.combinations(fps, 2):
            if (a ^ b).bit_count() <= 4:
                root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(f, f) == r for f, r in root.items())


def test_signatures_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a
        for bit in rng.choice(64, 5, replace=False):
            b ^= 1 << int(bit)
        s = simhash.signatures(np.array([a, b], np.uint64).view(np.int64))
        assert (s[0] == s[1]).any()


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(7, "a b"), (7, "a b"), (None, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(twice).collect()) == [(0, 7), (7, 7), (7, 7)]


def test_one_row_kept_by_a_defined_order(spark):
    rows = [(1, "a b c d e", "y", 9), (1, "a b c d e", "x", 9), (1, "a b c d e f", "z", 1), (2, "a b c d e", "w", 0), (None, "a b c d e", "n", 3), (5, None, "q", 4), (6, "", "q", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _least_id string, _row_no int")
    got = [sorted(map(str, simhash.keep_one(d).collect())) for d in (df, df.repartition(3), df.orderBy("_least_id"))]
    assert got[0] == got[1] == got[2]
    kept = simhash.keep_one(df).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(1, "a b c d e"), (None, "a b c d e"), (5, None)} and len(kept) == 3
    assert simhash.keep_one(df).columns == df.columns and simhash.keep_one(df.where("false")).count() == 0
