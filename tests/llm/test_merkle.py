"""The manifest against a plain tree, and its traversal's memory."""

import hashlib
import zlib

import pytest
from oracle import differences

from motifloom.llm import merkle, queries

H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()


def value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(leaves):
    """(root, path of each leaf) level by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 3 * 3 : p // 3 * 3 + 3]
            paths[k].append((run[: p % 3], run[p % 3 + 1 :]))
            at[k] = p // 3
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, H(*(value(r[i]) for i in (0, 2, 3, 4, 1))), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    made = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, above = tree([made[s][0] for s in order])
    out = []
    for s, up in zip(order, above):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), made[s][1]):
            r = x[3]
            text = r[1]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            seen = H(value(r[0]), value(r[2]), value(r[3]), value(r[4]), value(text))
            for left, right in [*path, *up]:
                seen = H(*left, seen, *right)
            proof = H(*("".join(a) + "".join(b) for a, b in [*path, *up]))
            out.append((r[0], x[2], made[s][0], root, proof, seen, seen == root))
    return sorted(out, key=str)


KIND = "doc_id long, text string, source string, lang string, n_chars int, node string, path string"


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_against_plain(spark, depth):
    rows = [(k, f"line {k}\nnext é" * (k % 3), ["a", "b", None, "é", "c"][k % 5] if k % 2 else "a", "en", k) for k in range(70)]
    rows += [(5, None, "a", None, None), (5, None, "a", None, None), (None, "x\ny", "a", "de", 3), (None, "", None, "de", 0), (900, "a" * 300_000 + "\n", "lone", "en", 1)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], KIND)
    got = merkle.tamper_check(docs, depth)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_empty(spark):
    assert merkle.tamper_check(spark.createDataFrame([], KIND)).count() == 0


def test_one_row(spark):
    r = merkle.tamper_check(spark.createDataFrame([(1, "a", "s", "en", 1, "", "")], KIND)).first()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == H() and r.verified


@pytest.mark.parametrize("size", [1, 2, 3, 4, 8, 9, 10, 26, 81, 100, 242])
def test_traversal(size):
    leaves = [H(str(k)) for k in range(size)]
    root, paths = tree(leaves)
    depth = merkle._depth(size, size)
    walk = merkle.Traversal(leaves, depth)
    assert walk.top() == root
    for path, want in zip(walk.paths(), paths, strict=True):
        assert path == [("".join(a), "".join(b)) for a, b in want]
        kept = sum(len(r.nodes) + sum(len(t.stack) for t in r.todo) for r in walk.next) + sum(map(len, walk.now))
        assert kept <= 9 * depth


def test_a_block_that_is_not_full(spark):
    """In a tree of several blocks the last one has whole height."""
    leaves = [H(str(k)) for k in range(730)]
    walk = merkle.Traversal(leaves[729:], merkle._depth(730, 1))
    node = leaves[729]
    for _ in range(6):
        node = H(node)
    assert walk.top() == node and next(walk.paths()) == [("", "")] * 6


def test_sql(spark):
    a, b, here, there = differences(spark, "/root/testdata/sf0.001", queries.op11_merkle, merkle.SQL)
    assert a == b and not here and not there
