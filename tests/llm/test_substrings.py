"""Repeated strings against a count of all strings; induced sorting against sorted suffixes."""

import hashlib
from collections import Counter

import numpy as np
import oracle
import pytest

from motifloom.llm import inducing, queries, substrings


def plain(texts, size):
    """(bytes, removed, runs, digest of the rest) of each text."""
    raws = [(t or "").encode() for t in texts]
    count = Counter(r[i : i + size] for r in raws for i in range(len(r) - size + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - size + 1):
            if count[r[i : i + size]] > 1:
                gone[i : i + size] = True
        edge = np.diff(np.r_[0, gone.astype(int)])
        out.append((len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(r, gone) if not g)).hexdigest()))
    return out


KIND = "doc_id long, text string, bytes string, gram string, uid string"


def made(rng, size):
    word = lambda: "".join(rng.choice(list("abcé \n"), size=int(rng.integers(1, 9))))
    base = ["".join(word() for _ in range(int(rng.integers(1, 60)))) for _ in range(30)]
    texts = [*base, base[0], base[0], None, "", "x" * (3 * size), "ab" * (2 * size), "y" * size, "z" * size, "z" * size]
    for _ in range(25):  # pieces of others, changed here and there
        a, b = base[rng.integers(30)], base[rng.integers(30)]
        t = list(word() + a[: rng.integers(len(a) + 1)] + b[rng.integers(len(b) + 1) :] + word())
        if t and rng.random() < 0.5:
            t[rng.integers(len(t))] = "#"
        texts.append("".join(t))
    return texts


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("more", [{}, {"shard": 2000, "memory": 50}, {"hot": 1}])
def test_against_plain(spark, seed, more):
    rng, size = np.random.default_rng(seed), [20, 31, 64][seed]
    texts = made(rng, size)
    df = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], KIND).repartition(3)
    got = substrings.deduplicated(df, size=size, gram=[5, 8, 48][seed], with_text=True, **more).collect()
    by = {r.doc_id: r for r in got}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in (by[k] for k in range(len(texts)))] == plain(texts, size)
    assert len(got) == len(texts) and sum(r.n_removed > 0 for r in got) > 10 and by[2].n_bytes >= len(by[2].kept.encode("utf-8", "ignore")) - 9


def test_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "q" + "abcdefgh" * 60, "", "", "")] * 3 + [(None, "short", "", "", "")], KIND)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in substrings.deduplicated(df).collect())
    assert got == [(0, 5, 0, 0)] + [(1, 481, 481, 1)] * 3
    assert substrings.deduplicated(spark.createDataFrame([], KIND)).count() == 0


def test_whole_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in queries.op12_substrings(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert got == dict(zip([r.doc_id for r in docs], plain([r.text for r in docs], 400), strict=True))


@pytest.mark.parametrize("memory", [1 << 20, 40, 7])
def test_induced_order(memory):
    rng = np.random.default_rng(memory)
    for letters in (1, 2, 4, 200):
        text = rng.integers(1, letters + 1, size=150).astype(np.uint8)
        text = np.concatenate([text, text[30:90], text[:40]])
        want = sorted(range(len(text)), key=lambda i: bytes(text[i:]))
        assert inducing.order(text.astype(np.int64), len(text), memory).tolist() == want
        for size in (3, 9, 40):
            count = Counter(bytes(text[i : i + size]) for i in range(len(text) - size + 1))
            got = inducing.repeated(text, size, memory)[: len(text) - size + 1]
            assert got.tolist() == [count[bytes(text[i : i + size])] > 1 for i in range(len(text) - size + 1)]


def test_queue_spills():
    rng, q, seen = np.random.default_rng(1), inducing.Queue(20), []
    for k in range(40):
        q.push(rng.integers(5, size=7), inducing._items(np.arange(7) + 7 * k, np.zeros(7, np.int32)))
    assert q.runs and q.held <= 20
    while (key := q.peek()) is not None:
        seen += [(key, int(p)) for p in q.pop()["pos"]]
    assert seen == sorted(seen) and len(seen) == 280


def test_long_run_of_one_letter(spark):
    df = spark.createDataFrame([(1, "a" * 200_000, "", "", ""), (2, "b" * 399, "", "", "")], KIND)
    assert [(r.doc_id, r.n_removed) for r in substrings.deduplicated(df).orderBy("doc_id").collect()] == [(1, 200_000), (2, 0)]


def test_sql(spark):
    a, b, here, there = oracle.differences(spark, "/root/testdata/sf0.001", queries.op12_substrings, substrings.SQL)
    assert a == b and not here and not there
