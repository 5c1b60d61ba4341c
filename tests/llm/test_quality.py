import math
import zlib

import numpy as np
import pyarrow as pa

from motifloom.llm import quality as q
from motifloom.llm.common import text_bytes


def test_content_view_equals_plain_counts():
    texts = ["a b c d e f g h " * 3, "One TWO two two!! 12", "", None, "ab cd ef gh ij kl mn op", "x y z w v u t s r x y z w v u t s q"]
    got = q.content_view(*text_bytes(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        w = (t or "").lower().split()
        n = max(1, len(w))
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        cover = {k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(i, i + 8)}
        assert np.isclose(row[5], len(cover) / n) and np.isclose(row[3], 1 - len(set(w)) / n if w else 0)
        assert np.isclose(row[4], sum(a == b for a, b in zip(w, w[1:])) / n)


def corpus(spark, n=800):
    rng = np.random.default_rng(3)
    vocab = [f"word{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(n):
        ws = list(rng.choice(vocab, int(rng.integers(10, 90))))
        bad = i % 5 == 0
        if bad:
            ws = [w.upper() + "!!" for w in ws] if i % 2 else [w for w in ws for _ in range(4)]
        rows.append((i, " ".join(ws), "en", "junk" if bad and i % 3 else f"s{i % 4}", 1))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    rows += [(9000, None, None, None, None), (9001, "", "en", None, 0), (9002, "a b " * 40_000, "en", "s1", 1), (9002, "a b " * 40_000, "en", "s1", 1), (None, "hm", None, "s1", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), n


def test_held_out(spark):
    docs, labels, n = corpus(spark)
    rows = q.quality(docs, labels).collect()
    assert len(rows) == n + 5
    held = [(r.keep, r.doc_id % 5 != 0) for r in rows if r.doc_id is not None and r.doc_id < n and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 and 0 <= r.p_text <= 1 and 0 <= r.p_page <= 1 for r in rows)


def test_no_labels(spark):
    docs, labels, _ = corpus(spark, 10)
    assert all(r.keep for r in q.quality(docs, labels.where("false")).collect())
    assert q.quality(docs.where("false"), labels).count() == 0


def test_word_features():
    texts = ["the cat the dog", "", "zebra"]
    got = q.content_view(*text_bytes(pa.array(texts)))[:, q.COUNTS :]
    assert got.shape == (3, q.WORDS) and not got[1].any() and got[2].max() == 1 and np.isclose((got[0] ** 2).sum(), 1)
    assert np.isclose(got[0].max(), math.sqrt(0.5))


def test_words_are_learnt(spark):
    """Bad documents differ by some of their words only, the page says nothing."""
    rng = np.random.default_rng(8)
    good, bad = [f"fine{i}" for i in range(40)], [f"poor{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(600):
        ws = list(rng.choice(good, 20)) + (list(rng.choice(bad, 8)) if i % 3 == 0 else list(rng.choice(good, 8)))
        rows.append((i, " ".join(ws), "en", "s"))
        if i < 400:
            labels.append((i, int(i % 3 != 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.keep for r in q.quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert np.mean([got[i] == (i % 3 != 0) for i in range(400, 600)]) > 0.9


def plain_pool(x):
    """Every row scored, the surest of each label sorted out on one machine."""

    def pool(models, taken, most):
        out = []
        for pupil in (0, 1):
            p = models[1 - pupil].probability(x[1 - pupil])
            rows = []
            for label, sure in ((0, 1 - p), (1, p)):
                fit = [k for k in range(len(p)) if sure[k] >= q.SURE and k not in taken[pupil]]
                rows += [(k, label) for k in sorted(fit, key=lambda k: (-sure[k], k))[: most[label]]]
            rows.sort()
            out.append(([k for k, _ in rows], x[pupil][[k for k, _ in rows]].reshape(len(rows), x[pupil].shape[1]), np.array([v for _, v in rows])))
        return out

    return pool


def test_co_training_equals_a_plain_loop(spark, monkeypatch):
    """The rows passed in each round, and so the model, are those of a loop over all rows."""
    rng = np.random.default_rng(6)
    monkeypatch.setattr(q, "PASSED", 15)
    y = rng.integers(0, 2, 120)
    make = lambda y: np.c_[rng.normal(y[:, None] * 0.8, 1, (len(y), q._WIDTH)), rng.normal(y[:, None] * 0.6, 1, (len(y), q._ALL - q._WIDTH))].astype(np.float32)
    mine, other = make(y), make(rng.integers(0, 2, 500))
    split = lambda x: (x[:, : q._WIDTH].astype(float), x[:, q._WIDTH :].astype(float))
    table = spark.createDataFrame([(k, bytearray(r.tobytes())) for k, r in enumerate(other)], "uid long, x binary").repartition(5)
    seen = []

    def watched(inner):
        def pool(models, taken, most):
            out = inner(models, taken, most)
            seen.append([sorted(zip(rows, label.tolist())) for rows, _, label in out])
            return out

        return pool

    a = q.fit(split(mine), y, watched(q.unlabelled(table)), 3)
    b = q.fit(split(mine), y, watched(plain_pool(split(other))), 3)
    assert seen[:3] == seen[3:] and all(len(s[0]) > 10 and len(s[1]) > 10 for s in seen[:2])
    assert not set(seen[0][0]) & set(seen[1][0])
    for m, n in zip((*a.views, *a.calibrated, a.combined), (*b.views, *b.calibrated, b.combined), strict=True):
        assert np.allclose(m.weight, n.weight, atol=1e-6)
