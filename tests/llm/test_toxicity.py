import itertools
import zlib

import numpy as np

from motifloom.llm import toxicity as tx


def slow_kernel(s, t):
    out = 0.0
    for a in itertools.combinations(range(len(s)), 3):
        for b in itertools.combinations(range(len(t)), 3):
            if all(s[i] == t[j] for i, j in zip(a, b, strict=True)):
                out += tx.LAMBDA ** (a[-1] - a[0] + b[-1] - b[0] + 2)
    return out


def test_kernel_equals_definition():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcé"), rng.integers(1, 9))) for _ in range(30)]
    got = tx.Kernel()(words, words[:7])
    for i, s in enumerate(words):
        for j, t in enumerate(words[:7]):
            a, b = f"^{s}$", f"^{t}$"
            assert abs(got[i, j] - slow_kernel(a, b) / (slow_kernel(a, a) * slow_kernel(b, b)) ** 0.5) < 1e-5


def test_folded_weights_equal_the_kernel():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 15))) for _ in range(200)]
    a = rng.normal(size=9)
    assert np.abs(tx.Weights(words[:9], a)(words)[:, 0] - tx.Kernel()(words, words[:9]) @ a).max() < 1e-4


def corpus(n=900):
    rng = np.random.default_rng(1)
    syllables = ["ka", "lo", "mi", "ter", "un", "es", "ra", "do", "pin", "vel"]
    vocab = ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(400)]
    insults = ["blockhead", "wretch", "vermin"]
    rows = []
    for i in range(n):
        ws = list(rng.choice(vocab, int(rng.integers(5, 80))))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                ws.insert(int(rng.integers(len(ws) + 1)), insults[int(rng.integers(3))])
        rows.append((i, " ".join(ws), int(toxic)))
    return rows


def test_held_out_and_hidden_words(spark):
    rows = corpus()
    hidden = ["so much for the bloc-khead", "you w.r.e.t.c.h", "such verrmin", "a b l o c k h e a d today"]
    docs = [(i, t, "en") for i, t, _ in rows] + [(5000 + k, t, None) for k, t in enumerate(hidden)] + [(6000, None, None), (6001, "", None), (6002, "lo " * 20000, None), (6002, "lo " * 20000, None), (None, "kalo", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 10] + [(7, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in tx.toxicity(d, labels).collect()}
    assert len(got) == len(docs) - 1
    held = [(got[i].predicted, t) for i, _, t in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p == t for p, t in held]) > 0.98
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert all(got[5000 + k].predicted == 1 for k in range(len(hidden))), [got[5000 + k].score for k in range(len(hidden))]
    assert all(got[i].predicted == 0 and 0 <= got[i].score <= 1 for i in (6000, 6001, 6002, None)), [got[i] for i in (6000, 6001, 6002, None)]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a bad word")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in tx.toxicity(d, none).collect()] == [0.0]
    assert tx.toxicity(d.where("false"), none).count() == 0


def test_figures_of_the_readme():
    """Held-out labels of sf0.1, and disguises of ten learned insults at ten random places each."""
    import duckdb

    path = "/root/testdata/sf0.1"
    rows = duckdb.execute(f"SELECT doc_id, text, toxic FROM '{path}/documents.parquet' JOIN '{path}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    ids = {}
    bags = tx.bag_ids([t for i, t, _ in rows if not held(i)], ids)
    model = tx.fit(bags, np.array([y for i, _, y in rows if not held(i)]), ids)
    toxic = lambda texts: model.probability(tx._margins(model, texts)) >= 0.5
    got, want = toxic([t for i, t, _ in rows if held(i)]), np.array([y for i, _, y in rows if held(i)]) == 1
    assert (got & want).sum() >= 0.9 * want.sum() and (got & want).sum() >= 0.88 * got.sum()
    rng = np.random.default_rng(9)
    letter = lambda: "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))]
    words = "trash pathetic worthless idiot loser disgusting scum clown moron stupid".split()
    share = lambda hide: np.mean(toxic([hide(w, int(rng.integers(len(w)))) for w in words for _ in range(10)]))
    assert share(lambda w, i: w[: i + 1] + letter() + w[i + 1 :]) >= 0.8
    assert share(lambda w, i: w[:i] + w[i] + w[i:]) >= 0.9
    assert share(lambda w, i: w[:i] + w[i + 1 : i + 2] + w[i] + w[i + 2 :]) >= 0.75
    assert share(lambda w, i: w[:i] + w[i + 1 :]) >= 0.55
    assert share(lambda w, i: "x".join(w)) >= 0.9 and share(lambda w, i: ".".join(w)) >= 0.9
    assert share(lambda w, i: w.translate(str.maketrans("oieas", "01345"))) >= 0.9
