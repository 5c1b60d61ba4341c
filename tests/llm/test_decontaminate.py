import re
from collections import Counter

import numpy as np

from motifloom.llm import decontaminate as dc


def ws(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def sh(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def slow(docs, items):
    out = {}
    for d, t in docs:
        w = ws(t)
        for i, x in items:
            v = ws(x)
            best = max(((dc.similarity(sh(w[b : b + len(v)]), sh(v)), -b) for b in range(len(w) - len(v) + 1)), default=(0, 0)) if v else (0, 0)
            if best[0] >= 0.8:
                out[d, i] = (round(best[0], 9), -best[1])
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}é" for i in range(40)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    items = [(i, say(n)) for i, n in enumerate([3, 4, 5, 12, 30, 30, 59, 120])] + [(90, None), (91, ""), (92, "...")]
    docs = []
    for d in range(120):
        text = say(int(rng.integers(0, 150)))
        if d % 2:
            w = items[d % 8][1].split()
            for _ in range(d % 5):
                w[rng.integers(len(w))] = "z"
            text = text + "\n" + " ".join(w).upper() + ", " + say(20)
        docs.append((d, text))
    docs += [(500, None), (501, ""), (502, " ")]
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = slow(docs, items)
    assert len(want) > 15
    for limit in (dc.PASS_BYTES, 200):
        got = dc.contaminations(a, b, pass_bytes=limit).collect()
        assert {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in got} == want


def test_empty(spark):
    a = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contaminations(a.where("false"), b).count() == 0
    assert dc.contaminations(a, b.where("false")).count() == 0
    assert dc.contaminations(a.union(a), b).count() == 2
