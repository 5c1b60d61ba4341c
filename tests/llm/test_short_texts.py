import numpy as np

from motifloom.llm import decontaminate as dc
from test_decontaminate import sh, ws


def slow(docs, items):
    out = {}
    for d, t in docs:
        w = ws(t)
        for i, x in items:
            v = ws(x)
            best = max(((dc.similarity(sh(w[b : b + len(v)]), sh(v)), -b) for b in range(max(1, len(w) - len(v) + 1))), default=(0, 0)) if v else (0, 0)
            if best[0] >= 0.8:
                out[d, i] = (round(best[0], 9), -best[1], min(len(w), len(v)))
    return out


def test_texts_shorter_than_an_item(spark):
    rng = np.random.default_rng(6)
    say = lambda n: [f"w{i}" for i in rng.integers(0, 40, n)]
    items = [(i, say(n)) for i, n in enumerate([3, 5, 6, 12, 30, 60, 100])]
    docs = [(100, items[6][1][:99])]
    for d in range(100):
        w = list(items[d % 7][1])
        for _ in range(d % 4):
            w[rng.integers(len(w))] = "z"
        cut = int(rng.integers(0, len(w) // 4 + 1))
        docs.append((d, w[cut:] if d % 2 else w[: len(w) - cut]))
    docs, items = [[(k, " ".join(w)) for k, w in rows] for rows in (docs, items)]
    want = slow(docs, items)
    assert want[100, 6] == (round(95 / 96, 9), 0, 99) and sum(n < len(ws(dict(items)[i])) for (_, i), (*_, n) in want.items()) > 5
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word, r.n_words) for r in dc.contaminations(a, b).collect()}
    assert got == want
    assert {r.doc_id for r in dc.keep_clean(a, b).collect()} == {d for d, _ in docs} - {d for d, _ in want}
