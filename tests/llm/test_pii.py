import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for kind, p in PATTERNS.items():
        own = []
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            own.append(m.span())
        out.append(own)
    return out


@given(st.text(alphabet="1234567890.@+-() aé_\n", max_size=60))
@settings(max_examples=600, deadline=None)
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == slow(text)


@pytest.mark.parametrize("text", ["4539578763621486 and 4539 5787-6362 1486", "a@b@c.d-e.f.x@", "1.2.3.4.5.6.7.8.9", "300.1.1.1 1.1.1.1", "+1 (988) 555-2485.", "é x.y@z.com", "٣.1.2.3.4"])
def test_base_cases(text):
    assert pii.base_spans(text) == slow(text)


def test_digit_runs_are_linear():
    pii.base_spans("1" * 200_000 + "@" + "a" * 200_000 + "." * 1000)


def docs(spark):
    rows = []
    for i in range(300):
        n = f"({200 + i}) 555-{1000 + i}"
        rows.append((i, f"call +1 {n} or write ab{i}.x{i}@mail.example.com from 10.0.{i % 250}.7 now v2.0 of 1991"))
    rows += [(900, "ring +1 (415) 555-1234 today. In words later on we say again: (415) 555-1234 please"), (901, None), (902, ""), (903, "plain words only, 2 of 3"), (904, "no number 12345 in 1999, nor key=9f8e7d6c5b4a"), (905, "x " * 50_000 + "7 " * 20_000), (905, "a")]
    return spark.createDataFrame([(i, t, "s", 0) for i, t in rows], "doc_id long, text string, spans string, n_chars long")


def test_find(spark):
    df = docs(spark)
    weights = pii.train(df.where("doc_id < 300 OR doc_id IN (903, 904)"))
    got = {r.doc_id: r for r in pii.find(df, weights).collect()}
    assert len(got) == 306 and pii.find(df).count() == 307
    for r in df.where("doc_id < 905").collect():
        base = slow(r.text or "")
        assert [got[r.doc_id][f"n_{k}"] for k in pii.KINDS] == [len(x) for x in base]
        told = ",".join(f"{k}:{a}:{b}" for k, own in zip(pii.KINDS, base) for a, b in own)
        assert got[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(filter(None, told.split(","))) <= set(got[r.doc_id].spans.split(","))
    text = df.where("doc_id = 900").first().text
    found = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[900].spans.split(",")) if k == "phone"]
    assert found == ["+1 (415) 555-1234", "(415) 555-1234"]
    assert all(got[i].spans == "" for i in (901, 902, 903, 904))


def test_redact(spark):
    df = docs(spark)
    out = {r.doc_id: r for r in pii.redact(df, pii.train(df.where("doc_id < 300 OR doc_id IN (903, 904)"))).where("doc_id < 905").collect()}
    assert out[900].text == "ring <PHONE> today. In words later on we say again: <PHONE> please"
    assert out[901].text is None and out[903].text == "plain words only, 2 of 3" and out[903].n_chars == len(out[903].text)
    assert pii.redact(df.where("false")).count() == 0 and pii.find(df.where("false")).count() == 0


def test_messages_agree_with_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    g = pii.Graph()
    g.rows, g.chain, g.skip = [0] * 4, [(0, 1), (1, 2)], [(2, 3)]
    g.features = rng.normal(size=(4, pii.FEATURES)).tolist()
    w = {"unary": rng.normal(size=(pii.FEATURES, 5)) / 4, "chain": rng.normal(size=(5, 5)), "skip": rng.normal(size=(5, 5))}
    u, p = np.array(g.features) @ w["unary"], np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=4):
        s = np.exp(sum(u[i, y[i]] for i in range(4)) + sum(w["chain"][y[a], y[b]] for a, b in g.chain) + sum(w["skip"][y[a], y[b]] for a, b in g.skip))
        for i in range(4):
            p[i, y[i]] += s
    assert np.abs(pii.infer(g, w) - p / p.sum(axis=1, keepdims=True)).max() < 1e-4
