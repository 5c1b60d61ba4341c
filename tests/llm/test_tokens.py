import math
import random
import subprocess
import sys

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from motifloom.llm import tokens as tk

PIECES = [bytes([b]) for b in range(256)] + [b"th", b"the", b" the", b"he", b"er", b"ere", b"re", b" th", b"in", b"ing", "é".encode(), "né".encode()]
SCORES = tk.zipf(PIECES)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def slow(word):
    """Best (score, pieces) over all segmentations."""
    word = word.encode()
    best = [(0.0, 0, [])] + [None] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(j):
            s = SCORES.get(word[i:j])
            if s is not None:
                new = (best[i][0] + s, best[i][1] + 1, best[i][2] + [word[i:j]])
                if best[j] is None or new[0] > best[j][0] or new[0] == best[j][0] and new[1] < best[j][1]:
                    best[j] = new
    return best[-1]


@given(st.lists(st.text(alphabet="theringé \n1.", min_size=1, max_size=12), max_size=12))
@settings(max_examples=200, deadline=None)
def test_trie_equals_single_words(words):
    trie = tk.Trie(SCORES)
    for w in words * 2:
        score, n, pieces = slow(w)
        assert trie.add(w) == n and b"".join(pieces) == w.encode()
    assert len(trie.best) <= 1 + sum(len(w.encode()) for w in set(words))


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_pre_tokens_round_trip(text):
    assert "".join(regex.findall(tk.PRE_TOKEN, text)) == text


def test_new_trie(monkeypatch):
    monkeypatch.setattr(tk, "MAX_NODES", 10)
    trie = tk.Trie(SCORES)
    assert trie.add("thering thing") == slow("thering thing")[1]
    trie.fresh()
    assert len(trie.best) == 1 and trie.add("there") == slow("there")[1]


def test_needs_every_byte():
    with pytest.raises(ValueError):
        tk.zipf([b"a"])
    assert math.isclose(sum(math.exp(s) for s in SCORES.values()), 1)


def test_counts(spark):
    df = spark.createDataFrame([(1, "the thing there", 5), (2, None, 5), (3, "", 5), (3, "", 5), (None, "é " * 60_000, 5)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_tokens > 0, r.n_pretokens) for r in tk.count_tokens(df, VOCABULARY).collect())
    assert got == [(0, True, 60_001), (1, True, 3), (2, False, 0), (3, False, 0), (3, False, 0)]
    assert tk.count_tokens(df.where("false"), VOCABULARY).count() == 0


def test_counts_equal_a_plain_count(spark):
    """All documents of sf0.001 that are short enough, by every segmentation's best, piece by piece."""
    pieces = tk.load(VOCABULARY)
    scores = tk.zipf(pieces)
    longest, known = max(map(len, scores)), {}

    def plain(word):
        if word not in known:
            raw = word.encode()
            best = [(0.0, 0)]
            for end in range(1, len(raw) + 1):
                best.append(max((best[k][0] + scores[raw[k:end]], -(-best[k][1] + 1)) for k in range(max(0, end - longest), end) if raw[k:end] in scores))
            known[word] = -best[-1][1]
        return known[word]

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 6000")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = tk.count_tokens(docs, VOCABULARY).collect()
    assert len(got) == docs.count() > 100
    for r in got:
        own = regex.findall(tk.PRE_TOKEN, texts[r.doc_id])
        assert (r.n_tokens, r.n_pretokens) == (sum(map(plain, own)), len(own))


def test_long_pre_tokens_equal_the_trie(monkeypatch):
    rng, pieces = random.Random(5), tk.load(VOCABULARY)
    scores = tk.zipf(pieces)
    for text in ("".join(rng.choices("abcdeghinorstuABC", k=3000)), "a" * 2500, "é" * 900, "thein" * 400):
        monkeypatch.setattr(tk, "LONG", 10**9)
        want = tk.Trie(scores).add(text)
        monkeypatch.setattr(tk, "LONG", 100)
        assert tk.Trie(scores).add(text) == want
    monkeypatch.setattr(tk, "LONG", 5)
    trie = tk.Trie(SCORES)
    assert all(trie.add(w) == slow(w)[1] for w in ("thering", "nérethere", "ingingthe", "ééééé"))


def test_a_blob_needs_little_memory():
    """20 MB of letters without a blank, in a process of its own."""
    code = f"""
import random, resource
from motifloom.llm import tokens as tk
trie = tk.Trie(tk.zipf(tk.load({VOCABULARY!r})))
trie.add("x" * 5000)
blob = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJ", k=1 << 20)) * 20
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert trie.add(blob) > 1 << 22 and len(trie.best) == 1
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, check=True)
    assert float(out.stdout) < 100


def test_long_pre_tokens_in_a_text(spark):
    blob = "Ab" * 4000
    df = spark.createDataFrame([(1, f"{blob} and {blob} the"), (2, blob), (3, "and the")], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.n_pretokens) for r in tk.count_tokens(df, VOCABULARY).collect()}
    small = {r.doc_id: r.n_tokens for r in tk.count_tokens(spark.createDataFrame([(1, " and the"), (2, f" {blob}")], "doc_id long, text string"), VOCABULARY).collect()}
    assert got[1] == (got[2][0] + small[1] + small[2], 4) and got[3][1] == 2
