import pytest

import corpus_pipeline
from motifloom.llm import decontaminate, mixing, pii, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, labels)
    toxic = {d for d, r in plain.items() if model is not None and max([toxicity.Model.probability(model, model.margins(list(set().union(*map(toxicity.forms, toxicity.raw_words(r.text)))))).max()], default=0) >= 0.5}
    state = {d: r.text for d, r in plain.items() if d not in toxic}
    # near-duplicates, every pair
    fp = {d: simhash.fingerprint(t) for d, t in state.items()}
    root = {d: d for d in fp}
    ids = sorted(fp)
    for _ in range(5):
        for a in ids:
            for b in ids:
                if (fp[a] ^ fp[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    state = {d: t for d, t in state.items() if root[d] == d}
    items = [(r.item_id, r.text) for r in bench.collect()]
    from test_decontaminate import slow

    bad = {d for d, _ in slow(list(state.items()), items)}
    state = {d: t for d, t in state.items() if d not in bad}

    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
    rows = {r.doc_id: r for r in now.collect()}
    assert {d: r.text for d, r in rows.items()} == state
    weights = pii.train(now)
    masked = {r.doc_id: r.text for r in pii.redact(now, weights).collect()}
    assert masked.keys() == state.keys() and not any(sum(map(len, pii.base_spans(t))) for t in masked.values())
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r["size"] for r in got} == {d: len(t.encode().split()) for d, t in masked.items()}
    want = 1.5 * sum(r["size"] for r in got)
    assert sum(r.taken for r in got) == pytest.approx(want, abs=30) and all(r.taken <= 2 * r["size"] for r in got)


@pytest.mark.parametrize("k", range(5))
def test_stage_on_odd_rows(spark, k):
    kind = "doc_id long, text string, lang string, source string, n_chars long, held_out int, _first int, x string"
    odd = spark.createDataFrame([(1, None, None, None, None, 1, 2, "a"), (2, "", "en", "s", 0, 1, 2, "b"), (3, "a b c d", "en", "s", 7, 1, 2, "c"), (3, "a b c d", "en", "s", 7, 1, 2, "c")], kind)
    for docs, n in ((odd, (2, 3, 4)), (odd.where("false"), (0,))):
        assert corpus_pipeline.STAGES[k][1](spark, docs, SF).count() in n
