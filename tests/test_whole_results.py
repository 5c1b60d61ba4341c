import numpy as np

from motifloom.operators import kernels as K
from motifloom.plans import catalog


def test_all_matches_of_a_document(spark, tmp_path):
    p = catalog.profile()
    best = [catalog._AZ[i] for i in p.match[:, 1:27].argmax(axis=1)]
    rng = np.random.default_rng(1)
    while True:
        weak = list(best)
        for at in rng.choice(16, 4, replace=False):
            weak[at] = catalog._AZ[int(rng.integers(26))]
        codes = p.encode("".join(weak) * 20)
        if 34 <= K.scores(p, [codes])[0] <= 38 and K.h_scores(p, codes, np.array([0, len(codes)]))[0] >= catalog.H_CUTOFF:
            break
    docs = [(1, "".join(best) * 20), (2, "".join(weak) * 20)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r for r in catalog.search_align(spark, str(tmp_path)).collect() if r.motif_ac == "RULE16"]
    assert sum(r.doc_id == 1 for r in got) == 20
    assert sum(r.doc_id == 2 for r in got) > 0
