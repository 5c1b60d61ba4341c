"""The prefilter score by diagonals: that of the kernel, on odd rows as well, and its plan."""

import numpy as np
from pyspark.sql import functions as F

from motifloom.operators import kernels as K
from motifloom.operators import search


def test_equals_the_kernel(spark):
    rng = np.random.default_rng(2)
    texts = ["", None, "A", "é", "D", "ABCDéABCD", *("".join(rng.choice(list("ABCDx"), int(n))) for n in rng.integers(0, 60, 60))]
    lib = spark.createDataFrame([(k // 2, s, None if k % 3 else "u") for k, s in enumerate(texts)] + [(None, "ABCD", "u")] * 2, "k int, sequence string, other string").repartition(3)
    for size in (1, 2, 7, 40):
        p = K.linear(np.c_[np.full(size, -3), rng.integers(-6, 6, (size, 4))], "ABCD")
        want = sorted(map(str, search.with_h_score(lib, p).select("k", "other", "h_score").collect()))
        assert sorted(map(str, search.with_folded_h_score(lib, p).collect())) == want


def test_no_fold_over_arrays(spark, tmp_path):
    from motifloom.plans import catalog

    spark.createDataFrame([(1, "Some text"), (1, "Some text"), (None, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.h_score_folded(spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Python" not in plan and "Arrow" not in plan
    assert df.count() == 3 and df.where(F.col("doc_id").isNull()).first().h_score == 0
