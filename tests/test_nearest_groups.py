"""Nearest rows over several groups: whole results, and no table goes through the driver."""

import numpy as np

from motifloom.operators import build


def test_groups_meet_without_broadcast(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("ACé-"), n))
    cands, seqs = [word(70) for _ in range(60)] + ["", None], [word(70) for _ in range(90)] + [None, "A"]
    monkeypatch.setattr(build, "BLOCK", 8)
    monkeypatch.setattr(build, "GROUP", 16, raising=False)
    for name, rows in (("cand", cands), ("seq", seqs)):
        spark.createDataFrame(list(enumerate(rows)), f"{name}_id long, aligned string").write.parquet(f"{tmp_path}/{name}")
    near = build.nearest(spark.read.parquet(f"{tmp_path}/cand"), spark.read.parquet(f"{tmp_path}/seq"))
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    padded = lambda s: (s or "").ljust(70, "\0")
    for r in near.collect():
        d = [sum(p != q for p, q in zip(padded(cands[r.cand_id]), padded(s))) for s in seqs]
        assert r.distance == min(d) and sorted(r.seq_ids) == [i for i, v in enumerate(d) if v == min(d)]
    assert near.count() == len(cands)
    assert near.where("false").count() == 0 and build.nearest(spark.createDataFrame([(1, "A")], "cand_id long, aligned string"), spark.createDataFrame([], "seq_id long, aligned string")).count() == 0
