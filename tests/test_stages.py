"""Counts of a search's stages, order of rules, tags by mode."""

import numpy as np
from pyspark.sql import functions as F

from motifloom.functions import normalize
from motifloom.operators import kernels as K
from motifloom.operators import postprocess, search


def test_counts_of_the_search_itself(spark):
    p = K.linear(np.array([[-4] + [5 if a == "ABC".index(c) else -4 for a in range(3)] for c in "ABC"]), "ABC")
    lib = spark.createDataFrame([("a", "ABC"), ("b", "AB"), ("c", "CCC"), ("d", ""), ("e", None), ("f", "XABCX")], "seq_id string, sequence string").repartition(3)
    motif = search.Motif(p, 15, 9, "M")
    assert tuple(search.stage_counts(lib, motif).first()) == (6, 3, 2)
    assert tuple(search.stage_counts(lib.where("false"), motif).first()) == (0, 0, 0)
    kept, seen = search.observed(lib, motif)
    assert {r.seq_id: (r.h_score, r.score) for r in kept.collect()} == {"a": (30, 15), "f": (30, 15)}
    assert {k: o.get["n"] for k, o in seen.items()} == {"read": 6, "heuristic": 3, "filter": 2}
    for text in ("ABC", "", None, "CABX"):
        own = spark.createDataFrame([(text,)], "sequence string")
        assert own.select(search.folded_h_score(F.col("sequence"), p).alias("h")).first().h == search.with_h_score(own, p).first().h_score


def test_rules_by_rank(spark):
    """B rises by A, then C by B: only if the rule of the motif of greater rank comes first does C see B risen."""
    rows = [("s", "A", 1, 5, 9.0, 0, "#"), ("s", "B", 6, 9, 5.0, -1, "#"), ("s", "C", 10, 12, 5.0, -1, "#")]
    hits = spark.createDataFrame(rows, "seq_id string, motif_ac string, begin int, end int, norm double, level int, level_tag string")
    rules = [("PROMOTED_BY", "C", "B"), ("PROMOTED_BY", "B", "A")]
    level = lambda ranks: {r.motif_ac: r.level for r in postprocess.apply(hits, rules, ranks).collect()}["C"]
    assert level({"B": 2, "C": 1}) == 0 and level({"B": 1, "C": 2}) == -1 and level(None) == -1


def test_tags(spark):
    tag = lambda score, cutoffs, mode=None: spark.range(1).select(normalize.level_tag(F.lit(score), cutoffs, mode).alias("t")).first().t
    cuts = [(10, "?", [1]), (20, "!", [2]), (30, "!!", [1, 2])]
    assert [tag(25, cuts, m) for m in (None, 1, 2, 3)] == ["!", "?", "!", "#"]
    assert tag(35, [(10, "?"), (30, "")]) == "?" and tag(35, [(30, ""), (10, "?")]) == "#"
