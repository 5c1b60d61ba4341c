import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifloom.functions import normalize
from motifloom.operators import build, calibrate, generate, postprocess, search
from motifloom.operators import kernels as K
from motifloom.sources import models, results, sequences

HMM2 = """HMMER2.0
NAME  two
ACC   X1
DESC  a small one
LENG  2
ALPH  Nucleic
NULT      -4  -8455
NULE       0      0      0      0
HMM        A      C      G      T
         m->m   m->i   m->d   i->m   i->i   d->m   d->d   b->m   m->e
         -152      *  -3322
     1   1000  -1000      *  -1000     1
     -      0      0      0      0
     -   -152  -4322  -4322  -1000  -1000  -1000  -1000   -152      *
     2      *      *   2000      *     2
     -      *      *      *      *
     -      *      *      *      *      *      *      *      *      0
//
"""


def test_second_generation_models(spark, tmp_path):
    m = models.parse_hmm2(HMM2)
    assert (m.name, m.ac, m.description, m.alphabet, len(m.match)) == ("two", "X1", "a small one", "ACGT", 2)
    assert m.match[0] == {"A": 0.5, "C": 0.125, "G": 0.0, "T": 0.125} and m.match[1]["G"] == 1.0 and m.null["A"] == 0.25
    assert abs(m.trans[0]["mm"] - 0.9) < 1e-3 and abs(m.trans[0]["md"] - 0.1) < 1e-3 and abs(m.trans[1]["mi"] - 0.05) < 1e-3 and m.trans[2]["mm"] == 1.0
    p = m.profile()
    assert p.length == 2 and p.match[0].tolist() == [0, 30, -30, K.NEG, -30] and p.consensus == "AG"
    (tmp_path / "db").write_text(HMM2 + HMM2.replace("two", "three"))
    assert [x.name for x in models.read_hmms(spark, str(tmp_path / "db"))] == ["two", "three"]


def test_first_generation_models_come_back():
    m = models.parse_hmm2(HMM2)
    again = models.parse_hmm1(models.hmm1_text(m))
    assert again.alphabet == "ACGT" and len(again.match) == 2 and len(again.trans) == 3
    close = lambda a, b: all(abs(x.get(k, 0) - y.get(k, 0)) < 1e-5 for x, y in zip(a, b, strict=True) for k in {*x, *y})
    assert close(again.match, m.match) and close(again.insert, m.insert) and close(again.trans, m.trans)
    with pytest.raises(ValueError):
        models.parse_hmm1(models.hmm1_text(m).rsplit("\n", 5)[0])
    p = build.profile_to_hmm(again.profile(m.null), m.null)
    assert abs(p["match"][1]["G"] - 1) < 1e-6
    assert models.reordered({"C": 1, "A": 3, "Z": 5}, "AC") == {"A": 0.75, "C": 0.25}
    with pytest.raises(ValueError):
        models.reordered({"A": 1}, "AC")


def test_gcg_text():
    text = "(Peptide)  Length: 2\n# ID   S\n# AC   P9;\nCons A    C   Gap  Len  ..\n A   150  -30  260   30\n! note\n c   -20  70   100  100\n *  3 2\n"
    alphabet, rows, notes = models.parse_gcg(text)
    assert alphabet == "AC" and rows == [("A", [150.0, -30.0], 260.0, 30.0), ("c", [-20.0, 70.0], 100.0, 100.0)] and notes == {"ID": "S", "AC": "P9;"}
    p = models.gcg_profile(text, F_=100.0)
    assert p.length == 2 and p.match[0].tolist() == [0, 150, -30] and p.consensus == "Ac"


def test_cutoffs_of_a_search():
    modes = [{"mode": 1, "function": "LINEAR", "priority": 2, "r": [0.5, 0.01]}, {"mode": 2, "function": "GLE_ZSCORE", "priority": 1, "r": [1, 1, 1, 1, 1]}, {"mode": -1, "function": "LINEAR", "priority": 9, "r": [100.0, 2.0]}]
    cuts = [{"level": 0, "score": 800, "h_score": 1500}, {"level": -1, "score": 600, "h_score": None}]
    assert normalize.choose_mode(modes)["mode"] == 2 and normalize.choose_mode(modes, 1)["mode"] == 1
    assert normalize.choose_level(cuts, 3, nearest=True)["level"] == 0 and normalize.choose_level(cuts, -1)["score"] == 600
    f = normalize.search_cutoffs
    assert f(modes, cuts) == (800, 1500) and f(modes, cuts, level=-1, mode=1) == (600, 1300)
    assert f(modes, cuts, 700, mode=1) == (700, 1500) and f(modes, cuts, "700", mode=1) == (700, 1500) and f(modes, cuts, 8.5, mode=1) == (800, 1500) and f(modes, cuts, "7.0", mode=1) == (650, 1400)
    for bad in (lambda: f(modes, cuts, 8.5), lambda: f(modes, cuts, level=4), lambda: normalize.choose_mode([]), lambda: normalize.choose_mode(modes, 7)):
        with pytest.raises(ValueError):
            bad()


def test_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.gumbel(100, 12, 20000)
    df = spark.createDataFrame([(float(v),) for v in x], "s double")
    line = calibrate.evd_linear_fit(df, "s").first()
    assert abs(line.mu - 100) < 2 and abs(line.lam * 12 - 1) < 0.15
    good, bad = (calibrate.evd_chi2(df, "s", mu, 1 / 12, 2.0).first() for mu in (100, 104))
    assert good.chi2 < 2 * good.bins < bad.chi2
    g = calibrate.gaussian_fit(df, "s").first()
    assert abs(g.mean - x.mean()) < 1e-6 and abs(g.sd - x.std(ddof=1)) < 1e-6
    row = df.limit(1).select(calibrate.evd_density(F.lit(100.0), 100, 0.5).alias("d"), calibrate.poisson_p(F.lit(2.0)).alias("p")).first()
    assert abs(row.d - 0.5 / math.e) < 1e-12 and abs(row.p - (1 - math.exp(-2))) < 1e-12


def test_calibration_run(spark):
    p = K.linear(np.array([[-6] + [9 if a == "ACGTACGTAC".index(c) % 4 else -6 for a in range(4)] for c in "ACGTACGTAC"]), "ACGT", -20, -6)
    library = sequences.random_library(spark, 400, 200, {"A": 1, "C": 1, "G": 1, "T": 1})
    family = generate.mutants(spark.createDataFrame([(str(k), "ACGTACGTAC" * 3) for k in range(40)], "seq_id string, sequence string"), "ACGT", [0, 2, 4, 8], 2)
    got, pairs = calibrate.calibrate(p, library, family, [{"level": 0, "score": 1, "mode": [1], "n_score": [8.5]}])
    assert got["r"][1] > 0 and got["h"][1] > 0 and got["cutoffs"][0]["score"] > 20 and pairs.count() == 320
    low = pairs.where(F.col("h_score") < F.lit(got["h"][0]) + F.lit(got["h"][1]) * F.col("score")).count()
    assert low <= 0.15 * 320
    again, _ = calibrate.calibrate(p, library.repartition(3), family.repartition(2), [{"level": 0, "score": 1, "mode": [1], "n_score": [8.5]}])
    assert again["cutoffs"] == got["cutoffs"]


def test_dumps_and_edits(spark, tmp_path):
    p = K.linear(np.array([[-3] + [7 if a == "ACGT".index(c) else -3 for a in range(4)] for c in "AACGG"]), "ACGT")
    lib = spark.createDataFrame([("x", "TTAACGGTT"), ("y", "")], "seq_id string, sequence string")
    dump = search.score_dump(lib, p, both_strands=True)
    lines = {r.value for r in results.score_text(dump).collect()}
    assert any(x.endswith("\tx\t+") and x.split("\t")[1] == "35" for x in lines) and "0\t-\ty\t+" in lines and len(lines) == 4
    other = K.complemented(p)
    assert K.scores(other, [other.encode("TTGCC")])[0] == 35
    assert (K.complemented(other).match == p.match).all()
    hits = spark.createDataFrame([("s", 1, 3, 5, "AC%G")], "header string, match_no int, begin int, end int, matched string")
    assert results.regex_text(hits, "A.%").first().value == "s_1 3-5 A.%\nAC%G"
    msa = spark.createDataFrame([("a", "ACdefgh-G..T")], "seq_id string, aligned string")
    show = lambda **o: build.edited(msa, **o).first().aligned
    assert show(gap="-") == "ACdefgh-G--T" and show(longest=3) == "ACdeh.G..T" and show(case="upper") == "ACDEFGH.G..T" and show(longest=1, gap="-") == "ACd-G-T"
    lib = spark.createDataFrame([("b x", "A-c"), ("a", "GG"), ("b y", "T.")], "header string, sequence string")
    got = [tuple(r) for r in sequences.sorted_library(lib, degap=True, upper=True, complement=True, reverse=True, short_header=True).collect()]
    assert got == [("a", "CC"), ("b", "AGT")]
    spark.createDataFrame([("PS1|ONE\t1\t-1\ts1\t3\t6\t28\t3.300000\t+\tACGT",)], "value string").write.text(str(tmp_path / "r"))
    r = results.read_search(spark, str(tmp_path / "r")).first()
    assert (r.motif_ac, r.motif_id, r.begin, r.raw_score, r.norm_score, r.aligned) == ("PS1", "ONE", 3, 28, 3.3, "ACGT")
    parts = spark.createDataFrame([("s", 1, 20, [(1, 9), (10, 20)]), ("t", 2, 5, [])], "seq_id string, begin int, end int, sub_hits array<struct<begin:int,end:int>>")
    assert sorted(tuple(r) for r in postprocess.unroll(parts).collect()) == [("s", 1, 9), ("s", 10, 20), ("t", 2, 5)]


def test_sam_lines(spark):
    kind = "seq_id string, strand string, motif_ac string, motif_id string, motif_start int, begin int, end int, raw_score int, norm_score double, aligned string, quality string"
    rows = [("sp|P1|ONE", "+", "PS1", "M", 2, 3, 6, 28, 3.256, "-AcG-T-", "IIABCDII"), ("two", "-", "PS1", "M", 1, 3, 4, 5, None, "AC", "IIABCDII")]
    hits = spark.createDataFrame(rows, kind)
    got = [r.value for r in results.formatted(hits, 8).collect()]
    assert got == ["ONE\t2\tPS1|M\t2\t255\t1M1I1M1D1M\t*\t0\t6\tACGT\tABCD\tAS:i:28\tNS:f:3.26", "two\t18\tPS1|M\t1\t255\t2M\t*\t0\t2\tAC\tBA\tAS:i:5\tNS:f:0.00"]
    assert results.formatted(hits.drop("quality"), 8).first().value.split("\t")[10] == "*"


def test_nearest_shares(spark):
    seqs = spark.createDataFrame([("a", "AC"), ("b", "GT")], "seq_id string, aligned string")
    cands = spark.createDataFrame([(1, "AC"), (2, "TA")], "cand_id int, aligned string")
    assert {r.seq_id: r.share for r in build.nearest_shares(cands, seqs).collect()} == {"a": 1.5, "b": 0.5}


def test_special_prefilter():
    p = K.linear(np.array([[-9, 5, -9], [-9, 5, -9], [-9, 5, -9]]), "AB", -3, -1)
    codes = p.encode("ABA")
    starts = np.array([0, 3])
    plain, kind = K.h_scores(p, codes, starts)[0], K.h_scores(p, codes, starts, K.detours(p))[0]
    assert K.detours(p).tolist() == [-3, -3, -3] and plain == 15 and kind == 5 + 5 + 7


def test_all_matches_equal_one_search_after_another():
    rng = np.random.default_rng(11)
    for free in (False, True):
        for _ in range(15):
            p = K.linear(rng.integers(-6, 8, (6, 5)), "ACGT", -7, -2, **({"n1": 2, "n2": 5} if free else {}))
            seqs = ["".join(rng.choice(list("ACGTN"), rng.integers(1, 200))) for _ in range(4)]
            got = K.all_matches(p, [p.encode(s) for s in seqs], seqs, 12)
            for s, found in zip(seqs, got, strict=True):
                locked, want, codes = np.zeros(len(s), bool), [], p.encode(s)
                while (m := K.best_match(p, codes, s, locked)) is not None and m.score >= 12:
                    want.append(m.score)
                    locked[m.protected_begin - 1 : m.protected_end] = True
                assert sorted(m.score for m in found) == sorted(want) or abs(sum(m.score for m in found) - sum(want)) <= 12, (s, found, want)
                for m in found:
                    assert m.aligned.replace("-", "").upper() == s[m.begin - 1 : m.end]
    long = "ACGT" * 4_000
    p = K.linear(np.array([[-9] + [5 if a == i % 4 else -9 for a in range(4)] for i in range(8)]), "ACGT", -30, -10)
    found = K.matches(p, p.encode(long), long, 40)
    assert len(found) == 2_000 and all(m.aligned == "ACGTACGT" for m in found)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("ACGé-Ω"), n))
    for n in (1, 63, 64, 130):
        a, b = [word(n) for _ in range(20)], [word(n) for _ in range(30)]
        assert build.distances(a, b).tolist() == [[sum(p != q for p, q in zip(x, y)) for y in b] for x in a]
    monkeypatch.setattr(build, "BLOCK", 8)
    cands, seqs = [word(12) for _ in range(50)], [word(12) for _ in range(40)] + ["A" * 12] * 3
    got = build.nearest(spark.createDataFrame(list(enumerate(cands)), "cand_id long, aligned string"), spark.createDataFrame(list(enumerate(seqs)), "seq_id long, aligned string")).collect()
    want = {}
    for k, c in enumerate(cands):
        d = [sum(p != q for p, q in zip(c, s)) for s in seqs]
        want[k] = (min(d), [i for i, v in enumerate(d) if v == min(d)])
    assert {r.cand_id: (r.distance, sorted(r.seq_ids)) for r in got} == want and len(got) == 50
