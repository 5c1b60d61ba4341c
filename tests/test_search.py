import os
import shutil
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from motifloom.functions import letters, normalize, patterns
from motifloom.operators import build, calibrate, generate, postprocess, search
from motifloom.operators import kernels as K
from motifloom.plans import catalog
from motifloom.sources import alignments, motifs, results, sequences

SF = "/root/testdata/sf0.001"
SF_MORE = "/root/testdata/sf0.01"
PROFILE = "tests/fixtures/tiny.prf"
#: Queries whose SQL takes over a minute at sf0.01.
SLOW = {"translate_interleaved", "translate_six_frames"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracle_sql()) - SLOW))
def test_query_equals_sql(spark, name):
    a, b, here, there = oracle.differences(spark, SF_MORE, catalog.queries()[name], catalog.oracle_sql()[name])
    assert a == b and not here and not there, (list(here)[:3], list(there)[:3])


@pytest.mark.parametrize("name", sorted(SLOW))
def test_slow_query_equals_sql(spark, name):
    a, b, here, there = oracle.differences(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name])
    assert a == b and not here and not there, (list(here)[:3], list(there)[:3])


def lib(spark):
    return spark.createDataFrame([("s1", "TTACGTAACGT"), ("s2", "GGGG"), ("s3", ""), ("s4", None), ("s5", "ACGGT" * 3)], "seq_id string, sequence string")


def tiny():
    return motifs.parse(open(PROFILE).read().split("\n//")[0])


def test_profile_text():
    e = tiny()
    assert (e.ac, e.id, e.type, e.profile.length, e.cutoffs[0]["score"], e.normalization[0]["r"]) == ("PS99999", "TINY", "MATRIX", 4, 20, [0.5, 0.1])
    assert e.profile.match[2, 4] == K.NEG and e.profile.insert[2, 1] == -1 and e.profile.insert[0, 1] == -2 and e.profile.trans["id"][0] == K.NEG
    again = motifs.parse(motifs.serialize(e))
    assert (again.profile.match == e.profile.match).all() and all((again.profile.trans[k] == e.profile.trans[k]).all() for k in e.profile.trans)
    assert e.known == [("P00001", "AAA_ONE", "T"), ("P00002", "BBB_TWO", "F")]


def test_database(spark, tmp_path):
    meta = {r.ac: r for r in motifs.read_metadata(spark, PROFILE).collect()}
    assert meta["PS00001"].pattern == "<A-x(2,3)-[CG]-{T}" and meta["PS00001"].skip and not meta["PS99999"].skip and meta["PS99999"].max_repeat == 2
    assert [e.ac for e in motifs.read_entries(spark, PROFILE)] == ["PS99999", "PS00001"]
    assert {tuple(r) for r in motifs.read_known_matches(spark, PROFILE).collect()} == {("PS99999", "P00001", "AAA_ONE", "T"), ("PS99999", "P00002", "BBB_TWO", "F")}
    motifs.split_database(spark, PROFILE, str(tmp_path / "db"))
    assert {(r.type, r.ac) for r in spark.read.text(str(tmp_path / "db")).select("type", "ac").distinct().collect()} == {("MATRIX", "PS99999"), ("PATTERN", "PS00001")}


def test_search_and_formats(spark):
    e = tiny()
    hits = search.search(lib(spark), [search.Motif(e.profile, 20, None, e.ac), search.Motif(e.profile.reverse(), 20, 10, "REV")])
    got = sorted((r.seq_id, r.match_no, r.begin, r.end, r.raw_score, r.aligned) for r in hits.where("motif_ac = 'PS99999'").collect())
    assert got[:2] == [("s1", 1, 3, 6, 28, "ACGT"), ("s1", 2, 8, 11, 28, "ACGT")]
    assert {r.seq_id for r in search.survivors(lib(spark), hits).collect()} == {"s1", "s5"}
    full = hits.where("motif_ac = 'PS99999' AND seq_id = 's1'").select(
        "*", F.lit("TINY").alias("motif_id"), F.lit("A small motif.").alias("motif_desc"), F.lit("").alias("seq_desc"), F.lit(11).alias("seq_len"), F.lit("+").alias("strand"),
        normalize.raw_to_norm("LINEAR", [0.5, 0.1], F.col("raw_score")).alias("norm_score"), F.lit(0).alias("level"), F.lit("!").alias("level_tag"),
    )
    for kind in results.FORMATS:
        assert results.formatted(full, kind).count() == 2
    assert results.formatted(full, 6).orderBy("value").first().value == ">s1/3-6 motif=PS99999|TINY norm_score=3.300 raw_score=28 level=0 level_tag=! motif_start=1 motif_end=-1 seq_end=-6 strand=+\nACGT"
    assert results.formatted(full, 7).orderBy("value").first().value == "PS99999|TINY\t1\t-1\ts1\t3\t6\t28\t3.300000\t+\tACGT"
    assert "\t4M\t" in results.formatted(full, 8).first().value


def test_both_strands(spark):
    e = tiny()
    p = K.linear(np.array([[-3] + [7 if a == "ACGT".index(c) else -3 for a in range(4)] for c in "AACGG"]), "ACGT")
    df = spark.createDataFrame([("x", "TTAACGGTTCCGTTTT")], "seq_id string, sequence string")
    got = {(r.strand, r.begin, r.end) for r in search.recover(df, search.Motif(p, 30, None, e.ac)).collect()}
    assert got == {("+", 3, 7), ("-", 10, 14)}


def test_prefilter_only_drops(spark):
    p = catalog.profile()
    docs = catalog._docs(spark, SF)
    every = search.search(docs, [search.Motif(p, 30, None, "a")], "doc_id", align=False)
    some = search.search(docs, [search.Motif(p, 30, catalog.H_CUTOFF, "a")], "doc_id", align=False)
    assert some.exceptAll(every).isEmpty() and every.where(F.col("h_score") >= catalog.H_CUTOFF).count() == some.count()


@pytest.mark.parametrize(
    ("pattern", "regex"),
    [("A-x-C.", "[AX].[CX]"), ("<A-[ST](2)-{P}>", "^[AX][STX]{2}[^P]$"), ("x(2,4)-N", ".{2,4}[NBX]"), ("B-[G>]", "[BNDX](?:[GX]|$)"), ("A*", "[AX]*")],
)
def test_patterns(pattern, regex):
    assert patterns.to_regex(pattern) == regex


def test_scan_overlaps(spark):
    df = spark.createDataFrame([(1, "AAAA"), (2, None), (3, "")], "k int, sequence string")
    spans = lambda **o: sorted((r.k, r.begin, r.end) for r in patterns.scan(df, "A{1,2}", **o).collect())
    assert spans() == [(1, 1, 2), (1, 2, 3), (1, 3, 4)] and spans(overlap=False) == [(1, 1, 2), (1, 3, 4)] and spans(include=True)[-1] == (1, 4, 4)
    assert spans(max_matches=1) == [(1, 1, 2)]


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">sp|P1|ONE first one\nACgt\nNN-12\n>two\n\n>three x\nTT\n")
    got = [tuple(r) for r in sequences.read(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [("sp|P1|ONE", "first one", "sp|P1|ONE first one", "ACGTNN"), ("two", "", "two", ""), ("three", "x", "three x", "TT")]
    (tmp_path / "a.fq").write_text("@r1 d\nACGT\n+\n@III\n@r2\nAC\nGT\n+r2\nIIII\n")
    assert [(r.seq_id, r.sequence, r.quality) for r in sequences.read(spark, str(tmp_path / "a.fq"), "fastq").collect()] == [("r1", "ACGT", "@III"), ("r2", "ACGT", "IIII")]
    (tmp_path / "a.dat").write_text("ID   X_Y  Reviewed; 4 AA.\nAC   P1; P2;\nDE   Some\nDE   thing.\nSQ   SEQUENCE 4 AA;\n     AC GT\n//\nID   Z\nSQ   S\n     AA\n//\n")
    assert [(r.seq_id, r.accession, r.description, r.sequence) for r in sequences.read(spark, str(tmp_path / "a.dat"), "embl").collect()] == [("X_Y", "P1", "Some thing.", "ACGT"), ("Z", "", "", "AA")]
    sequences.build_index(spark, str(tmp_path / "a.fa"), str(tmp_path / "ix"))
    assert sequences.read_index(spark, str(tmp_path / "a.fa"), str(tmp_path / "ix")).where("seq_id = 'three'").first().sequence == "TT"
    (tmp_path / "a.fa").write_text(">changed\nA\n")
    with pytest.raises(ValueError):
        sequences.read_index(spark, str(tmp_path / "a.fa"), str(tmp_path / "ix"))
    assert sequences.fasta_text(spark.createDataFrame([("a", None, "ACGT")], "seq_id string, description string, sequence string"), 3).first().value == ">a\nACG\nT"


def test_alignment_files(spark, tmp_path):
    (tmp_path / "m.fa").write_text(">a weight=2\nAC-\n>b\nA.G\n")
    rows = {(r.seq_id, r.weight, r["col"], r.symbol) for r in alignments.read_msa(spark, str(tmp_path / "m.fa")).collect()}
    assert ("a", 2.0, 3, "-") in rows and ("b", 1.0, 2, "-") in rows and len(rows) == 6
    (tmp_path / "x.msf").write_text("MSF: 4\n Name: a Len: 4 Check: 1 Weight: 0.5\n Name: b Len: 4 Check: 1 Weight: 1.0\n//\na AC\nb A.\n\na GT\nb GG\n")
    assert alignments.read_msf(spark, str(tmp_path / "x.msf")).where("seq_id = 'b' AND col = 2").first().symbol == "-"
    (tmp_path / "c").write_text("# matrix\n5.0 -1.0 A\n 4.0 B\n")
    assert {(r.a, r.b): r.score for r in alignments.read_matrix(spark, str(tmp_path / "c")).collect()} == {("A", "A"): 5, ("A", "B"): -1, ("B", "A"): -1, ("B", "B"): 4}


def test_build(spark):
    rows = [("a", 1.0, "ACGT-"), ("b", 1.0, "ACG-A"), ("c", 2.0, "ACGTA")]
    msa = alignments._long(spark.createDataFrame(rows, "seq_id string, weight double, row string"))
    freqs = {(r["col"], r.symbol): (r.freq, r.gap) for r in build.column_frequencies(build.blank_ends(msa)).collect()}
    assert freqs[1, "A"] == (1.0, 0.0) and freqs[4, "T"] == (0.75, 0.25) and freqs[5, "A"] == (1.0, 0.0)
    matrix = spark.createDataFrame([(a, b, 5.0 if a == b else -4.0) for a in "ACGT" for b in "ACGT"], "a string, b string, score double")
    p = build.make_profile(msa, matrix, "ACGT")
    assert p.consensus == "ACGTA" and p.match[0].tolist()[1:] == [50, -40, -40, -40]
    assert K.scores(p, [p.encode("ACGTA")])[0] > K.scores(p, [p.encode("TTTTT")])[0]
    made = {r.seq_id: r.aligned for r in build.to_msa(spark.createDataFrame([("a", "xAbcC"), ("b", "AddeCyy"), ("c", "AC")], "seq_id string, aligned string")).collect()}
    assert made == {"a": "xAb.cC..", "b": ".AddeCyy", "c": ".A...C.."}
    w = {r.seq_id: r.weight for r in build.weights(msa, 20).collect()}
    assert abs(sum(w.values()) - 1) < 1e-9
    hmm = build.profile_to_hmm(p, build.null_model("ACGT"))
    assert all(abs(sum(e.values()) - 1) < 1e-9 for e in hmm["match"])
    back = build.hmm_to_profile(hmm["match"], hmm["insert"], hmm["trans"], build.null_model("ACGT"))
    assert back.consensus == "ACGTA" and build.frame_search(p).length == 13
    m = build.iupac_matrix()
    assert m["A", "A"] == 5 and m["A", "R"] == 1 and m["N", "N"] == -2


def test_calibration(spark):
    rng = np.random.default_rng(0)
    x = rng.gumbel(100, 12, 20000)
    df = spark.createDataFrame([(float(v),) for v in x], "s double")
    for method in ("full", "peak", "tail"):
        mu, lam = calibrate.calibrate_evd(df, "s", method)
        assert abs(mu - 100) < 2 and abs(lam * 12 - 1) < 0.1, (method, mu, lam)
    y = 3 + 2 * np.arange(500) + rng.exponential(5, 500)
    a, b = calibrate.quantile_regression(np.arange(500.0), y, 0.05)
    assert abs(b - 2) < 0.02 and 0.02 < np.mean(y < a + b * np.arange(500)) < 0.08
    cut = calibrate.refresh_cutoffs([{"level": 0, "score": 1, "mode": [1], "n_score": [8.5]}], 1, (0.3941, 0.01483), (10.0, 2.0))
    assert cut[0]["score"] == 547 and cut[0]["h_score"] == 1104


def test_generators(spark):
    p = K.linear(np.array([[-9] + [200 if a == i % 4 else -200 for a in range(4)] for i in range(8)]), "ACGT", -300, -100)
    made = generate.emit(spark, p, 5)
    assert [r.sequence for r in made.collect()] == ["ACGTACGT"] * 5
    m = generate.mutants(made, "ACGT", [1, 4], 2)
    rows = sorted(m.collect())
    assert len(rows) == 20 and rows == sorted(generate.mutants(made.repartition(3), "ACGT", [1, 4], 2).collect())
    for method in ("permutation", "window", "codon", "bubble"):
        assert all(sorted(r.sequence) == sorted("ACGTACGT") for r in generate.randomized(made, method, rate=0.5).collect())
    assert generate.subset(made, 2).count() == 2
    lib_ = sequences.random_library(spark, 50, 200, {"A": 3, "C": 1})
    text = "".join(r.sequence for r in lib_.collect())
    assert len(text) == 10_000 and abs(text.count("A") / 1e4 - 0.75) < 0.03


def test_tandem_repeats(spark):
    rows = [("s", "R", b, b + 19, 1, -1, 100, 5.0, -1, "#") for b in (0, 20, 40, 60)] + [("t", "R", b, b + 19, None, None, 100, 5.0, lv, "#") for b, lv in ((0, -1), (31, 0))] + [("u", "R", 5, 24, None, None, 100, None, -1, "#"), ("s", "X", 0, 9, None, None, 1, 1.0, -1, "#")]
    df = spark.createDataFrame(rows, "seq_id string, motif_ac string, begin int, end int, pf_begin int, pf_end int, raw int, norm double, level int, level_tag string")

    def slow(hits, size, top):
        sinc2 = lambda x: 1.0 if x == 0 else (np.sin(x) / x) ** 2
        bump = lambda x, h: h[6] / top * sinc2(2 * np.pi * (x - (h[2] + 10)) / 20)
        both = []
        for x in range(hits[0][2], hits[-1][3] + 1):
            near = [(h, hits[1] if g == 0 else hits[g - 1], 1 if g == 0 else -1) for g, h in enumerate(hits)]
            both.append(sum(bump(x, h) for h, _, _ in near) * sum(bump(x + k * size, o) for _, o, k in near))
        return sum((a + b) / 2 for a, b in zip(both, both[1:], strict=False))

    s_area, t_area = slow(rows[:4], 20, 100), slow(rows[4:6], 20, 100)
    assert s_area > t_area
    for cutoff, want in ((s_area + 1e-6, -2), (s_area - 1e-6, 0)):
        got = {(r.seq_id, r.motif_ac, r.begin): (r.level, r.level_tag) for r in postprocess.flank_repeats(df, "R", 100, cutoff, 20, 2).collect()}
        assert all(got["s", "R", b] == (want, "PROMOTED_FTREP" if want == 0 else "DEMOTED_FTREP") for b in (0, 20, 40, 60))
        assert got["t", "R", 0] == (-2, "DEMOTED_FTREP") and got["t", "R", 31] == (0, "#") and got["u", "R", 5][0] == -2 and got["s", "X", 0] == (-1, "#")
    assert postprocess.flank_repeats(df, "R", 100, 0.0, 20, 2, least_norm=6.0).where("level = 0").count() == 1
    assert postprocess.apply(df, [("PROMOTED_BY", "R", "R", 0)]).where("seq_id = 't' AND begin = 0").first().level_tag == "PROMOTED_BY_R"


def test_rules_on_few_hits(spark):
    kind = "seq_id string, motif_ac string, begin int, end int, norm double, level int, level_tag string"
    rows = [("s", "A", 1, 3, 5.0, 1, "#"), ("s", "B", 2, 9, 7.0, 0, "#"), ("s", "B", 20, 30, None, None, "#"), ("t", "A", 1, 9, -2.0, -1, "#"), ("t", "B", 1, 9, -3.0, -1, "#"), ("u", "A", 1, 9, 1.0, 0, "#")]
    df = spark.createDataFrame(rows, kind)
    by = lambda d: {(r.seq_id, r.motif_ac, r.begin): (r.level, r.level_tag) for r in d.collect()}
    got = by(postprocess.demoted_by(df, "A", "B"))
    assert got["s", "A", 1] == (0, "DEMOTED") and got["t", "A", 1] == (-1, "#") and got["u", "A", 1] == (0, "#")
    assert by(postprocess.competes_hit_with(df, "A", "B", 2))["s", "A", 1] == (1, "#")  # too short to compete
    assert by(postprocess.competes_hit_with(df, "A", "B", 1))["s", "A", 1] == (0, "OUTCOMPETED_HIT_BY_B")
    got = by(postprocess.competes_seq_with(df, "A", "B"))
    assert got["t", "A", 1] == (-2, "OUTCOMPETED_SEQ_BY_B") and got["u", "A", 1] == (0, "#") and got["s", "B", 20] == (None, "#")
    assert postprocess.apply(df.where("false"), [("COMPETES_HIT_WITH", "A", "B", 1), ("PROMOTER_RDM1_OR_RDM2", "A", "A", 3.0)]).count() == 0
    rules = postprocess.implicit_rules("A", [{"level": 0, "n_score": [8.0], "text": "'!'"}, {"level": -1, "n_score": [6.0], "text": "'RR'"}, {"level": -2, "n_score": [4.0], "text": "'R?'"}])
    assert rules == [("PROMOTER_RDM1", "A", "A"), ("PROMOTER_RDM1_OR_RDM2", "A", "A", 14.0)] and postprocess.scan_level(0) == -1


def test_best_family_and_metadata(spark):
    hits = spark.createDataFrame([("s", a, 5) for a in "DBAC"] + [("t", "C", 9), ("t", "A", 8)], "seq_id string, motif_ac string, raw_score int")
    assert {(r.seq_id, r.family) for r in search.best_family(hits).collect()} == {("s", "A"), ("t", "C")}
    meta = postprocess.with_metadata(hits, spark.createDataFrame([("A", "ONE", "first", "MATRIX", False)], "ac string, id string, description string, type string, skip boolean"))
    assert {(r.motif_ac, r.motif_id) for r in meta.collect()} == {("A", "ONE"), ("B", None), ("C", None), ("D", None)}


def test_translation(spark):
    df = spark.createDataFrame([("ATGAAATAG",), ("ATGCTN",), ("AC",), ("",)], "s string")
    assert [r[0] for r in df.select(letters.translate_frames(F.col("s"))[0]).collect()] == ["MKO", "ML", "", ""]


def test_stream(spark, tmp_path):
    from motifloom.streaming.search import stream_documents, stream_search

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs.write.parquet(str(tmp_path / "in"))
    motif = search.Motif(catalog.profile(), 33, catalog.H_CUTOFF, "m")
    hits = stream_search(stream_documents(spark, str(tmp_path / "in"), "doc_id long, text string"), [motif])
    hits.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(300)
    want = search.search(catalog._docs(spark, SF), [motif], "doc_id")
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(want).isEmpty() and want.count() > 0


@pytest.mark.parametrize("missing", ["the folder", "a library"])
def test_entry_without_the_corpus_operators(tmp_path, missing):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{here}/motifloom", tmp_path / "motifloom", ignore=shutil.ignore_patterns("__pycache__", *(["llm"] if missing == "the folder" else [])))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    block = "" if missing == "the folder" else "sys.modules['xxhash'] = sys.modules['regex'] = sys.modules['tiktoken'] = None; "
    code = f"import sys; {block}import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm is None or bool(e.queries()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[0]) >= len(catalog.queries()) and int(out[1]) >= len(catalog.oracle_sql()) and out[2] == "True"
