"""Texts of matches, whole."""

from motifloom.sources import results

KIND = "seq_id string, seq_ac string, seq_desc string, strand string, motif_ac string, motif_id string, motif_desc string, motif_start int, motif_end int, begin int, end int, raw_score int, norm_score double, level int, level_tag string, aligned string"
ROWS = [
    ("s1", "P1", "one", "+", "PS1", "NAME", "a motif", 1, -1, 12, 15, 28, 3.256, 0, "!", "ACgT-K"),
    ("s1", "P1", "one", "+", "PS1", "NAME", "a motif", 2, -1, 3, 6, 9, 1.0, -1, None, "A" * 65),
    ("s\"2", "P2", "two", "+", "PS2", "PAT", None, None, None, 1, 2, None, None, None, None, "AC"),
]


def test_lines(spark):
    hits = spark.createDataFrame(ROWS, KIND)
    text = lambda kind: [r.value for r in results.formatted(hits, kind, 60).collect()]
    assert text("fasta") == [">s1/12-15 : PS1 NAME L=!\nACGTK", ">s1/3-6 : PS1 NAME L=-1\n" + "A" * 60 + "\n" + "A" * 5, ">s\"2/1-2 : PS2 PAT\nAC"]
    assert text("psa")[0] == text("msa")[0] == ">s1/12-15 : PS1 NAME L=!\nACgT-K"
    assert text("epff")[0] == "s1\t12\t15\tPS1\t1\t-1\t28\t3.256\t!\tACgT-K" and text("epff")[2].split("\t")[0::9] == ["s\"2", "AC"]
    assert text(10)[2].startswith('[] a :Match ; :sequence "s\\"2" ; :motif "PS2" ; :begin 1') if text(10)[2] else True
    assert text(10)[0] == '[] a :Match ; :sequence "s1" ; :motif "PS1" ; :begin 12 ; :end 15 ; :score 3.256 .'


def test_scan(spark):
    got = {(r.seq_id, r.motif_ac): r.value for r in results.scan_text(spark.createDataFrame(ROWS, KIND)).collect()}
    assert got["s1", "PS1"] == ">s1 : PS1 NAME a motif\n        3 - 6  " + "A" * 60 + " L=-1\n " + "AAAAA" + " " * 55 + " L=-1\n      12 - 15  ACgT-K" + " " * 54 + " L=!"
    assert got["s\"2", "PS2"] == '>s"2 : PS2 PAT\n        1 - 2  AC'


def test_sequences_and_match_list(spark):
    hits = spark.createDataFrame(ROWS, KIND)
    lib = spark.createDataFrame([("s1", "one", "ACGT" * 20), ("s3", None, "A")], "seq_id string, description string, sequence string")
    assert [r.value for r in results.hit_sequences(hits, lib).collect()] == [">s1 : one : PS1\n" + ("ACGT" * 15) + "\n" + "ACGT" * 5]
    rows = results.match_list(hits).orderBy("motif_id", "part", "seq_ac").collect()
    assert [r.value for r in rows] == ["NAME", "P1    , s1        , T;       2", " 1             2", "PAT", 'P2    , s"2       , T;       1', " 1             1"]


def test_metadata_of_entries(spark, tmp_path):
    from motifloom.sources import motifs

    (tmp_path / "m.dat").write_text(
        "ID   ONE; MATRIX.\nAC   PS1;\nDE   First.\nMA   /CUT_OFF: LEVEL=0; SCORE=20; N_SCORE=2.5; MODE=1; TEXT='!';\nMA   /CUT_OFF: LEVEL=-1; SCORE=10; TEXT='?';\n"
        "CC   /SITE=3,active_site; /SITE=9,metal(?);\nPP   /PROMOTED_BY: PS2=1; PS3;\nPP   /FTREP: PS1=2;\nDO   PDOC00001;\n//\nID   TWO; PATTERN.\nAC   PS2;\nPA   A-C.\n//\n"
    )
    got = {r.ac: r for r in motifs.read_metadata(spark, str(tmp_path / "m.dat")).collect()}
    one = got["PS1"]
    assert [tuple(x) for x in one.sites] == [(3, "active_site"), (9, "metal(?)")] and one.doc == "PDOC00001"
    assert one.cutoffs == [{"LEVEL": "0", "SCORE": "20", "N_SCORE": "2.5", "MODE": "1", "TEXT": "'!'"}, {"LEVEL": "-1", "SCORE": "10", "TEXT": "'?'"}]
    assert [tuple(x) for x in one.rules] == [("PROMOTED_BY", ["PS2=1", "PS3"]), ("FTREP", ["PS1=2"])]
    two = got["PS2"]
    assert two.pattern == "A-C" and two.sites == two.cutoffs == two.rules == []


def test_msf_files(spark, tmp_path):
    from motifloom.sources import alignments

    for k in range(3):
        rows = {f"s{k}a": "AC..GT" * 20, f"s{k}b": "~CGT-A" * 20}
        head = "\n".join(f" Name: {n}  oo  Len: 120  Check: 1  Weight: {0.5 + k}" for n in rows)
        blocks = "\n\n".join("\n".join(f"{n}   {r[i : i + 10]} {r[i + 10 : i + 20]}" for n, r in rows.items()) for i in range(0, 120, 20))
        (tmp_path / f"{k}.msf").write_text(f"PileUp\n\n MSF: 120 Type: P ..\n\n{head}\n\n//\n\n{blocks}\n")
    got = alignments.read_msf(spark, str(tmp_path)).collect()
    rows = {}
    for r in sorted(got, key=lambda r: r.col):
        rows.setdefault((r.seq_id, r.weight), []).append(r.symbol)
    assert {k: "".join(v) for k, v in rows.items()} == {(f"s{k}{x}", 0.5 + k): t * 20 for k in range(3) for x, t in (("a", "AC--GT"), ("b", "-CGT-A"))}


def test_sam_models_round_trip():
    import numpy as np
    import pytest

    from motifloom.sources import models

    rng = np.random.default_rng(3)
    for alphabet in (models.AMINO, models.BASES):
        chances = lambda keys: {k: round(float(v), 6) for k, v in zip(keys, rng.dirichlet(np.ones(len(keys))), strict=True)}  # noqa: B023,E731
        m = models.Model(name="x", alphabet=alphabet, match=[chances(alphabet) for _ in range(3)], insert=[chances(alphabet) for _ in range(4)], trans=[chances(models.STEPS) for _ in range(4)])
        m.trans[0] |= {"di": 0.0}
        m.trans[3] |= {"md": 0.0, "id": 0.0, "dd": 0.0}
        text = models.sam_text(m)
        back = models.parse_sam(text)
        assert (back.alphabet, back.match, back.insert, back.trans) == (m.alphabet, m.match, m.insert, m.trans)
        assert "\n-1\n" in text and text.endswith("ENDMODEL\n") and text.count("\n\n") == 5
    with pytest.raises(ValueError):
        models.sam_text(models.Model(alphabet="AB"))
