"""Motifs as a table against motifs as a list; table functions."""

import numpy as np
import pytest

from motifloom.operators import kernels as K
from motifloom.operators import search, tables
from motifloom.sources import motifs


def made(rng, n):
    out = []
    for k in range(n):
        p = K.linear(rng.integers(-4, 6, (int(rng.integers(3, 9)), 5)), "ACGT", -9, -3)
        cut = {"level": 0, "score": int(rng.integers(9, 16)), "h_score": 8 if k % 2 else None, "n_score": [8.5], "mode": [1], "text": "!"}
        out.append(motifs.Entry(id=f"I{k}", ac=f"A{k:03}", type="MATRIX", profile=p, cutoffs=[cut]))
    return out


def test_table_equals_list(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    entries = made(rng, 25)
    lib = spark.createDataFrame([(k, "".join(rng.choice(list("ACGTN"), int(rng.integers(0, 60))))) for k in range(80)] + [(80, None)], "seq_id long, sequence string")
    (tmp_path / "m.dat").write_text("\n".join(map(motifs.serialize, entries)) + "\n")
    table = tables.read_motifs(spark, str(tmp_path / "m.dat"))
    assert {r.ac for r in table.collect()} == {e.ac for e in entries}
    want = sorted(map(tuple, search.search(lib, [search.Motif(e.profile, e.cutoffs[0]["score"], e.cutoffs[0]["h_score"], e.ac) for e in entries]).collect()))
    assert len(want) > 100
    for rows, cols in ((1 << 20, 1 << 20), (300, 4000)):
        monkeypatch.setattr(tables, "SEQUENCE_BLOCK", rows)
        monkeypatch.setattr(tables, "MOTIF_BLOCK", cols)
        assert sorted(map(tuple, tables.search_table(lib, table).collect())) == want
    assert tables.search_table(lib.where("false"), table).count() == tables.search_table(lib, table.where("false")).count() == 0
    tables.register(spark)
    got = spark.sql("SELECT s.seq_id, m.motif_ac, m.match_no, m.begin, m.end, m.raw_score, m.aligned FROM {s} s JOIN {t} t ON true, LATERAL motif_matches(s.sequence, t.text, 0) m", s=lib, t=table).collect()
    assert sorted(map(tuple, got)) == sorted((w[0], w[1], w[2], w[3], w[4], w[7], w[9]) for w in want)
    got = spark.sql("SELECT * FROM pattern_matches('XACGTACG', 'A-C-G')").collect()
    assert [tuple(r) for r in got] == [(1, 2, 4, "ACG"), (2, 6, 8, "ACG")]


def test_levels_of_entries():
    text = motifs.serialize(made(np.random.default_rng(1), 1)[0])
    assert tables.motif_of(text).ac == "A000"
    with pytest.raises(ValueError):
        tables.motif_of(text, 3)
