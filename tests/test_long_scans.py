"""Scans of texts with very many matches: no batch repeats the text for all of them."""

from motifloom.functions import patterns
from motifloom.plans import catalog


def test_many_matches_in_one_text(spark, tmp_path):
    n = 50_000
    spark.createDataFrame([(1, "thar" * n), (2, "none"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.pattern_scan(spark, str(tmp_path)).selectExpr("count(*)", "sum(begin)", "sum(end - begin)", "max(match_no)", "count(DISTINCT matched)").first()
    assert tuple(got) == (n, 4 * n * (n - 1) // 2 + n, 3 * n, n, 1)


def test_kept_texts_across_batches(spark, monkeypatch):
    df = spark.createDataFrame([(1, "AXAXA", "u"), (2, "", "v"), (3, "CAC", "w")], "k int, sequence string, other string").coalesce(1)
    want = [(1, "AXAXA", "u", 1, 1, 1, "A"), (1, "AXAXA", "u", 2, 3, 3, "A"), (1, "AXAXA", "u", 3, 5, 5, "A"), (3, "CAC", "w", 1, 2, 2, "A")]
    for size in (patterns.REPEATED, 1):
        monkeypatch.setattr(patterns, "REPEATED", size)
        assert sorted(map(tuple, patterns.scan(df, "A").collect())) == want
    assert patterns.scan(df, "A", keep=False).columns == ["k", "other", "match_no", "begin", "end", "matched"]


def test_overlaps_in_one_long_text(spark, tmp_path):
    n = 20_000
    spark.createDataFrame([(1, "exthabce" * n)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.overlap(spark, str(tmp_path)).selectExpr("count(*)", "count(DISTINCT a_begin)", "sum(b_begin - a_begin)").first()
    assert tuple(got) == (n, n, -2 * n)
    assert tuple(catalog.containment(spark, str(tmp_path)).selectExpr("count(*)", "count_if(inside)").first()) == (n, 0)
