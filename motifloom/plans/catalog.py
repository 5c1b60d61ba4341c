"""Queries by name, with the SQL that gives the same rows.

The tables are no sequence libraries, so operators are bound to what resembles
one: letters of a document are a sequence, the lines of an order are hits of
motifs, prices are scores. Every query runs over whole tables and whole texts.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import letters, normalize, patterns
from ..operators import build, calibrate, kernels, postprocess, search, tables
from ..sources import motifs, sequences

_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", letters.clean(F.col("text")).alias("sequence"))


#: Letters of text as bases, by their place in the alphabet.
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASES = "ACGTACGTACGTACGTACGTACGTAC"
_SEQ = "upper(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
_DNA = f"translate({_SEQ}, '{_AZ}', '{_BASES}')"


def _dna(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.translate("sequence", _AZ, _BASES).alias("dna"))


def profile(length: int = 16) -> kernels.Profile:
    """A profile by rule: position i (from 0) and letter a (from 1) score (7 i + 3 a) mod 11 - 6; other letters -6."""
    i, a = np.arange(length)[:, None], np.arange(27)[None]
    match = (7 * i + 3 * a) % 11 - 6
    match[:, 0] = -6
    return kernels.linear(match, _AZ, open_gap=-9, extend=-2, name="RULE16")


H_CUTOFF, CUTOFF = 320, 30


# letters


@query(f"SELECT doc_id, {_SEQ} AS sequence, length({_SEQ}) AS n FROM documents")
def clean(spark, sf_dir):
    return _docs(spark, sf_dir).withColumn("n", F.length("sequence").cast("long"))


@query(f"""
WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents)
SELECT doc_id, '+' AS strand, md5(s) AS digest FROM d
UNION ALL SELECT doc_id, '-', md5(reverse(translate(s, 'ACGT', 'TGCA'))) FROM d""")
def strands(spark, sf_dir):
    both = _dna(spark, sf_dir).select("doc_id", F.inline(letters.strands(F.col("dna"))))
    return both.select("doc_id", "strand", F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query(r"""
SELECT page_id, regexp_extract(url, '^[>@]?(\S*)', 1) AS id, regexp_extract(url, '([^/]*)$', 1) AS short_id,
  regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages""")
def header_parse(spark, sf_dir):
    u = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", letters.header_id(u).alias("id"), F.substring_index(u, "/", -1).alias("short_id"), F.regexp_extract(u, "^https?://([^/:?#]+)", 1).alias("host"))


_CODON_SQL = "substr('" + letters.CODONS + "', 16 * (strpos('ACGT', substr(s, i, 1)) - 1) + 4 * (strpos('ACGT', substr(s, i + 1, 1)) - 1) + strpos('ACGT', substr(s, i + 2, 1)), 1)"


@query(f"""
WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents),
sides AS (SELECT doc_id, 0 AS flip, s FROM d UNION ALL SELECT doc_id, 3, reverse(translate(s, 'ACGT', 'TGCA')) FROM d),
places AS (SELECT doc_id, flip, f, s, unnest(range(f, length(s) - 1, 3)) AS i FROM sides, (SELECT unnest([1, 2, 3]) AS f)),
made AS (SELECT doc_id, flip + f AS frame, string_agg({_CODON_SQL}, '' ORDER BY i) AS protein FROM places GROUP BY ALL)
SELECT b.doc_id, b.flip + f AS frame, md5(coalesce(m.protein, '')) AS digest
FROM sides b CROSS JOIN (SELECT unnest([1, 2, 3]) AS f) LEFT JOIN made m ON m.doc_id = b.doc_id AND m.frame = b.flip + f""")
def translate_six_frames(spark, sf_dir):
    both = _dna(spark, sf_dir).select("doc_id", F.posexplode(F.array(F.col("dna"), letters.reverse_complement(F.col("dna")))).alias("strand", "s"))
    frames = both.select("doc_id", "strand", F.posexplode(letters.translate_frames(F.col("s"))).alias("f", "protein"))
    return frames.select("doc_id", (3 * F.col("strand") + F.col("f") + 1).alias("frame"), F.md5(F.col("protein").cast("binary")).alias("digest"))


@query(f"""
WITH d AS (SELECT doc_id, {_DNA} AS s FROM documents),
made AS (SELECT doc_id, string_agg({_CODON_SQL}, '' ORDER BY i) AS protein FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1)) AS i FROM d) GROUP BY doc_id)
SELECT d.doc_id, greatest(length(s) - 2, 0) AS n, md5(coalesce(protein, '')) AS digest FROM d LEFT JOIN made USING (doc_id)""")
def translate_interleaved(spark, sf_dir):
    p = _dna(spark, sf_dir).select("doc_id", letters.translate_frames(F.col("dna"), 1, (1,))[0].alias("p"))
    return p.select("doc_id", F.length("p").cast("long").alias("n"), F.md5(F.col("p").cast("binary")).alias("digest"))


@query(f"""
WITH d AS (SELECT doc_id, {_SEQ} AS s FROM documents)
SELECT doc_id, a AS letter, length(s) - length(replace(s, a, '')) AS n FROM d, (SELECT unnest(string_split('{_AZ}', '')) AS a)""")
def composition(spark, sf_dir):
    n = F.length("sequence") - F.length(F.replace(F.col("sequence"), F.col("letter"), F.lit("")))
    return _docs(spark, sf_dir).select("*", F.explode(F.array(*map(F.lit, _AZ))).alias("letter")).select("doc_id", "letter", n.cast("long").alias("n"))


@query(f"""
WITH d AS (SELECT doc_id, {_SEQ} AS s FROM documents),
sums AS (SELECT a, sum((7 * i + 3 * a) % 11 - 6) AS t FROM (SELECT unnest(range(16)) AS i), (SELECT unnest(range(1, 27)) AS a) GROUP BY a),
parts AS (SELECT doc_id, length(s) AS n, (n - length(replace(s, chr((64 + a)::INTEGER), ''))) * t AS part FROM d, sums)
SELECT doc_id, round(coalesce(sum(part)::DOUBLE / nullif(max(n), 0), 0), 6) AS rave FROM parts GROUP BY doc_id""")
def rave(spark, sf_dir):
    sums = profile().match.sum(axis=0)
    return _docs(spark, sf_dir).select("doc_id", F.round(normalize.rave(F.col("sequence"), {c: int(sums[i + 1]) for i, c in enumerate(_AZ)}), 6).alias("rave"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[^A-Za-z-]', '', 'g'), '^-+|-+$', '', 'g') AS a FROM documents)
SELECT doc_id, md5(list_aggregate(list_transform(regexp_extract_all(a, '([A-Z]+|[a-z]+|-+)'),
  lambda r: length(r)::VARCHAR || CASE WHEN r[1] = '-' THEN 'D' WHEN r[1] BETWEEN 'a' AND 'z' THEN 'I' ELSE 'M' END), 'string_agg', '')) AS digest FROM d WHERE a <> ''""")
def cigar(spark, sf_dir):
    a = _t(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z-]", "").alias("a"))
    a = a.where(F.regexp_replace("a", "^-+|-+$", "") != "")
    return a.select("doc_id", F.md5(letters.cigar(F.col("a")).cast("binary")).alias("digest"))


@query(rf"""
WITH d AS (SELECT doc_id, {_SEQ} AS s FROM documents)
SELECT doc_id, greatest(ceil(length(s) / 60.0)::BIGINT, 1) AS n_lines, md5(rtrim(regexp_replace(s, '(.{{60}})', '\1' || chr(10), 'g'), chr(10))) AS digest FROM d""")
def wrap(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", letters.wrap(F.col("sequence")).alias("w"))
    return w.select("doc_id", F.size(F.split("w", "\n")).cast("long").alias("n_lines"), F.md5(F.col("w").cast("binary")).alias("digest"))


# patterns

PATTERN = "T-[HE]-x-[RN]"


@query(f"SELECT doc_id, len(regexp_extract_all({_SEQ}, 'TH[EA]')) AS n FROM documents")
def regex_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", patterns.regex_count(F.col("sequence"), "TH[EA]").cast("long").alias("n"))


@query(f"""
WITH d AS (SELECT doc_id, {_SEQ} AS s FROM documents),
places AS (SELECT doc_id, s, unnest(range(1, length(s) - 2)) AS i FROM d),
hits AS (SELECT doc_id, i, substr(s, i, 4) AS matched FROM places WHERE regexp_full_match(substr(s, i, 4), '[TX][HEZX].[RNBX]'))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS match_no, i AS "begin", i + 3 AS "end", matched FROM hits""")
def pattern_scan(spark, sf_dir):
    hits = patterns.scan(_docs(spark, sf_dir), patterns.to_regex(PATTERN), keep=False)
    return hits.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("match_no", "begin", "end")), "matched")


def _found(spark, sf_dir, pattern, ac):
    hits = patterns.scan(_docs(spark, sf_dir), pattern, keep=False)
    return hits.select(F.col("doc_id").alias("seq_id"), F.lit(ac).alias("motif_ac"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))


_TWO = f"""
WITH d AS (SELECT doc_id AS seq_id, {_SEQ} AS s FROM documents),
places AS (SELECT seq_id, s, unnest(range(1, length(s) + 1)) AS i FROM d),
a AS (SELECT seq_id, i AS "begin", i + 5 AS "end" FROM places WHERE regexp_full_match(substr(s, i, 6), 'TH[A-Z]{{3}}E')),
b AS (SELECT seq_id, i AS "begin", i + 3 AS "end" FROM places WHERE regexp_full_match(substr(s, i, 4), 'E[A-Z]{{2}}H'))"""


@query(_TWO + """
SELECT a.seq_id, a."begin" AS a_begin, b."begin" AS b_begin FROM a JOIN b ON a.seq_id = b.seq_id AND a."begin" + 1 <= b."end" AND a."end" - 1 >= b."begin" """)
def overlap(spark, sf_dir):
    met = postprocess.overlaps(_found(spark, sf_dir, "TH[A-Z]{3}E", "A"), _found(spark, sf_dir, "E[A-Z]{2}H", "B"), slack=1)
    return met.select("seq_id", F.col("a.begin").alias("a_begin"), F.col("b.begin").alias("b_begin"))


@query(_TWO + """
SELECT seq_id, "begin", "end", EXISTS (SELECT 1 FROM a WHERE a.seq_id = b.seq_id AND a."begin" <= b."begin" AND a."end" >= b."end") AS inside FROM b""")
def containment(spark, sf_dir):
    inner = postprocess.contained(_found(spark, sf_dir, "E[A-Z]{2}H", "B"), _found(spark, sf_dir, "TH[A-Z]{3}E", "A"))
    return inner.select("seq_id", "begin", "end", "inside")


# profiles

def _h_sql() -> str:
    """Prefilter scores of documents in DuckDB: a list of diagonal values by letter, made anew for each profile position."""
    parts = [f"h AS (SELECT doc_id, list_transform(range(1, length(s) + 1), lambda k: ascii(s[k]) - 64) AS s, []::BIGINT[] AS v, 0::BIGINT AS h FROM (SELECT doc_id, {_SEQ} AS s FROM documents))"]
    for i in range(16):
        before = "coalesce(v[k - 1], 0)" if i else "0"
        own = f"list_transform(s, lambda a, k: greatest(CASE WHEN k = 1 THEN -100 ELSE 0 END, {before} + (7 * {i} + 3 * a) % 11 - 6))"
        parts.append(f"h{i} AS (SELECT doc_id, s, {own} AS v, h + greatest(0, coalesce(list_max(v), 0)) AS h FROM {f'h{i - 1}' if i else 'h'})")
    parts.append("hs AS MATERIALIZED (SELECT doc_id, (h + greatest(0, coalesce(list_max(v), 0)))::INTEGER AS h_score FROM h15)")
    return ",\n".join(parts)


def _exact_sql() -> str:
    """Exact scores of documents in DuckDB: for each profile position a row a letter; gaps in the document by running maxima, gaps in the profile by a column carried from position to position."""
    parts = [f"x0 AS MATERIALIZED (SELECT doc_id, j, ascii(s[j]) - 64 AS a, 0::BIGINT AS m, {_NEG}::BIGINT AS d, {_NEG}::BIGINT AS best FROM (SELECT doc_id, s, unnest(range(1, length(s) + 1)) AS j FROM (SELECT doc_id, {_SEQ} AS s FROM documents)))"]
    for p in range(1, 17):
        parts.append(f"k{p} AS (SELECT doc_id, j, a, d - 2 AS kd, best, coalesce(lag(m) OVER (PARTITION BY doc_id ORDER BY j), 0) + (7 * {p - 1} + 3 * a) % 11 - 6 AS km FROM x{p - 1})")
        parts.append(f"i{p} AS (SELECT *, coalesce(max(km + 2 * j) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {_NEG}) - 9 - 2 * j AS ki FROM k{p})")
        parts.append(f"x{p} AS MATERIALIZED (SELECT doc_id, j, a, greatest(km, ki, kd, {0 if p < 16 else _NEG}) AS m, greatest(km - 9, kd) AS d, greatest(best, km) AS best FROM i{p})")
    parts.append("xs AS MATERIALIZED (SELECT d.doc_id, max(best)::INTEGER AS score FROM documents d LEFT JOIN x16 ON x16.doc_id = d.doc_id GROUP BY d.doc_id)")
    return ",\n".join(parts)


_NEG = -1000000
_H_SQL = f"WITH {_h_sql()} SELECT doc_id, h_score FROM hs"
_BOTH_SQL = f"WITH {_h_sql()},\n{_exact_sql()}"


@query(_H_SQL)
def h_score(spark, sf_dir):
    return search.with_h_score(_docs(spark, sf_dir), profile()).select("doc_id", "h_score")


@query(_H_SQL)
def h_score_folded(spark, sf_dir):
    """The prefilter score by built-in functions alone: no Python runs."""
    return search.with_folded_h_score(_docs(spark, sf_dir), profile())


@query(f"SELECT * FROM ({_H_SQL}) WHERE h_score >= {H_CUTOFF}")
def h_filter(spark, sf_dir):
    scored = search.with_h_score(_docs(spark, sf_dir), profile()).select("doc_id", "h_score")
    return scored.where(F.col("h_score") >= H_CUTOFF)


def _scored(spark, sf_dir):
    df = search.with_h_score(_docs(spark, sf_dir), profile())
    return search.with_score(df.where(F.col("h_score") >= H_CUTOFF), profile())


@query(f"WITH {_exact_sql()} SELECT doc_id, score FROM xs")
def score_exact(spark, sf_dir):
    return search.with_score(_docs(spark, sf_dir), profile()).select("doc_id", "score")


@query(f"""{_BOTH_SQL} SELECT doc_id, h_score, score, round(1.5::DOUBLE + 0.02::DOUBLE * score, 4) AS norm, CASE WHEN score >= 36 THEN 1 ELSE 0 END AS level
FROM hs JOIN xs USING (doc_id) WHERE h_score >= {H_CUTOFF} AND score >= {CUTOFF}""")
def search_cascade(spark, sf_dir):
    """Prefilter, score, normalised score and level of the documents that reach the cutoff."""
    norm = F.round(normalize.raw_to_norm("LINEAR", [1.5, 0.02], F.col("score")), 4)
    kept = _scored(spark, sf_dir).where(F.col("score") >= CUTOFF)
    return kept.select("doc_id", "h_score", "score", norm.alias("norm"), normalize.level(F.col("score"), [(-1, 26), (0, CUTOFF), (1, 36)]).alias("level"))


@query()
def search_align(spark, sf_dir):
    """All matches of two profiles, forward and reversed, in every document."""
    p = profile()
    motifs = [search.Motif(p, 34, H_CUTOFF, "RULE16"), search.Motif(p.reverse(), 34, H_CUTOFF, "RULE16R")]
    return search.search(_docs(spark, sf_dir), motifs, "doc_id")


@query()
def search_in_order(spark, sf_dir):
    """All matches of the profile in every document, accepted from left to right."""
    return search.search(_docs(spark, sf_dir), [search.Motif(profile(), 34, H_CUTOFF, "RULE16", order="sequence")], "doc_id")


@query(f"{_BOTH_SQL} SELECT count(*) AS n, count_if(h_score >= {H_CUTOFF}) AS n_heuristic, count_if(h_score >= {H_CUTOFF} AND score >= {CUTOFF}) AS n_filter FROM hs JOIN xs USING (doc_id)")
def stage_counts(spark, sf_dir):
    return search.stage_counts(_docs(spark, sf_dir), search.Motif(profile(), CUTOFF, H_CUTOFF))


@query(f"SELECT doc_id, source, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_H_SQL}) WHERE h_score >= {H_CUTOFF})")
def survivors(spark, sf_dir):
    hits = h_filter(spark, sf_dir)
    return search.survivors(_t(spark, sf_dir, "documents"), hits, "doc_id").select("doc_id", "source", "lang")


# exact scores of short sequences, the letters of page addresses: letter after letter in SQL

_URL_LETTERS = "upper(regexp_replace(url, '[^A-Za-z]', '', 'g'))"
_CELL = "(7 * (p - 1) + 3 * (ascii(s[(j + 1)::INTEGER]) - 64)) % 11 - 6"
_SCORE_SQL = f"""
RECURSIVE walk AS (
  SELECT page_id, {_URL_LETTERS} AS s, 0::BIGINT AS j, list_transform(range(0, 17), lambda p: CASE WHEN p < 16 THEN 0 ELSE {_NEG} END::BIGINT) AS m,
    list_transform(range(0, 17), lambda p: {_NEG}::BIGINT) AS i, {_NEG}::BIGINT AS best FROM pages
  UNION ALL
  SELECT page_id, s, j + 1, list_transform(range(0, 17), lambda p: greatest(km[p + 1], ki[p + 1], kd[p + 1], CASE WHEN p < 16 THEN 0 ELSE {_NEG} END)),
    list_transform(range(0, 17), lambda p: greatest(km[p + 1] - 9, ki[p + 1])), greatest(best, list_max(km))
  FROM (SELECT *, list_transform(range(0, 17), lambda p: coalesce(list_max(list_transform(range(1, p), lambda q: km[q + 1] - 9 - 2 * (p - q))), {_NEG})) AS kd
    FROM (SELECT *, list_transform(range(0, 17), lambda p: CASE WHEN p = 0 THEN {_NEG} ELSE m[p] + {_CELL} END) AS km, list_transform(i, lambda x: x - 2) AS ki
      FROM walk WHERE j < length(s)))),
exact AS (SELECT page_id, nullif(best, {_NEG})::INTEGER AS score FROM walk WHERE j = length(s)),
d AS (SELECT page_id, {_URL_LETTERS} AS s FROM pages),
cells AS (SELECT page_id, j, i, (7 * i + 3 * (ascii(substr(s, (j + 1)::INTEGER, 1)) - 64)) % 11 - 6 AS c
  FROM (SELECT page_id, s, unnest(range(length(s))) AS j FROM d), (SELECT unnest(range(16)) AS i)),
run AS (SELECT page_id, i, j, sum(c) OVER (PARTITION BY page_id, j - i ORDER BY j) AS p FROM cells),
low AS (SELECT page_id, i, j, p, min(CASE WHEN j > 0 THEN p END) OVER (PARTITION BY page_id, j - i ORDER BY j) AS r FROM run),
top AS (SELECT page_id, i, greatest(0, max(CASE WHEN j = 0 THEN p ELSE p - least(0, r) END)) AS v FROM low GROUP BY page_id, i),
scored AS (SELECT e.page_id, score, coalesce((SELECT sum(v) FROM top t WHERE t.page_id = e.page_id), 0)::INTEGER AS h_score FROM exact e)"""


def _urls(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", letters.clean(F.col("url")).alias("sequence"))


@query(f"WITH {_SCORE_SQL} SELECT page_id, '+' AS strand, h_score, score FROM scored")
def score_dump(spark, sf_dir):
    return search.score_dump(_urls(spark, sf_dir), profile(), "page_id")


@query(f"WITH {_SCORE_SQL} SELECT 'RULE16' AS motif_ac, page_id, h_score, score AS raw_score FROM scored WHERE h_score >= 90 AND score >= 14")
def url_search(spark, sf_dir):
    """One motif, prefilter and score, no alignment."""
    hits = search.search(_urls(spark, sf_dir), [search.Motif(profile(), 14, 90, "RULE16")], "page_id", align=False)
    return hits.select("motif_ac", "page_id", "h_score", "raw_score")


@query(f"WITH {_SCORE_SQL} SELECT count(*) AS n, count_if(h_score >= 90) AS n_heuristic, count_if(h_score >= 90 AND score >= 14) AS n_filter FROM scored")
def url_stage_counts(spark, sf_dir):
    return search.stage_counts(_urls(spark, sf_dir), search.Motif(profile(), 14, 90))


@query(f"""WITH {_SCORE_SQL}, both_ AS (SELECT page_id, 'RULE16' AS ac, score AS v FROM scored UNION ALL SELECT page_id, 'LENGTH', length(s)::INTEGER FROM d)
SELECT page_id, min_by(ac, (-v, ac)) AS family, max(v) AS raw_score FROM both_ WHERE v IS NOT NULL GROUP BY page_id""")
def family_of_url(spark, sf_dir):
    """The better of two families: the profile's score against one point a letter."""
    scored = search.score_dump(_urls(spark, sf_dir), profile(), "page_id").select("page_id", F.lit("RULE16").alias("motif_ac"), F.col("score").alias("raw_score"))
    plain = _urls(spark, sf_dir).select("page_id", F.lit("LENGTH").alias("motif_ac"), F.length("sequence").alias("raw_score"))
    return search.best_family(scored.unionByName(plain).where("raw_score IS NOT NULL"), "page_id")


# motifs as rows: three of the rule's profiles, each shifted by some score

_SHIFTS = (0, 4, 7)
_SHIFTED_SQL = (
    _SCORE_SQL[: _SCORE_SQL.index(",\nd AS (")].replace("SELECT page_id, ", "SELECT page_id, sh, ").replace("FROM pages", f"FROM pages, (SELECT unnest({list(_SHIFTS)}) AS sh)")
    .replace("(7 * (p - 1) + 3 *", "(7 * (p - 1) + sh + 3 *")
)


def _motif_rows(spark):
    rows = []
    for shift in _SHIFTS:
        p = profile()
        match = (p.match + 6 + shift) % 11 - 6
        match[:, 0] = -6
        own = kernels.linear(match, _AZ, open_gap=-9, extend=-2)
        cut = {"level": 0, "score": 16, "h_score": None, "n_score": [8.5], "mode": [1], "text": "!"}
        rows.append((f"M{shift}", motifs.serialize(motifs.Entry(id=f"R{shift}", ac=f"M{shift}", type="MATRIX", profile=own, cutoffs=[cut]))))
    return spark.createDataFrame(rows, "ac string, text string")


@query(f"WITH {_SHIFTED_SQL} SELECT 'M' || sh AS motif_ac, page_id, score AS raw_score FROM exact WHERE score >= 16")
def motif_table_search(spark, sf_dir):
    """Page addresses searched with a table of motifs: the scores that reach the cutoff."""
    hits = tables.search_table(_urls(spark, sf_dir), _motif_rows(spark), "page_id", align=False)
    return hits.select("motif_ac", "page_id", "raw_score")


@query(f"WITH {_SHIFTED_SQL} SELECT 'M' || sh AS motif_ac, page_id, score AS best FROM exact WHERE score >= 16")
def lateral_matches(spark, sf_dir):
    """The same by SQL: a table function gives the matches, of which the best score is the exact one."""
    tables.register(spark)
    return spark.sql("SELECT m.motif_ac, u.page_id, max(m.raw_score) AS best FROM {motifs} t JOIN {urls} u ON u.sequence <> '', LATERAL motif_matches(u.sequence, t.text, 0) m GROUP BY ALL", motifs=_motif_rows(spark), urls=_urls(spark, sf_dir))


@query(f"""
WITH d AS (SELECT page_id, {_URL_LETTERS} AS s FROM pages), places AS (SELECT page_id, s, unnest(range(1, length(s) - 2)) AS i FROM d)
SELECT page_id, i AS "begin", substr(s, i, 4) AS matched FROM places WHERE regexp_full_match(substr(s, i, 4), '[TX][HEZX].[RNBX]')""")
def lateral_patterns(spark, sf_dir):
    tables.register(spark)
    return spark.sql("SELECT u.page_id, CAST(m.begin AS BIGINT) AS begin, m.matched FROM {urls} u, LATERAL pattern_matches(u.sequence, '" + PATTERN + "') m", urls=_urls(spark, sf_dir))


# a circular profile: the state after its last position is also that before its first

_TURNS_SQL = f"""
WITH RECURSIVE walk AS (
  SELECT page_id, {_URL_LETTERS} AS s, 0::BIGINT AS j, list_transform(range(0, 9), lambda p: CASE WHEN p < 8 THEN 0 ELSE {_NEG} END::BIGINT) AS m,
    list_transform(range(0, 9), lambda p: {_NEG}::BIGINT) AS i, {_NEG}::BIGINT AS best FROM pages
  UNION ALL
  SELECT page_id, s, j + 1, list_transform(range(0, 9), lambda p: CASE WHEN p = 0 THEN greatest(mm[1], mm[9]) ELSE greatest(mm[p + 1], dl - 2 * p) END),
    list_transform(range(0, 9), lambda p: CASE WHEN p = 0 THEN greatest(ii[1], ii[9]) ELSE ii[p + 1] END), greatest(best, list_max(km))
  FROM (SELECT *, greatest(km[9] - 9, kd[9]) AS dl, list_transform(range(0, 9), lambda p: greatest(km[p + 1], ki[p + 1], kd[p + 1], CASE WHEN p < 8 THEN 0 ELSE {_NEG} END)) AS mm,
      list_transform(range(0, 9), lambda p: greatest(km[p + 1] - 9, ki[p + 1])) AS ii
    FROM (SELECT *, list_transform(range(0, 9), lambda p: coalesce(list_max(list_transform(range(1, p), lambda q: km[q + 1] - 9 - 2 * (p - q))), {_NEG})) AS kd
      FROM (SELECT *, list_transform(range(0, 9), lambda p: CASE WHEN p = 0 THEN {_NEG} ELSE m[p] + {_CELL} END) AS km, list_transform(i, lambda x: x - 2) AS ki
        FROM walk WHERE j < length(s)))))
SELECT page_id, nullif(best, {_NEG})::INTEGER AS score FROM walk WHERE j = length(s)"""


def _circular():
    return dataclasses.replace(profile(8), circular=True, name="TURN8")


@query(_TURNS_SQL)
def circular_score(spark, sf_dir):
    """Best scores of page addresses by a profile of eight positions whose end joins its begin."""
    return search.with_score(_urls(spark, sf_dir), _circular()).select("page_id", "score")


@query(f"SELECT page_id, score AS raw_score FROM ({_TURNS_SQL}) WHERE score >= 24")
def circular_turns(spark, sf_dir):
    """The best match of each address that reaches the cutoff, by its turns put together."""
    hits = search.search(_urls(spark, sf_dir), [search.Motif(_circular(), 24, None, "TURN8", unique=True)], "page_id", repeats=True)
    turns = postprocess.unroll(hits).groupBy("page_id").agg(F.max("raw_score").alias("raw_score"), F.min("begin").alias("low"), F.max("end").alias("high"))
    same = hits.join(turns.withColumnRenamed("raw_score", "of_turns"), "page_id").where("low = begin AND high = end AND raw_score = of_turns")
    return same.select("page_id", "raw_score")


# strings


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(url, '[^A-Za-z-]', '', 'g') AS a FROM pages), u AS (SELECT page_id, upper(replace(a, '-', '')) AS u FROM a)
SELECT page_id, u AS ungapped, substr(repeat('IIIIHHHHGGGG', 40), 1, length(u)) AS quality, substr(substr(repeat('IIIIHHHHGGGG', 40), 1, length(u)), 3, 7) AS part,
  length(u) - 9 + 1 AS flip_begin, length(u) - 3 + 1 AS flip_end FROM u""")
def aligned_parts(spark, sf_dir):
    u = _t(spark, sf_dir, "pages").select("page_id", letters.ungapped(F.regexp_replace("url", "[^A-Za-z-]", "")).alias("ungapped"))
    q = letters.periodic_quality(F.length("ungapped"))
    begin, end = letters.flip(F.lit(3), F.lit(9), F.length("ungapped"))
    return u.select("page_id", "ungapped", q.alias("quality"), letters.quality_slice(q, F.lit(3), F.lit(9)).alias("part"), begin.cast("long").alias("flip_begin"), end.cast("long").alias("flip_end"))


@query(r"""
WITH h AS (SELECT regexp_extract(url, '^https?://([^/:?#]+)', 1) AS header, upper(regexp_replace(url, '[^A-Za-z]', '', 'g')) AS s FROM pages)
SELECT header, md5(string_agg(reverse(translate(s, 'ACGT', 'TGCA')), '' ORDER BY reverse(translate(s, 'ACGT', 'TGCA')) COLLATE "C")) AS digest FROM h GROUP BY header""".replace(' COLLATE "C"', ""))
def merged_library(spark, sf_dir):
    lib = _t(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("header"), F.translate(letters.clean(F.col("url")), "ACGT", "TGCA").alias("sequence"))
    return sequences.sorted_library(lib, reverse=True).select("header", F.md5(F.col("sequence").cast("binary")).alias("digest"))


# alignments: page addresses as rows of one alignment, a row's weight by its page


@query(r"""
WITH r AS (SELECT page_id, (page_id % 4 + 1)::DOUBLE AS w, regexp_replace(upper(url), '[^A-Z]', '-', 'g') AS a FROM pages),
c AS (SELECT page_id, w, unnest(range(1, length(a) + 1)) AS col, a FROM r), l AS (SELECT page_id, w, col, a[col::INTEGER] AS symbol FROM c),
per AS (SELECT col, sum(w) AS covered, sum(CASE WHEN symbol = 'X' THEN w ELSE 0 END) AS unknown, sum(CASE WHEN symbol = '-' THEN w ELSE 0 END) AS gaps FROM l GROUP BY col)
SELECT l.col, symbol, round(sum(w) / (any_value(covered) - any_value(unknown)), 9) AS freq, round(any_value(gaps) / any_value(covered), 9) AS gap FROM l JOIN per ON l.col = per.col WHERE symbol NOT IN ('-', 'X') GROUP BY l.col, symbol""")
def column_frequencies(spark, sf_dir):
    rows = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("seq_id"), (F.col("page_id") % 4 + 1).cast("double").alias("weight"), F.posexplode(F.split(F.regexp_replace(F.upper("url"), "[^A-Z]", "-"), "")).alias("at", "symbol"))
    freqs = build.column_frequencies(rows.where("symbol != ''").withColumn("col", F.col("at") + 1).drop("at"))
    return freqs.select(F.col("col").cast("long").alias("col"), "symbol", F.round("freq", 9).alias("freq"), F.round("gap", 9).alias("gap"))


@query("""
WITH d AS (SELECT s_suppkey AS cand_id, page_id, len(list_filter(range(1, 33), lambda k: substr(md5(s_name), k, 1) <> substr(md5(url), k, 1))) AS distance FROM supplier, pages),
m AS (SELECT *, min(distance) OVER (PARTITION BY cand_id) AS least FROM d)
SELECT cand_id, least AS distance, count(*) AS ties, min(page_id) AS page_id FROM m WHERE distance = least GROUP BY ALL""")
def nearest_rows(spark, sf_dir):
    """For each supplier the pages whose address digests differ from its name's in the fewest digits."""
    cands = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cand_id"), F.md5(F.col("s_name").cast("binary")).alias("aligned"))
    rows = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("seq_id"), F.md5(F.col("url").cast("binary")).alias("aligned"))
    return build.nearest(cands, rows).select("cand_id", "distance", F.size("seq_ids").cast("long").alias("ties"), F.array_min("seq_ids").alias("page_id"))


# normalisation and levels

_R = (240.0, -0.02, 0.3, 1.2, 0.35)


@query("""
WITH s AS (SELECT l_orderkey, l_linenumber, floor(l_extendedprice / 10)::INTEGER AS raw, l_partkey AS n, l_quantity AS ave FROM lineitem)
SELECT l_orderkey, l_linenumber, round(1.5::DOUBLE + 0.02::DOUBLE * raw, 4) AS linear,
  round((raw / (240.0 * (1 - exp(-0.02 * n - 0.3))) - 1.2) / 0.35, 4) AS zscore,
  round(((raw - ave) / (240.0 * (1 - exp(-0.02 * n - 0.3))) - 1.2) / 0.35, 4) AS zscave FROM s""".replace("240.0", "240.0::DOUBLE"))
def raw_to_norm(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_extendedprice") / 10).cast("int").alias("raw"), F.col("l_partkey").alias("n"), F.col("l_quantity").alias("ave"))
    f = normalize.raw_to_norm
    raw, n, ave = F.col("raw"), F.col("n"), F.col("ave")
    return s.select("l_orderkey", "l_linenumber", F.round(f("LINEAR", [1.5, 0.02], raw), 4).alias("linear"), F.round(f("GRIBSKOV", _R, raw, n), 4).alias("zscore"), F.round(f("GLE_ZSCAVE", _R, raw, n, ave), 4).alias("zscave"))


@query("""
SELECT l_orderkey, l_linenumber, floor((l_quantity - 1.5) / 0.02 + 0.5)::INTEGER AS linear,
  ceil(240.0::DOUBLE * (1 - exp(-0.02 * l_partkey - 0.3)) * (0.35 * l_quantity + 1.2))::INTEGER AS zscore FROM lineitem""")
def norm_to_raw(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_partkey")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", normalize.norm_to_raw("LINEAR", [1.5, 0.02], q).alias("linear"), normalize.norm_to_raw("GLE_ZSCORE", _R, q, n, rounding="ceil").alias("zscore"))


@query("""
SELECT o_orderkey, CASE WHEN o_totalprice >= 300000 THEN 1 WHEN o_totalprice >= 150000 THEN 0 WHEN o_totalprice >= 50000 THEN -1 ELSE -2 END AS level,
  CASE WHEN o_totalprice >= 50000 THEN -1 WHEN o_totalprice >= 150000 THEN 0 WHEN o_totalprice >= 300000 THEN 1 ELSE 0 END AS level_by_file,
  CASE WHEN o_totalprice >= 300000 THEN '!!' WHEN o_totalprice >= 150000 THEN '!' WHEN o_totalprice >= 50000 THEN '?' ELSE '#' END AS level_tag,
  CASE WHEN o_totalprice >= 300000 THEN '!!' WHEN o_totalprice >= 50000 THEN '?' ELSE '#' END AS mode_tag FROM orders""")
def levels(spark, sf_dir):
    s, cuts = F.col("o_totalprice"), [(-1, 50000), (0, 150000), (1, 300000)]
    return _t(spark, sf_dir, "orders").select("o_orderkey", normalize.level(s, cuts).alias("level"), normalize.level(s, cuts, "file_order").alias("level_by_file"), normalize.level_tag(s, [(50000, "?"), (150000, "!"), (300000, "!!")]).alias("level_tag"), normalize.level_tag(s, [(50000, "?", [1]), (150000, "!", [2]), (300000, "!!", [1, 2])], 1).alias("mode_tag"))


# rules on hits: the lines of an order as hits in a sequence; scores are in 1024ths, so that sums are exact in any order

_HITS = """
WITH hits AS (SELECT l_orderkey AS seq_id, 'M' || (l_suppkey % 4)::VARCHAR AS motif_ac, l_partkey % 100 AS "begin", l_partkey % 100 + l_quantity::BIGINT AS "end",
  floor(l_extendedprice) / 1024 AS norm, ((l_partkey + l_linenumber) % 4 - 2)::INTEGER AS level, '#' AS level_tag FROM lineitem)"""


def _hits(spark, sf_dir):
    begin = F.col("l_partkey") % 100
    return _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"), F.concat(F.lit("M"), (F.col("l_suppkey") % 4).cast("string")).alias("motif_ac"), begin.alias("begin"), (begin + F.col("l_quantity").cast("long")).alias("end"),
        (F.floor("l_extendedprice") / 1024).alias("norm"), ((F.col("l_partkey") + F.col("l_linenumber")) % 4 - 2).cast("int").alias("level"), F.lit("#").alias("level_tag"),
    )


_BY = "OVER (PARTITION BY seq_id)"
_REST = 'seq_id, motif_ac, "begin", "end", norm'


@query(_HITS + f"""
, t AS (SELECT *, max(CASE WHEN motif_ac = 'M1' THEN level END) {_BY} >= 0 AND motif_ac = 'M0' AND level < 0 AS up FROM hits)
SELECT {_REST}, level + CASE WHEN up THEN 1 ELSE 0 END AS level, CASE WHEN up THEN 'PROMOTED_BY_M1' ELSE level_tag END AS level_tag FROM t""")
def promoted_by(spark, sf_dir):
    return postprocess.promoted_by(_hits(spark, sf_dir), "M0", "M1")


@query(_HITS + f"""
, t AS (SELECT *, motif_ac = 'M2' AND level >= 0 AND coalesce(max(CASE WHEN motif_ac = 'M3' THEN level END) {_BY} >= 0, false) AS down FROM hits)
SELECT {_REST}, CASE WHEN down THEN level - 1 ELSE level END AS level, CASE WHEN down THEN 'DEMOTED' ELSE level_tag END AS level_tag FROM t""")
def demoted_by(spark, sf_dir):
    return postprocess.demoted_by(_hits(spark, sf_dir), "M2", "M3")


@query(_HITS + f"""
SELECT {_REST}, level, CASE WHEN motif_ac = 'M0' THEN CASE WHEN EXISTS (SELECT 1 FROM hits e WHERE e.seq_id = h.seq_id AND e.motif_ac = 'M1' AND e.level >= 0 AND e."begin" <= h."begin" AND e."end" >= h."end")
  THEN '(0)' ELSE '(-1)' END ELSE level_tag END AS level_tag FROM hits h""")
def evaluated_by(spark, sf_dir):
    return postprocess.evaluated_by(_hits(spark, sf_dir), "M0", "M1")


@query(_HITS + f"""
, n AS (SELECT *, row_number() OVER () AS id FROM hits),
met AS (SELECT a.id AS a, b.id AS b, a.norm AS an, b.norm AS bn FROM n a JOIN n b ON a.seq_id = b.seq_id AND a.motif_ac = 'M0' AND b.motif_ac = 'M1'
  AND a."begin" + 2 <= a."end" - 2 AND a."begin" + 2 <= b."end" AND a."end" - 2 >= b."begin"),
lost AS (SELECT CASE WHEN an < bn THEN a ELSE b END AS id, CASE WHEN an < bn THEN 'M1' ELSE 'M0' END AS rival, count(*) AS k FROM met WHERE an <> bn GROUP BY 1, 2)
SELECT {_REST}, (level - coalesce(k, 0))::INTEGER AS level, CASE WHEN k > 0 THEN 'OUTCOMPETED_HIT_BY_' || rival ELSE level_tag END AS level_tag FROM n LEFT JOIN lost USING (id)""")
def competes_hit(spark, sf_dir):
    return postprocess.competes_hit_with(_hits(spark, sf_dir), "M0", "M1", slack=2)


@query(_HITS + f"""
, t AS (SELECT *, max(CASE WHEN motif_ac = 'M0' THEN norm END) {_BY} AS a, max(CASE WHEN motif_ac = 'M1' THEN norm END) {_BY} AS b FROM hits),
x AS (SELECT *, CASE WHEN motif_ac = 'M0' AND a <= b THEN 'M1' WHEN motif_ac = 'M1' AND b < a THEN 'M0' END AS rival FROM t)
SELECT {_REST}, CASE WHEN rival IS NULL THEN level ELSE level - 1 END AS level, CASE WHEN rival IS NULL THEN level_tag ELSE 'OUTCOMPETED_SEQ_BY_' || rival END AS level_tag FROM x""")
def competes_seq(spark, sf_dir):
    return postprocess.competes_seq_with(_hits(spark, sf_dir), "M0", "M1")


@query(_HITS + f"""
, t AS (SELECT *, coalesce(motif_ac = 'M0' AND level < 0 AND count_if(motif_ac = 'M0') {_BY} > 1 AND max(CASE WHEN motif_ac = 'M1' THEN norm END) {_BY} >= 30, false) AS up FROM hits)
SELECT {_REST}, CASE WHEN up THEN level + 1 ELSE level END AS level, CASE WHEN up THEN 'PROMOTED_REPEAT' ELSE level_tag END AS level_tag FROM t""")
def promote_repeat(spark, sf_dir):
    return postprocess.promote_repeat(_hits(spark, sf_dir), "M0", "M1", 30)


@query(_HITS + f"""
SELECT {_REST}, CASE WHEN up OR more THEN level + 1 ELSE level END AS level, CASE WHEN up THEN 'R' WHEN more THEN 'r' ELSE level_tag END AS level_tag FROM (
  SELECT *, motif_ac = 'M0' AND level < 0 AND top >= 0 AS up, motif_ac = 'M0' AND level < 0 AND top < 0 AND total >= 60 AS more FROM (
    SELECT *, max(CASE WHEN motif_ac = 'M0' THEN level END) {_BY} AS top, sum(CASE WHEN motif_ac = 'M0' THEN norm END) {_BY} AS total FROM hits))""")
def repeat_domain(spark, sf_dir):
    return postprocess.repeat_domain(_hits(spark, sf_dir), "M0", 60)


@query(_HITS + f"""
SELECT {_REST}, CASE WHEN up OR more THEN level + 1 ELSE level END AS level, CASE WHEN up THEN '?R' WHEN more THEN '?r' ELSE level_tag END AS level_tag FROM (
  SELECT *, motif_ac = 'M1' AND level < 0 AND top >= 0 AS up, motif_ac = 'M1' AND level < 0 AND top < 0 AND total >= 40 AS more FROM (
    SELECT *, max(CASE WHEN motif_ac = 'M1' THEN level END) {_BY} AS top, sum(CASE WHEN motif_ac = 'M1' THEN norm END) {_BY} AS total FROM hits))""")
def repeat_domain_every(spark, sf_dir):
    """The rule that a '!' cutoff asks for when all profiles are taken as repeats."""
    cutoffs = [{"level": -1, "n_score": [15.0], "text": "'?'"}, {"level": 0, "n_score": [25.0], "text": "'!'"}]
    return postprocess.apply(_hits(spark, sf_dir), postprocess.implicit_rules("M1", cutoffs, every=True))


_BUMP = "(CASE WHEN ({x}) = {m}.mid THEN 1.0::DOUBLE ELSE (sin(2 * pi() * (({x}) - {m}.mid) / {m}.w) / (2 * pi() * (({x}) - {m}.mid) / {m}.w)) ** 2 END * {m}.raw / 100000)"


@query(_HITS.replace("AS norm", "AS norm, l_extendedprice AS raw") + """
, own AS (SELECT row_number() OVER () AS id, seq_id, "begin", "end", level, raw, ("end" - "begin" + 1) AS w, ("end" - "begin" + 1) / 2.0 + "begin" AS mid FROM hits WHERE motif_ac = 'M0'),
cutup AS (SELECT *, CASE WHEN mid - lag(mid) OVER o > 30 OR lag(mid) OVER o IS NULL THEN 1 ELSE 0 END AS s FROM own WINDOW o AS (PARTITION BY seq_id ORDER BY "begin", "end")),
isle AS (SELECT *, sum(s) OVER (PARTITION BY seq_id ORDER BY "begin", "end") AS isle FROM cutup),
placed AS (SELECT *, row_number() OVER o AS g, count(*) OVER (PARTITION BY seq_id, isle) AS n,
  first("begin") OVER o AS low, last("end") OVER (PARTITION BY seq_id, isle ORDER BY "begin", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS high FROM isle WINDOW o AS (PARTITION BY seq_id, isle ORDER BY "begin", "end")),
paired AS (SELECT m.seq_id, m.isle, m.low, m.high, m.mid AS m_mid, m.w AS m_w, m.raw AS m_raw, p.mid AS p_mid, p.w AS p_w, p.raw AS p_raw, CASE WHEN m.g = 1 THEN 1 ELSE -1 END AS k
  FROM placed m JOIN placed p ON m.seq_id = p.seq_id AND m.isle = p.isle AND p.g = CASE WHEN m.g = 1 THEN 2 ELSE m.g - 1 END),
walked AS (SELECT *, unnest(range(low, high + 1)) AS x FROM paired),
sums AS (SELECT seq_id, isle, x, low, high, sum(BUMPM) AS y, sum(BUMPP) AS yk FROM walked GROUP BY ALL),
areas AS (SELECT seq_id, isle, sum(y * yk * CASE WHEN x = low OR x = high THEN 0.5 ELSE 1 END) AS area FROM sums GROUP BY ALL)
SELECT i.seq_id, i."begin", i."end", (CASE WHEN level >= 0 THEN level WHEN area > 0.5 THEN 0 ELSE -2 END)::INTEGER AS level,
  CASE WHEN level >= 0 THEN '#' WHEN area > 0.5 THEN 'PROMOTED_FTREP' ELSE 'DEMOTED_FTREP' END AS level_tag
FROM isle i LEFT JOIN areas a ON a.seq_id = i.seq_id AND a.isle = i.isle"""
    .replace("BUMPM", _BUMP.format(x="x", m="m").replace("m.", "m_")).replace("BUMPP", _BUMP.format(x="x + 20 * k", m="p").replace("p.", "p_")))
def flank_repeats(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    none = F.lit(None).cast("int")
    begin = F.col("l_partkey") % 100
    hits = line.select(F.col("l_orderkey").alias("seq_id"), F.concat(F.lit("M"), (F.col("l_suppkey") % 4).cast("string")).alias("motif_ac"), begin.alias("begin"), (begin + F.col("l_quantity").cast("long")).alias("end"), none.alias("pf_begin"), none.alias("pf_end"), F.col("l_extendedprice").alias("raw"), F.lit(0.0).alias("norm"), ((F.col("l_partkey") + F.col("l_linenumber")) % 4 - 2).cast("int").alias("level"), F.lit("#").alias("level_tag"))
    judged = postprocess.flank_repeats(hits.where("motif_ac = 'M0'"), "M0", 100000, 0.5, 20, 1.5)
    return judged.select("seq_id", "begin", "end", "level", "level_tag")


@query(_HITS + """
, m AS (SELECT *, ("begin" + "end") / 2 AS mid FROM hits),
f AS (SELECT *, CASE WHEN mid - lag(mid) OVER w > 20 OR lag(mid) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM m WINDOW w AS (PARTITION BY seq_id, motif_ac ORDER BY "begin", "end"))
SELECT seq_id, motif_ac, "begin", "end", sum(s) OVER (PARTITION BY seq_id, motif_ac ORDER BY "begin", "end") AS island FROM f""".replace("/ 2 AS", "/ 2.0 AS"))
def islands(spark, sf_dir):
    return postprocess.islands(_hits(spark, sf_dir), 20).select("seq_id", "motif_ac", "begin", "end", "island")


@query(_HITS + """
SELECT seq_id, motif_ac, max(norm) AS best, sum(norm) AS total, count(*) AS n FROM hits GROUP BY ALL""")
def motif_totals(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("seq_id", "motif_ac").agg(F.max("norm").alias("best"), F.sum("norm").alias("total"), F.count("*").alias("n"))


@query(_HITS + "SELECT motif_ac, count(*) AS n_hits, count(DISTINCT seq_id) AS n_sequences FROM hits GROUP BY motif_ac")
def match_list(spark, sf_dir):
    return _hits(spark, sf_dir).groupBy("motif_ac").agg(F.count("*").alias("n_hits"), F.countDistinct("seq_id").alias("n_sequences"))


@query(_HITS + f"""
, v AS (SELECT *, count(*) OVER (PARTITION BY seq_id, motif_ac) AS n FROM hits WHERE level >= 0)
SELECT {_REST}, level, level_tag FROM v WHERE n >= 2""")
def visible(spark, sf_dir):
    return postprocess.visible(_hits(spark, sf_dir), 0, min_hits=2)


@query(_HITS + """
SELECT seq_id, "begin", "end", norm, max("end") OVER (PARTITION BY seq_id ORDER BY "begin", "end", norm ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM hits""")
def running_end(spark, sf_dir):
    w = W.partitionBy("seq_id").orderBy("begin", "end", "norm").rowsBetween(W.unboundedPreceding, -1)
    return _hits(spark, sf_dir).select("seq_id", "begin", "end", "norm", F.max("end").over(w).alias("reached"))


@query(_HITS + """
SELECT * FROM (SELECT seq_id, motif_ac FROM hits WHERE level >= 0 EXCEPT ALL SELECT seq_id, motif_ac FROM hits WHERE level < 0)
UNION ALL SELECT * FROM (SELECT seq_id, motif_ac FROM hits WHERE level < 0 EXCEPT ALL SELECT seq_id, motif_ac FROM hits WHERE level >= 0)""")
def result_difference(spark, sf_dir):
    h = _hits(spark, sf_dir).select("seq_id", "motif_ac", "level")
    a, b = h.where("level >= 0").drop("level"), h.where("level < 0").drop("level")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


@query("""
WITH RECURSIVE links AS (SELECT n_nationkey AS a, n_regionkey AS b FROM nation),
r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
SELECT a AS target_ac, b AS effector_ac FROM r""")
def motif_closure(spark, sf_dir):
    return postprocess.closure(_t(spark, sf_dir, "nation"), "n_nationkey", "n_regionkey").toDF("target_ac", "effector_ac")


@query("""
WITH RECURSIVE links AS (SELECT s_suppkey AS a, s_suppkey // 2 AS b FROM supplier WHERE s_suppkey > 1),
r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)
SELECT a AS target_ac, b AS effector_ac FROM r""")
def motif_closure_deep(spark, sf_dir):
    """Suppliers linked to the one of half their number, over as many steps as that takes."""
    links = _t(spark, sf_dir, "supplier").where("s_suppkey > 1").select("s_suppkey", F.floor(F.col("s_suppkey") / 2).alias("half"))
    return postprocess.closure(links, "s_suppkey", "half").toDF("target_ac", "effector_ac")


@query("""
WITH e AS (SELECT user_id, epoch(ts) AS x, value AS y, event_id FROM events),
p AS (SELECT user_id, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS part FROM e WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id))
SELECT user_id, round(coalesce(sum(part), 0), 1) AS area FROM p GROUP BY user_id""")
def trapezoid(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("x"), "event_id", F.col("value").alias("y"))
    return postprocess.trapezoid(e, "x", "y", ["user_id"], ties="event_id").withColumn("area", F.round("area", 1))


_TAGGED = _HITS.replace("'#' AS level_tag", "CASE (l_partkey + l_linenumber) % 5 WHEN 0 THEN '(0)' ELSE '(-1)' END AS level_tag")


@query(_TAGGED + """
SELECT seq_id, motif_ac, "begin", "end", CASE WHEN bool_or(level_tag = '(0)') OVER (PARTITION BY seq_id, motif_ac) THEN '(0)' ELSE level_tag END AS level_tag FROM hits""")
def any_evaluated(spark, sf_dir):
    tag = F.when((F.col("l_partkey") + F.col("l_linenumber")) % 5 == 0, "(0)").otherwise("(-1)")
    begin = F.col("l_partkey") % 100
    hits = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq_id"), F.concat(F.lit("M"), (F.col("l_suppkey") % 4).cast("string")).alias("motif_ac"), begin.alias("begin"), (begin + F.col("l_quantity").cast("long")).alias("end"), tag.alias("level_tag"))
    return postprocess.any_evaluated(hits)


@query(_HITS + """
SELECT seq_id, h.motif_ac, "begin", "end", r_name AS motif_id FROM hits h LEFT JOIN region ON h.motif_ac = 'M' || (r_regionkey + 1)::VARCHAR""")
def hit_metadata(spark, sf_dir):
    meta = _t(spark, sf_dir, "region").select(F.concat(F.lit("M"), (F.col("r_regionkey") + 1).cast("string")).alias("ac"), F.col("r_name").alias("id"))
    return postprocess.with_metadata(_hits(spark, sf_dir), meta, ["id"]).select("seq_id", "motif_ac", "begin", "end", "motif_id")


# calibration: prices as scores


@query("SELECT floor(o_totalprice / 1000)::BIGINT AS bin, count(*) AS n FROM orders GROUP BY 1")
def histogram(spark, sf_dir):
    return calibrate.histogram(_t(spark, sf_dir, "orders"), "o_totalprice", 1000)


@query("SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max, round(avg(l_extendedprice), 4) AS avg, count(*) AS n FROM lineitem")
def score_statistics(spark, sf_dir):
    return calibrate.statistics(_t(spark, sf_dir, "lineitem"), "l_extendedprice").withColumn("avg", F.round("avg", 4))


@query(f"SELECT count(*) AS records, sum(length({_SEQ})) AS residues, round(avg(length({_SEQ})), 4) AS mean_length, max(length({_SEQ})) AS longest FROM documents")
def library_statistics(spark, sf_dir):
    return calibrate.library_statistics(_docs(spark, sf_dir)).withColumn("mean_length", F.round("mean_length", 4))


@query("""
WITH r AS (SELECT floor(l_extendedprice) AS s, row_number() OVER (ORDER BY floor(l_extendedprice) DESC) AS k FROM lineitem),
p AS (SELECT s, log10(1e8) - log10(k - 0.5) AS y, k / 2.0 AS w FROM r),
u AS (SELECT * FROM p WHERE y >= 4 AND y <= 6),
a AS (SELECT sum(w) AS w, sum(w * s) AS s, sum(w * y) AS y, sum(w * s * s) AS ss, sum(w * s * y) AS sy, count(*) AS used FROM u),
b AS (SELECT *, (sy - s * y / w) / (ss - s * s / w) AS r2 FROM a)
SELECT round(y / w - r2 * s / w, 4) AS r1, round(r2 * 1000, 6) AS r2, used FROM b""")
def rank_regression(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").select(F.floor("l_extendedprice").cast("double").alias("s"))
    return calibrate.rank_regression(s, "s", residues=1e8).select(F.round("r1", 4).alias("r1"), F.round(F.col("r2") * 1000, 6).alias("r2"), "used")


@query("SELECT min(s) AS cut FROM (SELECT o_totalprice AS s FROM orders ORDER BY s DESC LIMIT 500)")
def tail_cut(spark, sf_dir):
    return calibrate.tail_cut(_t(spark, sf_dir, "orders"), "o_totalprice", 500)


@query("SELECT o_orderkey, round(1 - exp(-exp(-2e-5 * (o_totalprice - 150000))), 9) AS p, round(1e6 * (1 - exp(-exp(-2e-5 * (o_totalprice - 150000)))), 3) AS e FROM orders")
def extreme_values(spark, sf_dir):
    x = F.col("o_totalprice")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(calibrate.evd_p(x, 150000, 2e-5), 9).alias("p"), F.round(calibrate.evd_e(x, 150000, 2e-5, 1e6), 3).alias("e"))


@query("""
SELECT quality, count(*) AS n, count_if(toxic = 1) AS n_toxic, count(d.doc_id) AS n_found FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id GROUP BY quality""")
def truth_tally(spark, sf_dir):
    found = _t(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("found"))
    return _t(spark, sf_dir, "labels").join(found, "doc_id", "left").groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_toxic"), F.count("found").alias("n_found"))


@query("""
WITH p AS (SELECT s_nationkey AS x, floor(s_acctbal / 100)::BIGINT AS y, count(*) AS n FROM supplier GROUP BY ALL),
l AS (SELECT DISTINCT (b.y - a.y)::DOUBLE / (b.x - a.x) AS slope, a.y - (b.y - a.y)::DOUBLE / (b.x - a.x) * a.x AS start FROM p a JOIN p b ON a.x < b.x UNION SELECT 0, y FROM p),
t AS (SELECT slope, start, sum(n * greatest(0.05 * (y - start - slope * x), -0.95 * (y - start - slope * x))) AS loss FROM l CROSS JOIN p GROUP BY ALL)
SELECT (SELECT count(*) FROM supplier) AS n, round(min(loss), 4) AS loss FROM t""")
def quantile_line(spark, sf_dir):
    """How far balances of suppliers lie from the line of their 5 % quantile by nation; the SQL tries the lines through all two points."""
    pairs = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("x"), F.floor(F.col("s_acctbal") / 100).alias("y"))
    start, slope = calibrate.quantile_line(pairs, "x", "y")
    r = F.col("y") - (F.lit(start) + F.lit(slope) * F.col("x"))
    return pairs.agg(F.count("*").alias("n"), F.round(F.sum(F.greatest(0.05 * r, -0.95 * r)), 4).alias("loss"))


@query("SELECT o_orderkey, trunc(floor(o_totalprice)::INTEGER * 2.25::DOUBLE + 110.5 + 0.5)::INTEGER AS h_cutoff FROM orders")
def heuristic_cutoff(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", normalize.heuristic_cutoff(F.floor("o_totalprice").cast("int"), 110.5, 2.25).alias("h_cutoff"))


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, count(*) AS n FROM orders")
def gaussian_fit(spark, sf_dir):
    return calibrate.gaussian_fit(_t(spark, sf_dir, "orders"), "o_totalprice").select(F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "n")


@query("""
WITH b AS (SELECT floor(o_totalprice / 1000) AS bin, count(*) AS n FROM orders GROUP BY 1),
p AS (SELECT (bin + 1) * 1000 AS x, sum(n) OVER (ORDER BY bin) / (sum(n) OVER ()) AS share FROM b),
l AS (SELECT regr_slope(ln(-ln(share)), x) AS a, regr_intercept(ln(-ln(share)), x) AS c, count(*) AS bins FROM p WHERE share < 1)
SELECT round(-c / a, 3) AS mu, round(-a * 1e6, 5) AS lam, bins FROM l""")
def evd_linear_fit(spark, sf_dir):
    fit = calibrate.evd_linear_fit(_t(spark, sf_dir, "orders"), "o_totalprice", 1000.0)
    return fit.select(F.round("mu", 3).alias("mu"), F.round(F.col("lam") * 1e6, 5).alias("lam"), "bins")


@query("""
WITH b AS (SELECT floor(o_totalprice / 1000) AS bin, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT sum(n) AS t FROM b),
e AS (SELECT n, (exp(-exp(-2e-5 * ((bin + 1) * 1000 - 150000))) - exp(-exp(-2e-5 * (bin * 1000 - 150000)))) * t AS e FROM b, t)
SELECT round(sum((n - e) * (n - e) / e), 4) AS chi2, count(*) AS bins FROM e WHERE e >= 5""")
def evd_chi2(spark, sf_dir):
    return calibrate.evd_chi2(_t(spark, sf_dir, "orders"), "o_totalprice", 150000, 2e-5, 1000.0).withColumn("chi2", F.round("chi2", 4))


@query("SELECT o_orderkey, round(2e-5 * exp(-2e-5 * (o_totalprice - 150000) - exp(-2e-5 * (o_totalprice - 150000))) * 1e6, 6) AS density, round(1 - exp(-o_totalprice / 1e5), 9) AS p FROM orders")
def extreme_density(spark, sf_dir):
    x = F.col("o_totalprice")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.round(calibrate.evd_density(x, 150000, 2e-5) * 1e6, 6).alias("density"), F.round(calibrate.poisson_p(x / 1e5), 9).alias("p"))


@query("""
WITH o AS (SELECT s_suppkey, s_nationkey AS r1, s_acctbal AS r2 FROM supplier), n AS (SELECT c_custkey AS s_suppkey, c_nationkey AS r1, c_acctbal AS r2 FROM customer)
SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, o.r1 AS old_r1, o.r2 AS old_r2, n.r1 AS new_r1, n.r2 AS new_r2, n.r1 - o.r1 AS r1_diff, round(n.r2 - o.r2, 6) AS r2_diff FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey""")
def parameter_comparison(spark, sf_dir):
    """Balances of suppliers and customers of one number as old and new parameters."""
    old = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("r1"), F.col("s_acctbal").alias("r2"))
    new = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_nationkey").alias("r1"), F.col("c_acctbal").alias("r2"))
    return build.compare_parameters(old, new, ("s_suppkey",), ("r1", "r2")).withColumn("r2_diff", F.round("r2_diff", 6))
