"""Quality rules as a short-circuit cascade over measures of each text.

DataFrame functions only. The costly measure, words in repeated 8-word windows,
is found per text: windows are hashed, and only where a hash comes twice are
hashes sorted with their places to see which words the repeats cover.

A column that a lambda refers to must be a plain attribute, or the optimiser
may put its whole expression inside the lambda; ``_fixed`` sees to that.
"""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, drop_cut

WINDOW = 8


def _fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that later projections can't be merged into (one row stays one row)."""
    row = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def measures(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs' text as ``_text`` (null: empty) with the measures added; other columns stay.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), and
    n_same (words equal to the word before), n_capital (words of two or more
    letters, all of them capitals), n_lines (lines with a word).
    """
    df = _fixed(docs, _text=F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = _fixed(df, _words=F.regexp_extract_all("_text", F.lit(f"({WORD})"), F.lit(1)))
    n = F.size("_words")
    df = _fixed(df, _marks=F.transform("_words", lambda w: F.xxhash64(w)))
    spans = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.xxhash64(F.slice("_marks", i, F.lit(window)))))
    df = _fixed(df, _spans=spans)
    twice = F.size(F.array_distinct("_spans")) < F.size("_spans")
    df = _fixed(df, _sorted=F.when(twice, F.sort_array(F.transform("_spans", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: F.coalesce(F.get("_sorted", k)["h"] == x["h"], F.lit(False))
    again = F.filter("_sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    df = _fixed(df, _again=F.sort_array(F.transform(again, lambda x: x["i"])))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    cover = F.aggregate("_again", start, lambda s, i: F.struct((i + window).alias("end"), (s["n"] + i + window - F.greatest(s["end"], i)).alias("n")), lambda s: s["n"])
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _fixed(df, _lines=lines)
    removed = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    own = {
        "n_words": n,
        "word_chars": removed(r"[\x20\x09-\x0D]+"),
        "n_symbols": removed(r"[^#*$%&|<>]+"),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.coalesce(cover, F.lit(0)),
    }
    df = df.withColumns({k: c.cast("long") for k, c in own.items()})
    return df.drop("_sorted", "_again", "_spans")


def costlier() -> dict[str, Column]:
    """Rules on the columns of ``measures`` that look at a text again: name -> condition under which it is rejected."""
    pairs = F.zip_with(F.slice("_marks", 2, F.greatest(F.size("_marks") - 1, F.lit(0))), "_marks", lambda a, b: a == b)
    stutter = F.size(F.filter(pairs, lambda x: x))
    shouted = F.regexp_count("_text", F.lit(r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "dup_lines": 2 * F.col("n_dup_lines") > F.size("_lines"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 30 * F.col("n_words")),
        "stutter": 100 * stutter > 30 * F.col("n_words"),
        "shouting": 100 * shouted > 30 * F.col("n_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def plan(sample: DataFrame, rules: Mapping[str, Column], repeats: int = 40) -> list[str]:
    """Names of the rules by rejections per cost on a sample, the best first; ties by name.

    A rule's cost is what evaluating it ``repeats`` times on each row takes
    beyond the same pass without a rule, the lesser of two runs each. The
    order changes what a run costs, never what it returns.
    """

    def run(rejected: Column) -> tuple[float, int]:
        again = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats))))
        took, n = [], 0
        for _ in range(2):
            began = time.perf_counter()
            n = again.agg(F.count_if(F.coalesce(rejected, F.lit(False)) & (F.col("_again") > 0))).first()[0]
            took.append(time.perf_counter() - began)
        return min(took), n

    idle, _ = run(F.col("n_words") < 0)
    found = {name: run(rejected) for name, rejected in rules.items()}
    return sorted(found, key=lambda k: (-found[k][1] / max(1e-3, found[k][0] - idle), k))


def cascade(rules: Mapping[str, Column], order: list[str]) -> Column:
    """True if no rule rejects; a rule is evaluated only where none before it rejects."""
    out = F.lit(True)
    for name in reversed(order):
        out = F.when(F.coalesce(rules[name], F.lit(False)), F.lit(False)).otherwise(out)
    return out


def apply_rules(docs: DataFrame, sample_rows: int = 500) -> DataFrame:
    """One row for each row of docs: doc_id, the measures, base_failed, kept.

    Costs and rejections are estimated on about ``sample_rows`` rows, those of
    a hash class of doc_id whose number the row count sets, written to the
    shared folder; every row is judged by every rule that is reached. Null and
    empty texts have no word and fail the base rule. Repeated rows stay; an
    empty table gives none; other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rules = costlier()
    classes = max(1, own.count() // max(1, sample_rows))
    sample = cut(measures(own.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(classes)) == 0)), "sample")
    order = plan(sample, rules)
    drop_cut(sample)
    judged = measures(own).withColumn("base_failed", base_failed())
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(rules, order))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT row, i, array_to_string(words[i:i + 7], ' ') AS win
  FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, win) AS n FROM windows) WHERE n > 1),
gaps AS (SELECT row, i, coalesce(lag(i) OVER (PARTITION BY row ORDER BY i), -100) AS prior FROM again),
covered AS (SELECT row, sum(least(8, i - prior)) AS n FROM gaps GROUP BY row),
measured AS (
  SELECT s.doc_id, s.text, s.words, s.lines, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.row = c.row),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    10 * n_symbols > n_words OR 2 * n_dup_lines > len(lines) OR word_chars < 2 * n_words OR word_chars > 30 * n_words
    OR 100 * len(list_filter(range(2, n_words + 1), lambda i: words[i] = words[i - 1])) > 30 * n_words
    OR 100 * len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda x: regexp_full_match(x, '\p{Lu}{2,}'))) > 30 * n_words AS rejected
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM judged
"""
