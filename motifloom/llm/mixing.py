"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only. Words per source are summed first; the targets are
the level at which water stands when each source is a vessel of its weight's
width and twice its size's volume. Each source's rate of words changes linearly
over the training time t in [0, 1], from ``1 - lean`` to ``1 + lean`` times its
mean; its integral is target * ((1 - lean) * t + lean * t^2), and the inverse of
that integral at the words served before a document is the document's position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (3, 1, 2)
#: Leans of the sources' rates, by turn as the weights.
LEANS = (-0.5, 0.5, 0.0)
#: Hex digits of the order key that name a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _md5(column: str) -> Column:
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def _by_turn(rank: Column, values: tuple) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(rank % len(values) == i, F.lit(v)).otherwise(out)
    return out


def targets(sources: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS) -> DataFrame:
    """(source, source_size, target, lean) from one row (source, source_size) per source.

    Sources by code point, null last, take the weights by turn. Together they
    get 150% of all words; a target stops at twice the source's size and the
    excess is shared anew by weight until none is above. One row a source, so
    one window over all of them is small.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({"weight": _by_turn(F.col("rank"), weights).cast("long"), "lean": _by_turn(F.col("rank"), leans).cast("double")})
    total = F.sum("source_size").over(W.partitionBy())
    # sources whose vessels fill first stand first: by size over weight, in whole numbers
    lcm = 1
    for w in weights:
        lcm *= w
    order = W.orderBy((F.col("source_size") * (F.lit(lcm) / F.col("weight")).cast("long")), F.col("rank"))
    before = F.coalesce(F.sum("source_size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    filled = ranked.withColumns({"total": total, "before": before, "rest": rest})
    # level = (1.5 total - 2 before) / rest; a vessel is full if 2 size <= weight * level
    filled = filled.withColumn("full", 4 * F.col("source_size") * F.col("rest") <= F.col("weight") * (3 * F.col("total") - 4 * F.col("before")))
    top = F.first(F.when(~F.col("full"), F.struct(F.col("before"), F.col("rest"))), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    filled = filled.withColumn("top", top)
    level = (F.col("weight") * (3 * F.col("total") - 4 * F.col("top.before"))).cast("double") / (2 * F.col("top.rest")).cast("double")
    return filled.select("source", "source_size", F.when(F.col("full"), (2 * F.col("source_size")).cast("double")).otherwise(level).alias("target"), "lean")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, leans: tuple = LEANS, with_text: bool = False) -> DataFrame:
    """One row for each row of docs, sorted by training position.

    Columns: doc_id, source, size (words; null text: 0), source_size, target,
    taken (words the mix takes of it, at most twice its size), position (when
    its first word is served, 0 to 1; null if none is taken), position_again
    (when its first word is served for the second time; null if taken is no
    more than size), and, if asked for, text.

    Within a source documents are served in the order of md5(doc_id), pass
    after pass until the whole words of the target are taken; the last may be
    taken in part. So reruns agree; rows with equal doc_id and size are alike,
    and rows that share a doc_id but differ in size are served by size. Rows
    with a null doc_id are ordered by md5(text). Running sums are taken in two steps,
    over buckets of the order and within a bucket, so a source with a third of
    all rows is spread over 4096 groups. An empty table gives no rows; a table
    without a word has targets of 0.
    """
    more = ["text"] if with_text else []
    sizes = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), F.when(F.col("doc_id").isNull(), _md5("text")).alias("of_text"), *more), "sizes")
    keyed = sizes.withColumn("key", F.coalesce("of_text", _md5("doc_id")))
    keyed = keyed.withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    buckets = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    buckets = buckets.withColumn("earlier", F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket")) - F.col("in_bucket"))
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, leans)
    placed = buckets.join(goals, buckets["source"].eqNullSafe(goals["source"])).select(buckets["source"].alias("s"), F.col("bucket").alias("b"), "earlier", "source_size", "target", "lean")
    own = W.partitionBy("source", "bucket").orderBy("key", "size", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = keyed.withColumn("within", F.sum("size").over(own) - F.col("size"))
    rows = rows.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    want = F.floor("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(want / F.col("source_size"))).otherwise(0).cast("long")
    rows = rows.withColumns({"before": F.col("earlier") + F.col("within"), "passes": passes, "rest": want - passes * F.col("source_size")})
    last = F.least("size", F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before")))
    rows = rows.withColumn("taken", F.col("passes") * F.col("size") + last)
    at = lambda before, some: F.when(some, position(before, F.col("target"), F.col("lean")))
    own = at(F.col("before"), F.col("taken") > 0).alias("position"), at(F.col("before") + F.col("source_size"), F.col("taken") > F.col("size")).alias("position_again")
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", *own, *more).orderBy("position", "doc_id")


def position(before: Column, target: Column, lean: Column) -> Column:
    """The t at which ``before`` words of a source have been served."""
    share = before.cast("double") / target
    start = F.lit(1.0) - lean
    bent = (F.sqrt(start * start + F.lit(4.0) * lean * share) - start) / (F.lit(2.0) * lean)
    return F.round(F.abs(F.when(lean == 0.0, share).otherwise(bent)), 6)


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(CASE WHEN doc_id IS NULL THEN coalesce(text, '') ELSE CAST(doc_id AS VARCHAR) END) AS key FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sources),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
    CASE rank % 3 WHEN 0 THEN -0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS lean FROM ranked),
stacked AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(source_size) OVER (ORDER BY source_size * (6 // weight), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY source_size * (6 // weight), rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
judged AS (SELECT *, 4 * source_size * rest <= weight * (3 * total - 4 * before) AS filled FROM stacked),
level AS (SELECT CAST(3 * total - 4 * before AS BIGINT) AS num, CAST(rest AS BIGINT) AS rest FROM judged WHERE NOT filled
          ORDER BY source_size * (6 // weight), rank LIMIT 1),
goals AS (
  SELECT source, source_size, lean, CASE WHEN filled THEN CAST(2 * source_size AS DOUBLE)
    ELSE CAST(weight * (SELECT num FROM level) AS DOUBLE) / CAST(2 * (SELECT rest FROM level) AS DOUBLE) END AS target FROM judged),
served AS (
  SELECT z.doc_id, z.source, CAST(z.size AS BIGINT) AS size, g.source_size, g.target, g.lean,
    CAST(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.size, z.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - z.size AS BIGINT) AS before
  FROM sizes z JOIN goals g ON z.source IS NOT DISTINCT FROM g.source),
passed AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS passes FROM served),
took AS (
  SELECT *, CAST(passes * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken FROM passed)
SELECT doc_id, source, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(abs(CASE WHEN lean = 0 THEN CAST(before AS DOUBLE) / target
    ELSE (sqrt((1.0::DOUBLE - lean) * (1.0::DOUBLE - lean) + 4.0::DOUBLE * lean * (CAST(before AS DOUBLE) / target)) - (1.0::DOUBLE - lean)) / (2.0::DOUBLE * lean) END), 6) END AS position,
  CASE WHEN taken > size THEN round(abs(CASE WHEN lean = 0 THEN CAST(before + source_size AS DOUBLE) / target
    ELSE (sqrt((1.0::DOUBLE - lean) * (1.0::DOUBLE - lean) + 4.0::DOUBLE * lean * (CAST(before + source_size AS DOUBLE) / target)) - (1.0::DOUBLE - lean)) / (2.0::DOUBLE * lean) END), 6) END AS position_again
FROM took
"""
