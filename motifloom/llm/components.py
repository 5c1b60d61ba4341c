"""Connected components by star contraction, without gathering links anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of a link; root is the smallest node reachable.

    Alternates the two star operations until no link changes. A round keeps
    the components, holds at most as many links as the last, and makes the
    distance to the root shrink, so a few rounds do. Minima are aggregated
    before the shuffle; the join back to them may be split where a node has
    very many links. Each round is a written table in the shared folder.
    Links with a null end or two equal ends are ignored; no links, no rows.
    """
    x, y = F.col(a), F.col(b)
    now = cut(
        links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(),
        "links",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        drop_cut(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    """Equal for equal sets of links."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)
