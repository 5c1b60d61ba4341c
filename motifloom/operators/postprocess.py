"""Rules that raise or lower the level of hits given other hits in the same sequence.

Hits have seq_id, motif_ac, begin, end, raw, norm (null: a pattern), level,
level_tag, and pf_begin, pf_end where profile places are known. Each rule is one DataFrame step over ``seq_id``; rules are applied in
order and later ones see what earlier ones changed. Within a sequence, sums and
counts are aggregates joined back, so one sequence with very many hits is
pre-aggregated; only overlaps compare hits, by bins of the sequence.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut, drop_cut

#: Width of the bins in which intervals meet; a longer interval stands in several.
BIN = 512


def _is(ac: str) -> Column:
    return F.col("motif_ac") == ac


def _with_effectors(hits: DataFrame, effector: str, *aggs: Column) -> DataFrame:
    return hits.join(hits.where(_is(effector)).groupBy("seq_id").agg(*aggs), "seq_id", "left")


def _shift(df: DataFrame, where: Column, by: int, tag: str) -> DataFrame:
    """Levels moved by ``by`` and tagged where the condition holds (null: not)."""
    where = F.coalesce(where, F.lit(False))
    return df.withColumns({"level": F.when(where, F.col("level") + by).otherwise(F.col("level")), "level_tag": F.when(where, F.lit(tag)).otherwise(F.col("level_tag"))})


def promoted_by(hits: DataFrame, target: str, effector: str, least: int = 0) -> DataFrame:
    """Target hits below level 0 rise by one where some effector hit has ``least`` or more."""
    df = _with_effectors(hits, effector, F.max("level").alias("_top"))
    return _shift(df, _is(target) & (F.col("level") < 0) & (F.col("_top") >= least), 1, f"PROMOTED_BY_{effector}").select(*hits.columns)


def demoted_by(hits: DataFrame, target: str, effector: str, least: int = 0) -> DataFrame:
    """Target hits at level 0 or more fall by one where some effector hit has ``least`` or more."""
    df = _with_effectors(hits, effector, F.max("level").alias("_top"))
    return _shift(df, _is(target) & (F.col("level") >= 0) & (F.col("_top") >= least), -1, "DEMOTED").select(*hits.columns)


def bins(begin: Column, end: Column, width: int = BIN) -> Column:
    return F.sequence(F.floor(begin / width), F.greatest(F.floor(begin / width), F.floor(end / width)))


def overlaps(a: DataFrame, b: DataFrame, slack: int = 0, width: int = BIN) -> DataFrame:
    """Rows (a, b) structs of intervals in one sequence that overlap by more than ``slack``.

    Intervals meet in bins and a pair counts in the bin where its later begin lies, so each comes once.
    """
    left = a.select("seq_id", F.struct(*a.columns).alias("a"), F.explode(bins(F.col("begin"), F.col("end"), width)).alias("bin"))
    right = b.select("seq_id", F.struct(*b.columns).alias("b"), F.explode(bins(F.col("begin"), F.col("end"), width)).alias("bin"))
    meet = left.join(right, ["seq_id", "bin"])
    once = F.col("bin") == F.floor(F.greatest("a.begin", "b.begin") / width)
    return meet.where((F.col("a.begin") + slack <= F.col("b.end")) & (F.col("a.end") - slack >= F.col("b.begin")) & once).select("seq_id", "a", "b")


def contained(inner: DataFrame, outer: DataFrame, width: int = BIN) -> DataFrame:
    """inner with ``inside``: whether some outer interval of its sequence covers it.

    An interval is covered if the greatest end of the outer ones that begin no
    later reaches its own. That running maximum is taken in two steps, over bins
    and within a bin, so no pairs are made and no window holds a whole sequence.
    Both inputs are read once, into a written table.
    """
    at = F.floor(F.col("begin") / width).alias("_bin")
    rows = inner.select("seq_id", "begin", at, F.lit(1).alias("_inner"), F.struct(*inner.columns).alias("_row"), F.lit(None).cast("long").alias("_end"))
    ends = outer.groupBy("seq_id", "begin").agg(F.max("end").cast("long").alias("_end"))
    empty = F.lit(None).cast(rows.schema["_row"].dataType).alias("_row")
    both = cut(rows.unionByName(ends.select("seq_id", "begin", at, F.lit(0).alias("_inner"), empty, "_end")), "contained")
    within = F.max("_end").over(W.partitionBy("seq_id", "_bin").orderBy("begin", "_inner").rowsBetween(W.unboundedPreceding, 0))
    places = both.groupBy("seq_id", "_bin").agg(F.max("_end").alias("_most"))
    past = W.partitionBy("seq_id").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    places = places.select("seq_id", "_bin", F.max("_most").over(past).alias("_before")).where("_before IS NOT NULL")
    reached = both.withColumn("_here", within).where("_inner = 1").join(places, ["seq_id", "_bin"], "left")
    return reached.select("_row.*", F.coalesce(F.greatest("_here", "_before") >= F.col("_row.end"), F.lit(False)).alias("inside"))


def evaluated_by(hits: DataFrame, target: str, effector: str) -> DataFrame:
    """Pattern hits are tagged (0) where a hit of the evaluating profile covers them, else (-1)."""
    judged = contained(hits.where(_is(target)), hits.where(_is(effector) & (F.col("level") >= 0)))
    tag = F.when(F.col("inside"), F.lit("(0)")).otherwise(F.lit("(-1)"))
    return hits.where(~_is(target)).unionByName(judged.withColumn("level_tag", tag).drop("inside"))


def competes_hit_with(hits: DataFrame, first: str, second: str, slack: int = 0) -> DataFrame:
    """Of each overlapping pair the hit of lower normalised score falls by one, once for each such pair; ties stay.

    A hit of the first motif that has no letter left after taking ``slack`` off both sides competes with none.
    """
    own = ["seq_id", "motif_ac", "begin", "end", "norm"]
    a, b = hits.where(_is(first) & (F.col("begin") + slack <= F.col("end") - slack)).select(*own), hits.where(_is(second)).select(*own)
    # a hit is counted once for each rival, so the rivals keep their repeats and the hits don't
    lost = overlaps(a.distinct(), b, slack).where("a.norm < b.norm").select("a.*").unionByName(overlaps(a, b.distinct(), slack).where("b.norm < a.norm").select("b.*"))
    lost = lost.groupBy(*own).agg(F.count("*").cast("int").alias("_lost"))
    rival = F.concat(F.lit("OUTCOMPETED_HIT_BY_"), F.when(_is(first), second).otherwise(first))
    fell = F.col("_lost").isNotNull()
    out = hits.join(lost, own, "left").withColumns({"level": F.col("level") - F.coalesce("_lost", F.lit(0)), "level_tag": F.when(fell, rival).otherwise(F.col("level_tag"))})
    return out.select(*hits.columns)


def competes_seq_with(hits: DataFrame, first: str, second: str) -> DataFrame:
    """Of two motifs in a sequence all hits of the one of lower best normalised score fall by one; of equal ones the first's.

    A best score is 0 at least; sequences with hits of one of them only stay as they are.
    """
    best = lambda ac: F.greatest(F.max(F.when(_is(ac), F.coalesce("norm", F.lit(0.0)))), F.max(F.when(_is(ac), 0.0)))
    top = hits.groupBy("seq_id").agg(best(first).alias("_a"), best(second).alias("_b"))
    df = _shift(hits.join(top, "seq_id"), _is(first) & (F.col("_a") <= F.col("_b")), -1, f"OUTCOMPETED_SEQ_BY_{second}")
    return _shift(df, _is(second) & (F.col("_b") < F.col("_a")), -1, f"OUTCOMPETED_SEQ_BY_{first}").select(*hits.columns)


def promote_repeat(hits: DataFrame, target: str, effector: str, norm: float = 0.0) -> DataFrame:
    """With two or more target hits and an effector hit of ``norm`` or more, target hits below level 0 rise by one."""
    per = hits.groupBy("seq_id").agg(F.count_if(_is(target)).alias("_n"), F.max(F.when(_is(effector), F.col("norm"))).alias("_top"))
    rise = _is(target) & (F.col("level") < 0) & (F.col("_n") > 1) & (F.col("_top") >= norm)
    return _shift(hits.join(per, "seq_id"), rise, 1, "PROMOTED_REPEAT").select(*hits.columns)


def repeat_domain(hits: DataFrame, target: str, total: float | None = None, tags: tuple[str, str] = ("R", "r")) -> DataFrame:
    """Where any hit of a repeat motif reaches level 0, or its normalised scores sum to ``total``, those below 0 rise by one."""
    per = hits.where(_is(target)).groupBy("seq_id").agg(F.max("level").alias("_top"), F.sum("norm").alias("_sum"))
    df, below = hits.join(per, "seq_id", "left"), _is(target) & (F.col("level") < 0)
    by_top, low = F.col("_top") >= 0, F.coalesce(F.col("_top") < 0, F.lit(True))
    by_sum = F.lit(False) if total is None else low & (F.coalesce("_sum", F.lit(0.0)) >= total)
    df = df.withColumns({"_up": below & by_top, "_more": below & by_sum})
    return _shift(_shift(df, F.col("_up"), 1, tags[0]), F.col("_more"), 1, tags[1]).select(*hits.columns)


def implicit_rules(ac: str, cutoffs: Sequence[dict], every: bool = False) -> list[tuple]:
    """Rules on itself that a repeat profile's cutoffs ask for by their text, those of later cutoffs first.

    'R?': hits of one good one rise; 'RR': also by their sum, which is the
    normalised cutoffs of levels -1 and more up to here; with ``every``, '!'
    asks for the same as 'RR', with tags of its own.
    """
    out, total = [], 0.0
    for c in cutoffs:
        if c["level"] >= -1:
            total += (c.get("n_score") or [0.0])[0] or 0.0
        text = (c.get("text") or "").strip("'")
        if text == "R?":
            out.insert(0, ("PROMOTER_RDM1", ac, ac))
        elif text == "RR":
            out.insert(0, ("PROMOTER_RDM1_OR_RDM2", ac, ac, total))
        elif every and text == "!":
            out.insert(0, ("PROMOTER_RDM1_OR_RDM2_4!REP", ac, ac, total))
    return out


def scan_level(level: int) -> int:
    """The level a search has to go down to so that rules may raise weak hits: -1 for 0."""
    return -1 if level == 0 else level


def islands(hits: DataFrame, gap: float, by: Sequence[str] = ("seq_id", "motif_ac"), middle: Column | None = None, order: Sequence[str] = ("begin", "end")) -> DataFrame:
    """hits with ``island``: a number that rises where the midpoint is over ``gap`` past the one before."""
    w = W.partitionBy(*by).orderBy(*order)
    middle = (F.col("begin") + F.col("end")) / 2 if middle is None else middle
    starts = F.coalesce((middle - F.lag(middle).over(w) > gap).cast("int"), F.lit(1))
    return hits.withColumn("_starts", starts).withColumn("island", F.sum("_starts").over(w)).drop("_starts")


def trapezoid(df: DataFrame, x: str, y: str, by: Sequence[str], ties: str | None = None) -> DataFrame:
    """Area under y over x in each group; points of equal x in the order of ``ties``."""
    w = W.partitionBy(*by).orderBy(x, *([ties] if ties else []))
    part = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_part", part).groupBy(*by).agg(F.coalesce(F.sum("_part"), F.lit(0.0)).alias("area"))


def _periodicity(size: float, top: float):
    """For the hits of one island: their autocorrelation at the repeat's length, integrated over the island.

    Each hit is a bump sinc squared around its middle, as high as its score is
    of ``top``. The sum of bumps is multiplied with the sum of each hit's
    neighbour moved by ``size`` (the one before; for the first, the one after).
    """

    def bump(x: np.ndarray, height: float, middle: float, width: float) -> np.ndarray:
        return height * np.sinc(2 * (x - middle) / width) ** 2 if width >= 1 else np.zeros_like(x)

    def area(rows: list[tuple]) -> float:
        bumps = [(raw / top, middle, width) for _, _, raw, middle, width in rows]
        begin, end = int(rows[0][0]), int(rows[-1][1])
        total, last = 0.0, None
        for low in range(begin, end + 1, 1 << 16) if len(rows) > 1 else ():
            x = np.arange(low, min(end, low + (1 << 16) - 1) + 1, dtype=float)
            own, moved = np.zeros_like(x), np.zeros_like(x)
            for g in range(len(bumps)):
                side = 1 if g == 0 else -1
                own += bump(x, *bumps[g])
                moved += bump(x + size * side, *bumps[g + side])
            both = own * moved
            total += float(both.sum() - (both[0] + both[-1]) / 2) + (0.0 if last is None else (last + float(both[0])) / 2)
            last = float(both[-1])
        return total

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, names = None, [], [], None

        def pack(kinds):
            made = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["seq_id", "island", "area"])
            out.clear()
            return made

        for batch in batches:
            kinds = [batch.schema.field(0).type, pa.int64(), pa.float64()]
            for key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key[:2] != now:
                    if rows:
                        out.append((*now, area(rows)))
                        rows.clear()
                    now = key[:2]
                rows.append(key[2:])
            if len(out) > 10_000:
                yield pack(kinds)
        if rows:
            out.append((*now, area(rows)))
        if out:
            yield pack(kinds)

    return step


def flank_repeats(hits: DataFrame, target: str, top: float, cutoff: float, size: float, gap: float, least_norm: float | None = None) -> DataFrame:
    """Tandem repeats: hits below level 0 are set to 0 where their island repeats at ``size`` letters, else to -2.

    Islands part where middles are over ``gap`` times ``size`` apart. An
    island repeats if its periodicity exceeds ``cutoff``; with ``least_norm``,
    only in sequences that have a hit of that normalised score. ``top`` is the
    score of a perfect repeat. An island, a run of close hits in one sequence,
    is worked on as a whole. Hits of one place follow each other by score, the
    lowest first, as their order counts at an island's ends.
    """
    begin = F.col("begin") - F.coalesce("pf_begin", F.lit(1)) + 1
    end = F.col("end") - F.coalesce("pf_end", F.lit(-1)) - 1
    own = hits.where(_is(target)).withColumns({"width": 1 + end - begin, "middle": (1 + end - begin) / 2 + begin})
    own = islands(own, gap * size, middle=F.col("middle"), order=("begin", "end", "middle"))
    kind = f"seq_id {hits.schema['seq_id'].dataType.simpleString()}, island long, area double"
    rows = own.select("seq_id", "island", "begin", "end", F.coalesce(F.col("raw").cast("double"), F.lit(0.0)).alias("raw"), F.col("middle").cast("double"), F.col("width").cast("double"))
    areas = rows.repartition("seq_id", "island").sortWithinPartitions("seq_id", "island", "begin", "end", "middle", "width", "raw").mapInArrow(_periodicity(size, top), kind)
    chosen = F.col("area") > cutoff
    if least_norm is not None:
        best = hits.where(_is(target)).groupBy("seq_id").agg(F.max("norm").alias("_best"))
        areas = areas.join(best, "seq_id")
        chosen = chosen & F.coalesce(F.col("_best") >= least_norm, F.lit(False))
    judged = own.join(areas.select("seq_id", "island", chosen.alias("_chosen")), ["seq_id", "island"])
    new = F.when(F.col("level") >= 0, F.col("level")).when(F.col("_chosen"), 0).otherwise(-2)
    tag = F.when(F.col("level") >= 0, F.col("level_tag")).when(F.col("_chosen"), "PROMOTED_FTREP").otherwise("DEMOTED_FTREP")
    judged = judged.withColumn("level_tag", tag).withColumn("level", new.cast(hits.schema["level"].dataType)).select(*hits.columns)
    return hits.where(~_is(target)).unionByName(judged)


def any_evaluated(hits: DataFrame) -> DataFrame:
    """If any hit of a pattern in a sequence is tagged (0), all its hits are."""
    per = hits.groupBy("seq_id", "motif_ac").agg(F.max(F.coalesce(F.col("level_tag") == "(0)", F.lit(False))).alias("_any"))
    return hits.join(per, ["seq_id", "motif_ac"]).withColumn("level_tag", F.when(F.col("_any"), F.lit("(0)")).otherwise(F.col("level_tag"))).drop("_any").select(*hits.columns)


def visible(hits: DataFrame, level: int = 0, min_hits: int | None = None, max_hits: int | None = None) -> DataFrame:
    """Pattern hits and profile hits of ``level`` or more; of motifs with a fitting number of hits in the sequence, the first ``max_hits``."""
    out = hits.where(F.col("norm").isNull() | (F.col("level") >= level))
    by = W.partitionBy("seq_id", "motif_ac")
    if min_hits is not None:
        out = out.withColumn("_n", F.count("*").over(by)).where(F.col("_n") >= min_hits).drop("_n")
    if max_hits is not None:
        out = out.withColumn("_k", F.row_number().over(by.orderBy("begin", "end"))).where(F.col("_k") <= max_hits).drop("_k")
    return out


RULES = {
    "PROMOTED_BY": promoted_by,
    "DEMOTED_BY": demoted_by,
    "EVALUATED_BY": evaluated_by,
    "COMPETES_HIT_WITH": competes_hit_with,
    "COMPETES_SEQ_WITH": competes_seq_with,
    "PROMOTE_REPEAT": promote_repeat,
    "PROMOTER_RDM1": lambda hits, target, _: repeat_domain(hits, target),
    "PROMOTER_RDM1_OR_RDM2": lambda hits, target, _, total: repeat_domain(hits, target, total),
    "PROMOTER_RDM1_OR_RDM2_4!REP": lambda hits, target, _, total: repeat_domain(hits, target, total, ("?R", "?r")),
    "FTREP": lambda hits, target, _, *numbers: flank_repeats(hits, target, *numbers),
}


def apply(hits: DataFrame, rules: Sequence[tuple], ranks: dict[str, int] | None = None) -> DataFrame:
    """Rules (type, target, effector, further arguments...): those of a motif on itself first, then the others.

    Either by the place of their target's motif in the motif file (``ranks``,
    motifs without one count as 0), the last motif first; rules of one target in
    the order given. Later rules see what earlier ones changed.
    """
    ranks = ranks or {}
    for kind, target, effector, *more in sorted(rules, key=lambda r: (r[1] != r[2], -ranks.get(r[1], 0))):
        hits = RULES[kind](hits, target, effector, *more)
    return hits


def unroll(hits: DataFrame, parts: str = "sub_hits") -> DataFrame:
    """A row for each repeat inside a match: begin and end are the repeat's, everything else the match's; a match without repeats stays."""
    own = F.when(F.size(parts) > 0, F.transform(parts, lambda x: F.struct(x["begin"].alias("begin"), x["end"].alias("end")))).otherwise(F.array(F.struct("begin", "end")))
    split = hits.withColumn("_part", F.explode(own))
    return split.withColumns({"begin": F.col("_part.begin"), "end": F.col("_part.end")}).drop("_part", parts)


def with_metadata(hits: DataFrame, motifs: DataFrame, columns: Sequence[str] = ("id", "description", "type", "skip")) -> DataFrame:
    """hits with columns of their motif, by accession; null where the motif isn't known. Of rows that share an accession one counts."""
    named = motifs.groupBy(F.col("ac").alias("motif_ac")).agg(F.min(F.struct(*columns)).alias("_m"))
    return hits.join(named, "motif_ac", "left").select(*hits.columns, *(F.col(f"_m.{c}").alias(f"motif_{c}") for c in columns))


def closure(links: DataFrame, source: str = "target_ac", target: str = "effector_ac") -> DataFrame:
    """All pairs (source, target) reachable over links.

    Paths are joined until none is new, each round to paths of up to twice the
    links; known pairs are written to the shared folder each round, so that
    plans stay short and a lost executor costs no more than a round.
    """
    known = cut(links.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct(), "closure")
    n = known.count()
    while True:
        longer = known.select("a", F.col("b").alias("m")).join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        after = cut(known.unionByName(longer).distinct(), "closure")
        drop_cut(known)
        known, before = after, n
        n = known.count()
        if n == before:
            return known.select(F.col("a").alias(source), F.col("b").alias(target))
