"""Statistics of scores: regression on ranks, extreme values, quantile regression, cutoffs.

Scores are counted by value in Spark; fits work on those counts, whose number
is that of distinct scores, not of rows.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import cut
from .kernels import Profile
from .search import with_h_score, with_score

#: Ranks of equal scores worked out in one row.
RANKS = 4096


def histogram(df: DataFrame, score: str, bin_width: float = 1.0) -> DataFrame:
    """(bin, n): counts of scores by whole bins."""
    return df.where(F.col(score).isNotNull()).groupBy(F.floor(F.col(score) / bin_width).alias("bin")).agg(F.count("*").alias("n"))


def statistics(df: DataFrame, score: str) -> DataFrame:
    return df.agg(F.min(score).alias("min"), F.max(score).alias("max"), F.avg(score).alias("avg"), F.count(score).alias("n"))


def library_statistics(df: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Records, residues, mean and greatest length."""
    n = F.length(sequence)
    return df.agg(F.count("*").alias("records"), F.coalesce(F.sum(n), F.lit(0)).alias("residues"), F.avg(n).alias("mean_length"), F.max(n).alias("longest"))


def ranked(df: DataFrame, score: str) -> DataFrame:
    """Distinct scores with the rows above them and at them: (score, n, above).

    Ranks of equal scores are consecutive, so all rank sums follow from these
    counts. The running total is taken in two steps, over ranges of as many
    distinct scores each and within a range; no task sees all scores.
    """
    counts = df.where(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"))
    counts = cut(counts.repartitionByRange(F.desc("score")).withColumn("range", F.spark_partition_id()), "ranges")
    totals = counts.groupBy("range").agg(F.sum("n").alias("in_range"))
    totals = totals.select("range", (F.sum("in_range").over(W.orderBy("range")) - F.col("in_range")).alias("before"))
    inner = F.sum("n").over(W.partitionBy("range").orderBy(F.desc("score"))) - F.col("n")
    return counts.withColumn("inner", inner).join(totals, "range").select("score", "n", (F.col("before") + F.col("inner")).alias("above"))


def rank_regression(df: DataFrame, score: str, residues: float = 14147368, base: float = 10.0, upper: float = 1e-4, lower: float = 1e-6) -> DataFrame:
    """(r1, r2, used): the line norm = r1 + r2 * score fitted to scores against log ranks.

    Rank r of the scores in descending order stands for y = log(residues) -
    log(r - 1/2), with weight r / 2; ranks whose y lies between -log(upper) and
    -log(lower) are used. Runs of equal scores are fitted rank by rank, from
    counts.
    """
    # the ranks that can be used, in blocks, so that a long run of equal scores isn't one array
    begin, end = F.greatest(F.col("above") + 1, F.lit(int(residues * lower))), F.least(F.col("above") + F.col("n"), F.lit(int(residues * upper) + 2))
    runs = ranked(df, score).select("score", begin.alias("begin"), end.alias("end")).where("begin <= end")
    blocks = runs.select("score", "end", F.explode(F.sequence("begin", "end", F.lit(RANKS).cast("long"))).alias("begin"))
    each = blocks.select("score", F.explode(F.sequence("begin", F.least(F.col("begin") + (RANKS - 1), "end"))).alias("rank"))
    log = lambda c: F.log(c) / math.log(base)
    rows = each.select("score", "rank", (math.log(residues) / math.log(base) - log(F.col("rank") - 0.5)).alias("y"), (F.col("rank") / 2.0).alias("w"))
    rows = rows.where((F.col("y") >= -math.log(upper) / math.log(base)) & (F.col("y") <= -math.log(lower) / math.log(base)))
    s, y, w = F.col("score"), F.col("y"), F.col("w")
    sums = rows.agg(F.sum(w).alias("w"), F.sum(w * s).alias("s"), F.sum(w * y).alias("y"), F.sum(w * s * s).alias("ss"), F.sum(w * s * y).alias("sy"), F.count("*").alias("used"))
    slope = (F.col("sy") - F.col("s") * F.col("y") / F.col("w")) / (F.col("ss") - F.col("s") * F.col("s") / F.col("w"))
    return sums.select((F.col("y") / F.col("w") - slope * F.col("s") / F.col("w")).alias("r1"), slope.alias("r2"), "used")


def tail_cut(df: DataFrame, score: str, target: int) -> DataFrame:
    """The highest score such that at least ``target`` rows reach it."""
    return ranked(df, score).where(F.col("above") + F.col("n") >= target).agg(F.max("score").alias("cut"))


def evd_cdf(x: Column, mu: float, lam: float) -> Column:
    return F.exp(-F.exp(-lam * (x - mu)))


def evd_p(x: Column, mu: float, lam: float) -> Column:
    """Chance of a score of x or more."""
    return -F.expm1(-F.exp(-lam * (x - mu)))


def evd_e(x: Column, mu: float, lam: float, n: Column | float) -> Column:
    """Scores of x or more expected among n."""
    return evd_p(x, mu, lam) * n


def evd_density(x: Column, mu: float, lam: float) -> Column:
    return lam * F.exp(-lam * (x - mu) - F.exp(-lam * (x - mu)))


def poisson_p(e: Column) -> Column:
    """Chance of one or more where ``e`` are expected."""
    return -F.expm1(-e)


def gaussian_fit(df: DataFrame, score: str) -> DataFrame:
    """(mean, sd, n) of the scores; one score has no sd."""
    return df.agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.count(score).alias("n"))


def evd_linear_fit(df: DataFrame, score: str, width: float = 1.0) -> DataFrame:
    """(mu, lam, bins): a line through log(-log(share of scores up to a bin's end)) over the ends of all bins but the last."""
    bins = histogram(df, score, width)
    below = F.sum("n").over(W.orderBy("bin")) / F.sum("n").over(W.partitionBy())  # a row a bin
    points = bins.select(((F.col("bin") + 1) * width).alias("x"), below.alias("share")).where("share < 1").select("x", F.log(-F.log("share")).alias("y"))
    line = points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("at0"), F.count("*").alias("bins"))
    return line.select((-F.col("at0") / F.col("slope")).alias("mu"), (-F.col("slope")).alias("lam"), "bins")


def evd_chi2(df: DataFrame, score: str, mu: float, lam: float, width: float = 1.0, least: float = 5.0) -> DataFrame:
    """(chi2, bins): the histogram against an extreme-value distribution, over bins where ``least`` or more are expected."""
    bins = histogram(df, score, width)
    low, high = F.col("bin") * width, (F.col("bin") + 1) * width
    expected = (evd_cdf(high, mu, lam) - evd_cdf(low, mu, lam)) * F.sum("n").over(W.partitionBy())
    each = bins.withColumn("e", expected).where(F.col("e") >= least)
    return each.agg(F.sum((F.col("n") - F.col("e")) ** 2 / F.col("e")).alias("chi2"), F.count("*").alias("bins"))


def evd_fit(x: np.ndarray, n: np.ndarray, censored_at: float | None = None) -> tuple[float, float]:
    """Maximum-likelihood (mu, lambda) from values and counts, by Newton steps on lambda.

    ``censored_at``: only values from there on are known; ``n`` then counts
    those, and one further entry, its value ignored, those below (given last).
    """
    x, n = np.asarray(x, float), np.asarray(n, float)
    z = 0.0
    if censored_at is not None:
        x, n, z = x[:-1], n[:-1], n[-1]
    total, shift = n.sum(), x.min()
    x0 = x - shift
    c = (censored_at - shift) if censored_at is not None else 0.0
    mean = (n * x0).sum() / total
    spread = math.sqrt(max((n * (x0 - mean) ** 2).sum() / total, 1e-12))
    lam = math.pi / (spread * math.sqrt(6))
    for _ in range(100):
        e, ec = np.exp(-lam * x0), z * math.exp(-lam * c)
        s0 = (n * e).sum() + ec
        s1 = (n * x0 * e).sum() + c * ec
        s2 = (n * x0 * x0 * e).sum() + c * c * ec
        f = 1 / lam - mean + s1 / s0
        slope = -1 / lam**2 - s2 / s0 + (s1 / s0) ** 2
        new = lam - f / slope
        new = new if new > 0 else lam / 2
        if abs(new - lam) < 1e-12 * lam:
            lam = new
            break
        lam = new
    s0 = (n * np.exp(-lam * x0)).sum() + z * math.exp(-lam * c)
    return shift - math.log(s0 / total) / lam, lam


def calibrate_evd(df: DataFrame, score: str, method: str = "full", rounds: int = 100) -> tuple[float, float]:
    """(mu, lambda) of the scores, from their histogram.

    'full': all bins. 'peak': bins up to where one score is expected, anew
    until that bound stays. 'tail': as 'peak', with everything below the most
    frequent bin censored. Fewer than 5 bins or 100 counts are an error.
    """
    rows = sorted((r.bin, r.n) for r in histogram(df, score).collect())
    x, n = np.array([b + 0.5 for b, _ in rows]), np.array([k for _, k in rows], float)
    high = np.inf
    mu = lam = 0.0
    for _ in range(rounds if method != "full" else 1):
        use = x <= high
        if method == "tail":
            peak = x[use][n[use].argmax()] - 0.5
            below = n[use & (x < peak)].sum()
            use &= x >= peak
            values, counts, at = np.r_[x[use], 0], np.r_[n[use], below], peak
        else:
            values, counts, at = x[use], n[use], None
        if use.sum() < 5 or counts.sum() < 100:
            raise ValueError("too few scores for a fit")
        mu, lam = evd_fit(values, counts, at)
        bound = mu - math.log(-math.log1p(-1 / max(2.0, n.sum()))) / lam
        if method == "full" or bound >= high:
            break
        high = bound
    return mu, lam


def evd_to_norm(mu: float, lam: float, mean_length: float, base: float = 10.0) -> tuple[float, float]:
    """(r1, r2) of the normalisation that an extreme-value distribution gives."""
    return (math.log(mean_length) - mu * lam) / math.log(base), lam / math.log(base)


def _whole(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Values as whole numbers, and by what they were multiplied; exact, since floats are fractions of powers of two."""
    if np.all(values == np.floor(values)) and np.abs(values).max(initial=0) < 1 << 31:
        return values.astype(np.int64), 1
    parts = [Fraction(float(v)) for v in values]
    scale = max((f.denominator for f in parts), default=1)
    return np.array([int(f * scale) for f in parts], object), scale


def _tilt(x: np.ndarray, y: np.ndarray, n: np.ndarray, slope: Fraction, tau: Fraction) -> tuple[int, int, int]:
    """At a slope, with the best intercept: (least, greatest) derivative of the loss by slope, times tau's denominator, and the intercept times the slope's.

    Points above the line pull with weight tau, those below push with 1 - tau;
    those on it take what balances the two, and may share it in any way: the
    derivative is least when those of great x take most of it.
    """
    big = x.dtype == object or y.dtype == object or max(abs(slope.numerator), slope.denominator) * int(max(np.abs(x).max(), np.abs(y).max())) >= 1 << 61
    xs, ys = (v.astype(object) for v in (x, y)) if big else (x, y)
    r = ys * slope.denominator - xs * slope.numerator
    order = np.argsort(r, kind="stable")
    total, need = np.cumsum(n[order]), tau * int(n.sum())
    at = r[order[min(int(np.searchsorted(total, math.ceil(need))), len(r) - 1)]]
    p, q = tau.numerator, tau.denominator
    above, below, on = r > at, r < at, np.flatnonzero(r == at)
    weigh = lambda m: int((xs[m].astype(object) * n[m]).sum()) if m.any() else 0
    fixed = p * weigh(above) + (p - q) * weigh(below)
    rest = -(p * int(n[above].sum()) + (p - q) * int(n[below].sum()))  # what those on the line have to sum to
    ends = []
    for way in (-1, 1):
        left, sum_ = rest - (p - q) * int(n[on].sum()), fixed
        for k in on[np.argsort(way * xs[on], kind="stable")].tolist():  # each has p - q at least and q more at most
            more = min(left, q * int(n[k]))
            sum_, left = sum_ + int(xs[k]) * ((p - q) * int(n[k]) + more), left - more
        ends.append(-sum_)
    return ends[0], ends[1], at


def _simplest(low: Fraction, high: Fraction) -> Fraction:
    """The fraction of least denominator between two, ends included."""
    whole = math.ceil(low)
    if whole <= high:
        return Fraction(whole)
    floor = whole - 1
    return floor + 1 / _simplest(1 / (high - floor), 1 / (low - floor))


def quantile_regression(x: np.ndarray, y: np.ndarray, tau: float = 0.05, counts: np.ndarray | None = None) -> tuple[float, float]:
    """(intercept, slope) of the tau-quantile of y given x: the line of least loss, exactly.

    Each point may stand for ``counts`` rows. The loss, with the best intercept,
    is convex in the slope and bends only at slopes of lines through two points,
    fractions whose denominator is at most the range of x. So slopes are halved
    between one that is too small and one that is too large, in whole numbers,
    until one such fraction is left. One x only: slope 0.
    """
    x, y = np.asarray(x), np.asarray(y)
    n = np.ones(len(x), np.int64) if counts is None else np.asarray(counts, np.int64)
    (x, sx), (y, sy), tau = _whole(x), _whole(y), Fraction(tau).limit_denominator(10**6)
    reach, rise = int(x.max()) - int(x.min()), int(y.max()) - int(y.min())
    low, high, slope = Fraction(-rise - 1), Fraction(rise + 1), Fraction(0)
    while True:
        least, most, at = _tilt(x, y, n, slope, tau)
        if least <= 0 <= most or reach == 0:
            break
        low, high = (low, slope) if least > 0 else (slope, high)
        middle = (low + high) / 2
        slope = middle if (high - low) * reach * reach >= 1 else _simplest(low, high)
        if slope in (low, high):  # an end that was tried: the fraction is inside
            slope = _simplest(low + (high - low) / (4 * reach * reach + 4), high - (high - low) / (4 * reach * reach + 4))
        elif slope == middle:
            bits = max(0, (high - low).denominator.bit_length() - (high - low).numerator.bit_length()) + 4
            slope = Fraction(round(middle * (1 << bits)), 1 << bits)
    return float(Fraction(int(at), slope.denominator) / sy), float(slope * sx / sy)


def quantile_line(df: DataFrame, x: str, y: str, tau: float = 0.05) -> tuple[float, float]:
    """``quantile_regression`` of whole-numbered columns, from counts of their pairs: what is fitted is as large as the scores' ranges allow, whatever the rows."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n")).toPandas()
    if not len(pairs):
        raise ValueError("no pair of scores")
    return quantile_regression(pairs["x"].to_numpy(), pairs["y"].to_numpy(), tau, pairs["n"].to_numpy())


def refresh_cutoffs(cutoffs: list[dict], mode: int, r: tuple[float, float], h: tuple[float, float] | None = None) -> list[dict]:
    """Raw and prefilter cutoffs of each level that uses a linear mode, from its normalised cutoff."""
    out = []
    for c in cutoffs:
        c = dict(c)
        if mode in c["mode"]:
            c["score"] = int(math.floor((c["n_score"][c["mode"].index(mode)] - r[0]) / r[1] + 0.5))
            if h is not None:
                c["h_score"] = int(c["score"] * h[1] + h[0] + 0.5)
                if c["h_score"] <= 0:
                    raise ValueError(f"prefilter cutoff of level {c['level']} isn't positive")
        out.append(c)
    return out


def calibrate(profile: Profile, library: DataFrame, family: DataFrame, cutoffs: list[dict], mode: int = 1, residues: float | None = None, tau: float = 0.05) -> tuple[dict, DataFrame]:
    """Normalisation and cutoffs of a profile from scores: ({r, h, cutoffs}, the pairs of scores).

    ``library``: random or shuffled sequences; the line of their best scores'
    ranks gives the normalisation. ``family``: true sequences or mutants of
    them; the ``tau`` quantile of their prefilter score given the exact one gives
    the prefilter's line. The pairs (sequence, score, h_score) are what the second
    fit saw.
    """
    scored = with_score(library.select("sequence"), profile).where("score IS NOT NULL")
    if residues is None:
        residues = float(library.agg(F.sum(F.length("sequence"))).first()[0] or 0)
    line = rank_regression(scored, "score", residues=residues).first()
    pairs = with_score(with_h_score(family.select("sequence"), profile), profile).where("score IS NOT NULL").select("sequence", "score", "h_score")
    h = quantile_line(pairs, "score", "h_score", tau)
    r = (line.r1, line.r2)
    return {"r": r, "h": h, "cutoffs": refresh_cutoffs(cutoffs, mode, r, h)}, pairs
