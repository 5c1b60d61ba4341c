"""Raw scores to normalised scores, back again, and to confidence levels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw_to_norm(function: str, r: Sequence[float], score: Column, length: Column | None = None, rave: Column | None = None) -> Column:
    """LINEAR: r1 + r2 * score. GLE_ZSCORE (also called GRIBSKOV) relates the
    score to the one that a sequence of its length is expected to have; GLE_ZSCAVE
    first takes off the average score that the sequence's composition gives."""
    function = {"GRIBSKOV": "GLE_ZSCORE"}.get(function, function)
    if function == "LINEAR":
        return r[0] + r[1] * score
    curve = r[0] * (1 - F.exp(r[1] * length - r[2]))
    if function == "GLE_ZSCORE":
        return (score / curve - r[3]) / r[4]
    if function == "GLE_ZSCAVE":
        return ((score - rave) / curve - r[3]) / r[4]
    raise ValueError(function)


def norm_to_raw(function: str, r: Sequence[float], norm: Column, length: Column | None = None, rave: Column | None = None, rounding: str = "half_up") -> Column:
    """The inverse, as a whole number: x + 0.5 cut off ('half_up') or rounded up ('ceil')."""
    function = {"GRIBSKOV": "GLE_ZSCORE"}.get(function, function)
    if function == "LINEAR":
        raw = (norm - r[0]) / r[1]
    else:
        curve = r[0] * (1 - F.exp(r[1] * length - r[2]))
        raw = curve * (r[4] * norm + r[3])
        raw = raw + rave if function == "GLE_ZSCAVE" else raw
    return (F.ceil(raw) if rounding == "ceil" else F.floor(raw + 0.5)).cast("int")


def heuristic_cutoff(cutoff: Column, r1: float, r2: float) -> Column:
    """The prefilter cutoff that goes with a raw cutoff."""
    return (cutoff * r2 + r1 + 0.5).cast("int")


def choose_mode(normalization: Sequence[dict], mode: int | None = None) -> dict:
    """The normalisation of a mode, or the one of least priority number (of equal ones the first)."""
    if not normalization:
        raise ValueError("no normalisation")
    if mode is None:
        return min(normalization, key=lambda n: n.get("priority") or 0)
    found = [n for n in normalization if n["mode"] == mode]
    if not found:
        raise ValueError(f"no normalisation of mode {mode}")
    return found[0]


def choose_level(cutoffs: Sequence[dict], level: int = 0, nearest: bool = False) -> dict:
    """The cutoff of a level; with ``nearest``, where there is none, that of the closest level, the higher of two."""
    found = [c for c in cutoffs if c["level"] == level]
    if not found and nearest and cutoffs:
        return min(cutoffs, key=lambda c: (abs(c["level"] - level), -c["level"]))
    if not found:
        raise ValueError(f"no cutoff of level {level}")
    return found[0]


def search_cutoffs(normalization: Sequence[dict], cutoffs: Sequence[dict], cutoff: str | float | None = None, mode: int | None = None, level: int = 0, nearest: bool = False) -> tuple[int, int | None]:
    """(raw, prefilter) cutoffs of a search.

    Without ``cutoff`` those of the level. A whole number is a raw cutoff, one
    with a point a normalised one of the mode, which must be linear. The
    prefilter's follows from the raw one by the normalisation of the negative
    mode, if there is one; else the level's serves for its own raw cutoff only.
    """
    own = next((c for c in cutoffs if c["level"] == level), None) if cutoff is not None else choose_level(cutoffs, level, nearest)
    if cutoff is None:
        raw = own["score"]
    elif isinstance(cutoff, int) or isinstance(cutoff, str) and "." not in cutoff:
        raw = int(cutoff)
    else:
        chosen = choose_mode([n for n in normalization if n["mode"] > 0], mode)
        if chosen["function"] != "LINEAR":
            raise ValueError("only a linear normalisation has a raw cutoff for all sequences")
        raw = math.floor((float(cutoff) - chosen["r"][0]) / chosen["r"][1] + 0.5)
    if own is not None and raw == own["score"] and own.get("h_score") is not None:
        return raw, own["h_score"]
    used = choose_mode([n for n in normalization if n["mode"] > 0], mode)["mode"] if any(n["mode"] > 0 for n in normalization) else 0
    h = next((n for n in normalization if n["mode"] == -used and used), None)
    return raw, int(raw * h["r"][1] + h["r"][0] + 0.5) if h else None


def level(score: Column, cutoffs: Sequence[tuple[int, int]], rule: str = "highest") -> Column:
    """The level of a raw score given (level, least score) pairs.

    'highest': the highest level reached; 'file_order': the first in the order
    given. Below all of them: one less than the last level looked at.
    """
    order = list(cutoffs) if rule == "file_order" else sorted(cutoffs, key=lambda c: -c[0])
    out = F.lit(order[-1][0] - 1)
    for n, least in reversed(order):
        out = F.when(score >= least, F.lit(n)).otherwise(out)
    return out


def level_tag(score: Column, cutoffs: Sequence[tuple], mode: int | None = None) -> Column:
    """The text of the highest cutoff (least score, text, modes) reached, else '#'.

    Cutoffs are looked at in the order given. With ``mode`` only those count that
    list it among their modes. One without a text leaves the tag as it is, but
    bars lower ones that follow.
    """
    best, tag = F.lit(-(1 << 62)), F.lit("#")
    for least, text, *modes in cutoffs:
        if mode is not None and mode not in (modes[0] if modes else ()):
            continue
        reached = (score >= least) & (F.lit(least) > best)
        tag = F.when(reached, F.lit(text)).otherwise(tag) if text else tag
        best = F.when(reached, F.lit(least)).otherwise(best)
    return tag


def composition(seq: Column, alphabet: str) -> Column:
    """Map of each letter to its share of the sequence (by its whole length; empty: 0)."""
    share = lambda a: F.coalesce((F.length(seq) - F.length(F.replace(seq, F.lit(a), F.lit("")))) / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))
    return F.create_map(*[x for a in alphabet for x in (F.lit(a), share(a))])


def rave(seq: Column, column_sums: dict[str, float]) -> Column:
    """Average match score of a sequence: each letter's share times its column sum."""
    out = F.lit(0.0)
    for a, s in column_sums.items():
        out = out + (F.length(seq) - F.length(F.replace(seq, F.lit(a), F.lit("")))) * F.lit(float(s))
    return F.coalesce(out / F.nullif(F.length(seq), F.lit(0)), F.lit(0.0))
