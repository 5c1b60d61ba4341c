"""Motif databases in PROSITE text: profiles, patterns and their metadata.

An entry is small, so entries are parsed on the driver when they serve as
motifs of a search, and in tasks when a whole database is a table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kernels import NEG, STATES, Profile

_BLOCK = re.compile(r"/([A-Z_]+):((?:[^/']|'[^']*')*)")
_FIELD = re.compile(r"\s*([A-Z0-9_]+)\s*=\s*((?:'[^']*'|[^;'])*);?")
_BORDER = ("b0", "b1", "e0", "e1", "bm", "bi", "bd", "me", "ie", "de")
_TRANS = tuple(a + b for a in STATES for b in STATES)


@dataclass
class Entry:
    """One motif: its text lines by code, and what a profile's MA lines say."""

    id: str = ""
    type: str = ""
    ac: str = ""
    date: str = ""
    description: str = ""
    pattern: str = ""
    topology: str = "LINEAR"
    profile: Profile | None = None
    disjoint: dict = field(default_factory=dict)
    normalization: list[dict] = field(default_factory=list)
    cutoffs: list[dict] = field(default_factory=list)
    skip: bool = False
    rules: list[dict] = field(default_factory=list)
    known: list[tuple] = field(default_factory=list)


def _score(text: str) -> int:
    text = text.strip().strip("'")
    return NEG if text == "*" else int(float(text))


def _fields(body: str) -> dict[str, str]:
    return {k: v.strip() for k, v in _FIELD.findall(body)}


def parse(text: str) -> Entry:
    """An entry (the lines up to '//')."""
    e, ma, de, pa = Entry(), [], [], []
    for line in text.splitlines():
        code, rest = line[:2], line[5:].strip()
        if code == "ID":
            name, _, kind = rest.rstrip(".").partition(";")
            e.id, e.type = name.strip(), kind.strip()
        elif code == "AC":
            e.ac = rest.split(";")[0]
        elif code == "DT":
            e.date = rest
        elif code == "DE":
            de.append(rest)
        elif code == "PA":
            pa.append(rest)
        elif code == "MA":
            ma.append(rest)
        elif code == "CC" and "/SKIP-FLAG=TRUE" in rest:
            e.skip = True
        elif code == "PP":
            kind, _, args = rest.partition(":")
            e.rules += [{"type": kind.strip(), "effector": a.split("=")[0].strip(), "value": a.partition("=")[2].strip()} for a in args.rstrip(";.").split(";") if a.strip()]
        elif code == "DR":
            e.known += [(a.strip(), b.strip(), c) for a, b, c in re.findall(r"(\w+)\s*,\s*(\w+)\s*,\s*([TPNF?])\s*;", rest)]
    e.description, e.pattern = " ".join(de), "".join(pa).rstrip(".")
    if ma:
        _profile(e, " ".join(ma))
    return e


def _profile(e: Entry, text: str) -> None:
    blocks = _BLOCK.findall(text)
    alphabet, size = "", 0
    inserts: list[dict] = []
    matches: list[dict] = []
    base = _builtin()
    default = dict(base)
    for kind, body in blocks:
        got = _fields(body)
        if kind == "GENERAL_SPEC":
            alphabet, size = got["ALPHABET"].strip("'"), int(got["LENGTH"])
            e.topology = got.get("TOPOLOGY", "LINEAR").strip("'")
        elif kind == "DISJOINT":
            e.disjoint = {"definition": got["DEFINITION"].strip("'"), "n1": int(got.get("N1", 1)), "n2": int(got.get("N2", size))}
        elif kind == "NORMALIZATION":
            mode = int(got.get("MODE", 1))
            e.normalization.append({"mode": mode, "function": got["FUNCTION"].strip("'"), "r": [float(got[f"R{k}"]) for k in range(1, 6) if f"R{k}" in got], "priority": int(got.get("PRIORITY", mode)), "text": got.get("TEXT", "").strip("'")})
        elif kind == "CUT_OFF":
            e.cutoffs.append({"level": int(got["LEVEL"]), "score": int(got["SCORE"]), "h_score": int(got["H_SCORE"]) if "H_SCORE" in got else None, "n_score": [float(x) for x in got.get("N_SCORE", "").split(",") if x.strip()], "mode": [int(x) for x in got.get("MODE", "").split(",") if x.strip()], "text": got.get("TEXT", "").strip("'")})
        elif kind == "DEFAULT":
            default = {**default, **got} if got else dict(base)
        elif kind == "I":
            while len(inserts) > len(matches):  # an implied match position between two inserts
                matches.append(dict(default))
            inserts.append({**default, **got})
        elif kind == "M":
            while len(inserts) <= len(matches):
                inserts.append(dict(default))
            matches.append({**default, **got})
    while len(matches) < size:
        matches.append(dict(default))
    while len(inserts) <= size:
        inserts.append(dict(default))
    letters = len(alphabet)
    row = lambda x, name: [_score(x.get(f"{name}0", "0"))] + [_score(v) for v in _spread(x.get(name, "0"), letters)]
    column = lambda name: np.array([_score(x[name.upper()]) for x in inserts], np.int64)
    if not any(c["level"] == 0 for c in e.cutoffs) and e.cutoffs:
        raise ValueError(f"{e.ac}: no cutoff of level 0")
    n1, n2 = e.disjoint.get("n1", 1), e.disjoint.get("n2", size)
    if not 1 <= n1 <= size or not 1 <= n2 <= size:
        n1, n2 = 1, size
    e.profile = Profile(
        alphabet, np.array([row(x, "M") for x in matches], np.int64).reshape(size, letters + 1), np.array([row(x, "I") for x in inserts], np.int64),
        np.array([_score(x.get("D", "0")) for x in matches], np.int64), {t: column(t) for t in _TRANS}, {b: column(b) for b in _BORDER},
        min(n1, n2), max(n1, n2), e.ac, "".join(x.get("SY", x.get("SY_M", "X")).strip("'")[:1] or "X" for x in matches),
        circular=e.topology.upper() == "CIRCULAR",
    )


def _builtin() -> dict[str, str]:
    """Scores before any default: 0, but forbidden for the steps listed."""
    out = {k.upper(): "0" for k in (*_TRANS, *_BORDER)} | {"M": "0", "I": "0", "D": "0", "M0": "0", "I0": "0"}
    return out | dict.fromkeys(("BI", "BD", "DE", "IE", "MI", "MD", "ID", "IM", "DM", "DI"), "*")


def _spread(text: str, n: int) -> list[str]:
    parts = [p for p in text.split(",") if p.strip()]
    return parts * n if len(parts) == 1 else parts


def serialize(e: Entry) -> str:
    """An entry as text that ``parse`` reads back."""
    out = [f"ID   {e.id}; {e.type}.", f"AC   {e.ac};"]
    out += [f"DT   {e.date}"] * bool(e.date) + [f"DE   {e.description}"] * bool(e.description)
    out += [f"PA   {e.pattern}."] * bool(e.pattern)
    show = lambda v: "*" if v <= NEG // 2 else str(int(v))
    if e.profile is not None:
        p = e.profile
        out.append(f"MA   /GENERAL_SPEC: ALPHABET='{p.alphabet}'; LENGTH={p.length}; TOPOLOGY={e.topology};")
        out.append(f"MA   /DISJOINT: DEFINITION={e.disjoint.get('definition', 'PROTECT')}; N1={p.n1}; N2={p.last};")
        for n in e.normalization:
            r = " ".join(f"R{k}={v!r};" for k, v in enumerate(n["r"], 1))
            out.append(f"MA   /NORMALIZATION: MODE={n['mode']}; FUNCTION={n['function']}; {r} PRIORITY={n['priority']}; TEXT='{n['text']}';")
        for c in e.cutoffs:
            h = f" H_SCORE={c['h_score']};" if c.get("h_score") is not None else ""
            out.append(f"MA   /CUT_OFF: LEVEL={c['level']}; SCORE={c['score']};{h} N_SCORE={','.join(map(repr, c['n_score']))}; MODE={','.join(map(str, c['mode']))}; TEXT='{c['text']}';")
        for k in range(p.length + 1):
            marks = [f"{n.upper()}={show(v[k])};" for v, n in [(p.trans[t], t) for t in _TRANS] + [(p.border[b], b) for b in _BORDER]]
            out.append(f"MA   /I: I0={show(p.insert[k, 0])}; I={','.join(map(show, p.insert[k, 1:]))}; {' '.join(marks)}")
            if k < p.length:
                out.append(f"MA   /M: SY='{(p.consensus or 'X' * p.length)[k]}'; M0={show(p.match[k, 0])}; M={','.join(map(show, p.match[k, 1:]))}; D={show(p.delete[k])};")
    out += [f"PP   /{r['type'].lstrip('/')}: {r['effector']}={r['value']};" for r in e.rules]
    return "\n".join([*out, "//"])


def read_entries(spark: SparkSession, path: str) -> list[Entry]:
    """All entries of a database, parsed on the driver."""
    rows = spark.read.option("lineSep", "\n//").text(path).toLocalIterator()
    return [parse(r.value.strip("\n")) for r in rows if re.search(r"(?m)^ID ", r.value)]


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row an entry, without its tables.

    Columns: ac, id, type, description, pattern, doc, skip, taxo_range, max_repeat,
    n_false, sites (position, name), cutoffs (a map of each CUT_OFF line's fields),
    rules (type, discriminators) of its post-processing lines. An entry has empty
    arrays for lines it doesn't have.
    """
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.concat(F.lit("\n"), F.ltrim("value")).alias("r")).where(F.col("r").rlike("\nID "))
    one = lambda p: F.regexp_extract("r", p, 1)
    joined = lambda code, sep: F.array_join(F.transform(F.regexp_extract_all("r", F.lit(rf"\n{code}   ([^\n]*)"), F.lit(1)), lambda x: F.trim(x)), sep)
    found = lambda p, k=1: F.regexp_extract_all("r", F.lit(p), F.lit(k))
    site = r"/SITE=(\d+),([^;\n]*);"
    sites = F.zip_with(found(site), found(site, 2), lambda a, b: F.struct(a.cast("int").alias("position"), b.alias("name")))
    fields = lambda line: F.filter(F.split(line, r";\s*"), lambda x: x.contains("="))
    pair = lambda x: F.struct(F.substring_index(x, "=", 1), F.substr(x, F.instr(x, "=") + 1))
    cutoffs = F.transform(found(r"\nMA   /CUT_OFF:\s*([^\n]*)"), lambda line: F.map_from_entries(F.transform(fields(line), pair)))
    pp = r"\nPP   /?(\w+):\s*([^\r\n]+)"
    rules = F.zip_with(found(pp), found(pp, 2), lambda a, b: F.struct(a.alias("type"), F.filter(F.split(b, r";\s*"), lambda x: x != "").alias("discriminators")))
    return raw.select(
        one(r"\nAC   ([^;\n]*)").alias("ac"), one(r"\nID   ([^;\n]*)").alias("id"), one(r"\nDO   (\w+)").alias("doc"), one(r"\nID   [^;\n]*;\s*([A-Z]+)").alias("type"), joined("DE", " ").alias("description"),
        F.regexp_replace(joined("PA", ""), r"\.$", "").alias("pattern"), F.col("r").contains("/SKIP-FLAG=TRUE").alias("skip"), one(r"/TAXO-RANGE=([^;\n]*)").alias("taxo_range"),
        one(r"/MAX-REPEAT=(\d+)").try_cast("int").alias("max_repeat"), F.regexp_count("r", F.lit(r",\s*F\s*;")).alias("n_false"),
        sites.alias("sites"), cutoffs.alias("cutoffs"), rules.alias("rules"),
    )


def read_known_matches(spark: SparkSession, path: str) -> DataFrame:
    """(motif_ac, seq_ac, entry_name, state) of the DR lines; states T, P, N, F, ?."""
    raw = spark.read.option("lineSep", "\n//").text(path).select(F.concat(F.lit("\n"), F.ltrim("value")).alias("r"))
    ac = F.regexp_extract("r", r"\nAC   ([^;\n]*)", 1).alias("motif_ac")
    each = raw.select(ac, F.explode(F.regexp_extract_all("r", F.lit(r"(\w+\s*,\s*\w+\s*,\s*[TPNF?])\s*;"), F.lit(1))).alias("d"))
    part = lambda k: F.trim(F.split("d", ",")[k])
    return each.select("motif_ac", part(0).alias("seq_ac"), part(1).alias("entry_name"), part(2).alias("state"))


def positions(e: Entry):
    """Rows (position, symbol, letter, match score) of a profile, for a table of its scores."""
    p = e.profile
    return [(k + 1, (p.consensus or "")[k : k + 1], a, None if p.match[k, i + 1] <= NEG // 2 else int(p.match[k, i + 1])) for k in range(p.length) for i, a in enumerate(p.alphabet)]


def split_database(spark: SparkSession, path: str, out: str) -> None:
    """Entries in folders by type and accession."""
    raw = spark.read.option("lineSep", "\n//").text(path).where(F.col("value").rlike("(?m)^ID "))
    ac, kind = F.regexp_extract("value", r"(?m)^AC   ([^;\n]*)", 1), F.regexp_extract("value", r"(?m)^ID   [^;\n]*;\s*([A-Z]+)", 1)
    raw.select(F.concat(F.ltrim("value"), F.lit("\n//")).alias("value"), kind.alias("type"), ac.alias("ac")).write.mode("overwrite").partitionBy("type", "ac").text(out)
