"""Profile models in other programs' text: hidden Markov models of both HMMER generations, GCG profiles.

A model is small and serves as a motif of a search, so it is parsed where the
search is planned. A database of many is read as one text a model.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import gcg_to_profile, hmm_to_profile
from ..operators.kernels import Profile

STEPS = ("mm", "mi", "md", "im", "ii", "id", "dm", "di", "dd")
AMINO, BASES = "ACDEFGHIKLMNPQRSTVWY", "ACGT"


@dataclass
class Model:
    """Chances by position: letters of each match and insertion, steps after each position (0: the begin)."""

    name: str = ""
    ac: str = ""
    description: str = ""
    alphabet: str = AMINO
    null: dict[str, float] = field(default_factory=dict)
    match: list[dict[str, float]] = field(default_factory=list)
    insert: list[dict[str, float]] = field(default_factory=list)
    trans: list[dict[str, float]] = field(default_factory=list)

    def profile(self, null: dict[str, float] | None = None) -> Profile:
        null = null or self.null or {a: 1 / len(self.alphabet) for a in self.alphabet}
        return hmm_to_profile(self.match, self.insert, self.trans, null)


def _odds(text: str, base: float = 1.0) -> float:
    """A chance from a log-odds score in thousandths of a bit; '*' is none."""
    return 0.0 if text == "*" else base * 2 ** (int(text) / 1000)


def parse_hmm2(text: str) -> Model:
    """A model of the second generation: scores of letters against the null model, of steps against one."""
    m, lines = Model(), [x for x in text.splitlines() if x.strip() and x.strip() != "//"]
    head = 0
    while not lines[head].startswith("HMM "):
        key, _, rest = lines[head].partition(" ")
        rest = rest.strip()
        if key == "NAME":
            m.name = rest
        elif key == "ACC":
            m.ac = rest
        elif key == "DESC":
            m.description = rest
        elif key == "ALPH":
            m.alphabet = AMINO if rest.lower().startswith("amino") else BASES
        elif key == "NULE":
            m.null = {a: _odds(v, 1 / len(m.alphabet)) for a, v in zip(m.alphabet, rest.split(), strict=False)}
        head += 1
    letters = "".join(re.findall(r"[A-Z]", lines[head][3:]))
    m.null = m.null or {a: 1 / len(letters) for a in letters}
    m.alphabet, rows = letters, lines[head + 3 :]
    begin = lines[head + 2].split()
    stay, skip = _odds(begin[0]), _odds(begin[2])
    m.trans.append(dict.fromkeys(STEPS, 0.0) | {"mm": stay, "md": skip, "dm": stay, "dd": skip})
    m.insert.append(dict(m.null))
    for k in range(0, len(rows) - 2, 3):
        own, put, step = (rows[k + i].split() for i in range(3))
        m.match.append({a: _odds(v, m.null[a]) for a, v in zip(letters, own[1:], strict=False)})
        m.insert.append({a: _odds(v, m.null[a]) for a, v in zip(letters, put[1:], strict=False)})
        mm, mi, md, im, ii, dm, dd = (_odds(v) for v in step[1:8])
        m.trans.append(dict.fromkeys(STEPS, 0.0) | {"mm": mm, "mi": mi, "md": md, "im": im, "ii": ii, "dm": dm, "dd": dd})
    if not any(m.trans[-1].values()):  # the last position has no steps of its own
        m.trans[-1] |= {"mm": 1.0, "im": 1.0, "dm": 1.0}
    if not any(m.insert[-1].values()):
        m.insert[-1] = dict(m.null)
    return m


def parse_hmm1(text: str) -> Model:
    """A model of the first generation: length, size of the alphabet, its kind, its letters and two flags; then one number a line.

    For each position from 0: steps from match (to match, delete, insert) and
    its letters; from delete (match, delete, insert); from insert (match,
    delete, insert) and its letters.
    """
    lines = [x.split("#")[0].strip() for x in text.splitlines() if not x.startswith("#") and x.strip() != "//"]
    lines = [x for x in lines if x]
    size, letters = int(lines[0].split()[0]), int(lines[1].split()[0])
    m = Model(alphabet=lines[3].split()[0][:letters].upper())
    values = [float(x) for line in lines[6:] for x in line.split()]
    width, at = 9 + 2 * letters, 0
    for k in range(size + 1):
        row = values[at : at + width]
        if len(row) < width:
            raise ValueError(f"the model ends within position {k}")
        at += width
        steps = dict(zip(("mm", "md", "mi"), row[:3], strict=True))
        own = row[3 : 3 + letters]
        steps |= dict(zip(("dm", "dd", "di"), row[3 + letters : 6 + letters], strict=True)) | dict(zip(("im", "id", "ii"), row[6 + letters : 9 + letters], strict=True))
        if k:
            m.match.append(dict(zip(m.alphabet, own, strict=True)))
        m.insert.append(dict(zip(m.alphabet, row[9 + letters :], strict=True)))
        m.trans.append(steps)
    return m


def hmm1_text(m: Model, name: str = "") -> str:
    """The text that ``parse_hmm1`` reads."""
    out = ["# HMM v1.7", f"{len(m.match)}\t# length of {name or m.name or 'model'}", f"{len(m.alphabet)}\t# letters", f"{3 if len(m.alphabet) > 4 else 2}\t# kind of alphabet", f"{m.alphabet}\t# alphabet", "no\t# optional line", "no\t# optional line"]
    show = lambda row, keys: [f"{row.get(k, 0.0):.6f}" for k in keys]
    for k in range(len(m.match) + 1):
        own = m.match[k - 1] if k else dict.fromkeys(m.alphabet, 0.0)
        out += [f"# position {k}", *show(m.trans[k], ("mm", "md", "mi")), *show(own, m.alphabet), *show(m.trans[k], ("dm", "dd", "di")), *show(m.trans[k], ("im", "id", "ii")), *show(m.insert[k], m.alphabet)]
    return "\n".join(out) + "\n"


def sam_text(m: Model) -> str:
    """The model as a SAM model in text: for each node what leads to it from the node before and its own letters' chances.

    A node has three rows of steps (into its deletion, its match, and its
    insertion; from deletion, match and insertion), then match and insertion chances
    of the letters, five a row, of bases four. Nodes are Begin, the positions (the last
    is numbered -1) and End. Alphabets are the twenty amino acids or four bases.
    """
    kinds = {20: "protein", 4: "DNA"}
    if len(m.alphabet) not in kinds:
        raise ValueError(f"no such alphabet of a SAM model: {m.alphabet}")
    size, per = len(m.match), 5 if len(m.alphabet) == 20 else 4
    none = dict.fromkeys(m.alphabet, 0.0)
    out = [f"% model {m.name}".rstrip(), "MODEL:", f"alphabet {kinds[len(m.alphabet)]}"]

    def rows(values: list[float], width: int) -> None:
        out.extend(" ".join(f"{v:.6f}" for v in values[i : i + width]) for i in range(0, len(values), width))

    for k in range(size + 2):
        before, own = (m.trans[k - 1] if k else {}), (m.trans[k] if k <= size else {})
        end = k > size
        into = [0.0 if end else before.get(s + "d", 0.0) for s in "dmi"] + [before.get(s + "m", 0.0) for s in "dmi"]
        stay = [own.get(s + "i", 0.0) if k or s != "d" else 0.0 for s in "dmi"]
        out += ["", "Begin" if not k else "End" if end else "-1" if k == size else str(k)]
        rows(into + stay, 3)
        for chances in (m.match[k - 1] if 0 < k <= size else none, none if end else m.insert[k]):
            rows([chances.get(a, 0.0) for a in m.alphabet], per)
    return "\n".join([*out, "ENDMODEL"]) + "\n"


def parse_sam(text: str) -> Model:
    """What ``sam_text`` wrote."""
    body = re.sub(r"(?m)^%.*$", "", text).split("MODEL:", 1)[1].split("ENDMODEL")[0].split()
    m = Model(alphabet=AMINO if body[1] == "protein" else BASES)
    n = len(m.alphabet)
    nodes = [[float(v) for v in body[i + 1 : i + 10 + 2 * n]] for i in range(2, len(body), 10 + 2 * n)]
    for k, node in enumerate(nodes):
        if k:
            m.trans[-1] |= {s + "d": v for s, v in zip("dmi", node[:3], strict=True)} | {s + "m": v for s, v in zip("dmi", node[3:6], strict=True)}
        if k + 1 == len(nodes):
            break
        if k:
            m.match.append(dict(zip(m.alphabet, node[9 : 9 + n], strict=True)))
        m.insert.append(dict(zip(m.alphabet, node[9 + n :], strict=True)))
        m.trans.append({s + "i": v for s, v in zip("dmi", node[6:9], strict=True)})
    return m


def reordered(null: dict[str, float], alphabet: str) -> dict[str, float]:
    """A null model in the order of a model's letters, summing to one over them; a letter it lacks is an error."""
    missing = [a for a in alphabet if a not in null]
    if missing:
        raise ValueError(f"no frequency of {', '.join(missing)}")
    total = sum(null[a] for a in alphabet)
    return {a: null[a] / total for a in alphabet}


def parse_gcg(text: str) -> tuple[str, list[tuple[str, list[float], float, float]], dict[str, str]]:
    """(alphabet, rows of (consensus, scores, gap, length), ID, AC and DE of the comments) of a GCG profile."""
    alphabet, rows, notes = "", [], {}
    for line in text.splitlines():
        note = re.match(r"#\s*(ID|AC|DE)\s+(.*)", line)
        if note:
            notes[note[1]] = note[2].strip()
        elif line.lstrip().startswith("Cons"):
            alphabet = "".join(w for w in line.split() if re.fullmatch("[A-Z]", w))
        elif alphabet and line.lstrip().startswith("*"):
            break
        elif alphabet and line.strip() and not line.lstrip().startswith("!"):
            w = line.split()
            rows.append((w[0], [float(v) for v in w[1 : 1 + len(alphabet)]], float(w[1 + len(alphabet)]), float(w[2 + len(alphabet)])))
    return alphabet, rows, notes


def gcg_profile(text: str, **options) -> Profile:
    alphabet, rows, _ = parse_gcg(text)
    return gcg_to_profile(rows, alphabet, **options)


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of each model of a database in which models end with '//'."""
    raw = spark.read.option("lineSep", "\n//").text(path)
    return raw.select(F.regexp_replace("value", r"^\s+", "").alias("value")).where("value <> ''")


def read_hmms(spark: SparkSession, path: str) -> list[Model]:
    """All models of a database, of either generation."""
    return [(parse_hmm2 if r.value.startswith("HMMER2") else parse_hmm1)(r.value) for r in texts(spark, path).toLocalIterator()]
