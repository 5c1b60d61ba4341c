"""A Merkle manifest of a table: a digest tree per source, and every row's proof.

Leaves are hashed by built-in functions and ranked in their source by a range
sort, so a source of any size is spread over many tasks. The tree is cut into
aligned blocks of ``ARITY ** DEPTH`` leaves. Within a block a traversal goes from
leaf to leaf and keeps only the present path and the stacks that build the next
nodes (``Traversal``). The blocks' top nodes are the leaves of the next, much
smaller tree, and so on up to one node a source; the sources' nodes make the
last tree. The upper paths, one a block, are appended to the rows of a block by
a join. No step holds more than a block in a task, nothing goes to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut

#: Nodes of a run.
ARITY = 3
#: Levels of a block: 729 leaves.
DEPTH = 6
#: What a document's leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = T.ArrayType(T.StructType([T.StructField("l", T.StringType()), T.StructField("r", T.StringType())]))


def digest(nodes) -> str:
    """The node over a run: SHA-256 of its nodes' hexadecimal digits."""
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields: '-' for null, else bytes in UTF-8, ':', value."""
    own = [x.cast("string") for x in fields]
    parts = [F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x)) for x in own]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


class _Treehash:
    """The node of a height over leaves from ``at`` to ``end``, made leaf by leaf on a stack of at most two nodes a height."""

    def __init__(self, height: int, at: int, end: int):
        self.height, self.at, self.end = height, at, end
        self.stack: list[tuple[int, str]] = []
        self.node: str | None = None

    def tail(self) -> int:
        return self.stack[-1][0] if self.stack else self.height

    def step(self, leaves) -> None:
        self.stack.append((0, leaves[self.at]))
        self.at += 1
        h = 0
        while h < self.height and len(self.stack) >= ARITY and self.stack[-ARITY][0] == h:
            self._fold(h, ARITY)
            h += 1
        if self.at == self.end:  # the last runs may have fewer nodes
            for h in range(self.height):
                k = sum(x == h for x, _ in self.stack)
                if k:
                    self._fold(h, k)
            self.node = self.stack.pop()[1]

    def _fold(self, h: int, k: int) -> None:
        node = digest(x for _, x in self.stack[-k:])
        self.stack[-k:] = [(h + 1, node)]


class _Run:
    """The nodes of one run of a level, built one after the other."""

    def __init__(self, level: int, number: int, size: int):
        span = ARITY**level
        self.level, self.nodes = level, []
        self.todo = [_Treehash(level, a, min(a + span, size)) for a in range(number * ARITY * span, min((number + 1) * ARITY * span, size), span)][::-1]

    def step(self, leaves) -> None:
        self.todo[-1].step(leaves)
        if self.todo[-1].node is not None:
            self.nodes.append(self.todo.pop().node)

    def finish(self, leaves) -> list[str]:
        while self.todo:
            self.step(leaves)
        return self.nodes


class Traversal:
    """The paths of a block's leaves in order, in memory that grows with the logarithm of the block.

    Each level keeps the run that the present leaf's path goes through, and the
    next run of the level is in the making. After each leaf there is one unit
    of work a level; a unit goes to the run whose stack has the lowest node on
    top, of equal ones to the lowest level, so that few stacks are high at a
    time, and every run is ready when its first leaf comes.
    """

    def __init__(self, leaves, depth: int):
        self.leaves, self.depth, size = leaves, depth, len(leaves)
        self.now = [_Run(h, 0, size).finish(leaves) for h in range(depth)]
        self.next = [_Run(h, 1, size) for h in range(depth)]

    def top(self) -> str:
        return digest(self.now[-1]) if self.depth else self.leaves[0]

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each leaf and level the nodes left and right of its own in the run."""
        for t in range(len(self.leaves)):
            path, at = [], t
            for run in self.now:
                at, p = divmod(at, ARITY)
                path.append(("".join(run[:p]), "".join(run[p + 1 :])))
            yield path
            for _ in range(self.depth):
                live = [run for run in self.next if run.todo]
                if not live:
                    break
                min(live, key=lambda run: (run.todo[-1].tail(), run.level)).step(self.leaves)
            for h in range(self.depth):
                span = ARITY ** (h + 1)
                if (t + 1) % span:
                    break
                self.now[h] = self.next[h].finish(self.leaves)
                self.next[h] = _Run(h, (t + 1) // span + 1, len(self.leaves))


def _depth(n: int, size: int, depth: int = DEPTH) -> int:
    """Levels in a block of ``size`` leaves of a tree of ``n``: up to the block's own height, or until one node is left."""
    if n > ARITY**depth:
        return depth
    h = 0
    while ARITY**h < size:
        h += 1
    return h


def _block(names: list[str], depth: int):
    def step(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves, n = table.column("node").to_pylist(), table.column("n")[0].as_py()
        walk = Traversal(leaves, _depth(n, len(leaves), depth))
        top = walk.top()
        paths = [[{"l": a, "r": b} for a, b in path] for path in walk.paths()]
        out = table.select(names)
        kind = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))
        return out.append_column("path", pa.array(paths, kind)).append_column("top", pa.array([top] * len(leaves)))

    return step


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """nodes with pos (from 0, in the group, by ``order``, nulls first) and n (rows of the group).

    Rows are sorted by ranges of all keys, so no group has to fit a task; ranks
    are offsets within a range plus the rows of the group in earlier ranges.
    """
    placed = cut(nodes.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("_at", 33)
    starts = placed.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    w = W.partitionBy("_group")
    starts = starts.withColumns({"n": F.sum("_rows").over(w), "_before": F.sum("_rows").over(w.orderBy("_part")) - F.col("_rows")})
    met = placed.join(starts, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return met.withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before")).select(*nodes.columns, "pos", "n")


def climb(placed: DataFrame, group: str, depth: int = DEPTH) -> list[DataFrame]:
    """Tables of the tree, lowest first, written: rows with their path within the block (``path``) and the block's top node (``top``).

    placed: group, pos, n, node and what else rows carry. The second table has the
    first one's blocks as rows, and so on; in the last, no group has two blocks.
    """
    size, out = ARITY**depth, []
    most = placed.agg(F.max("n")).first()[0] or 0
    while True:
        block = F.floor(F.col("pos") / size)
        kind = T.StructType([*(T.StructField(f.name, f.dataType) for f in placed.schema.fields), T.StructField("path", _PATH), T.StructField("top", T.StringType())])
        names = placed.columns
        made = cut(placed.groupBy(group, block.alias("_block")).applyInArrow(_block(names, depth), kind), "merkle-paths")
        out.append(made)
        if most <= size:
            return out
        most = -(-most // size)
        placed = made.where(F.col("pos") % size == 0).select(group, F.floor(F.col("pos") / size).alias("pos"), F.ceil(F.col("n") / size).alias("n"), F.col("top").alias("node"))


def joined(tables: list[DataFrame], group: str, above: DataFrame | None = None, depth: int = DEPTH) -> DataFrame:
    """The rows of the lowest table with whole paths and subroot (the group's last node).

    above (group, path, and more columns) is appended to all rows of a group.
    """
    last = tables[-1]
    tops = last.where("pos = 0").select(F.col(group).alias("_group"), F.lit(0).cast("long").alias("_pos"), F.col("top").alias("subroot"))
    more = []
    if above is not None:
        more = [c for c in above.columns if c not in (group, "path")]
        up = above.select(F.col(group).alias("_own"), F.col("path").alias("_up"), *more)
        tops = tops.join(up, F.col("_group").eqNullSafe(F.col("_own"))).drop("_own")
    else:
        tops = tops.withColumn("_up", F.array().cast(_PATH))
    for table in reversed(tables):
        block = F.floor(F.col("pos") / ARITY**depth)
        own = table.join(tops, F.col(group).eqNullSafe(F.col("_group")) & (block == F.col("_pos"))).withColumn("path", F.concat("path", "_up"))
        if table is tables[0]:
            return own.drop("_group", "_pos", "_up", "top")
        tops = own.select(F.col(group).alias("_group"), F.col("pos").alias("_pos"), "subroot", *more, F.col("path").alias("_up"))
    raise AssertionError


def fold(node: Column, path: Column) -> Column:
    """The root that a leaf's node and a path lead to."""
    return F.aggregate(path, node, lambda acc, x: F.sha2(F.concat(x["l"], acc, x["r"]).cast("binary"), 256))


def proof(path: Column) -> Column:
    """SHA-256 of a path's nodes, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["l"], x["r"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, carry: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """One row for each row of docs: key, group, leaf, pos (rank in the group), n, subroot, root, path (l and r: the nodes left and right of the row's own, level by level).

    Per group rows ascend by key (null first), of equal keys by leaf; every
    ``ARITY`` consecutive nodes make one of the next level until one is left;
    the groups' nodes, ordered by group (null first, by bytes), make the root in
    the same way. ``depth``: levels of a block. ``carry``: further columns of the result, made of docs' columns.
    Equal rows are leaves of their own. Null fields differ from empty ones. An
    empty table has no rows. Columns of docs beyond key, group and fields are left
    out and may have any name.
    """
    nodes = docs.select(F.col(key).alias("_key"), F.col(group).cast("string").alias("_source"), leaf([F.col(x) for x in fields]).alias("node"), *(v.alias(f"_c{k}") for k, v in enumerate((carry or {}).values())))
    written = cut(nodes, "merkle-leaves")
    rows = climb(ranked(written, "_source", ["_key", "node"]), "_source", depth)
    groups = rows[-1].where("pos = 0").select("_source", F.col("top").alias("node"), F.lit(0).alias("_all"))
    over = climb(ranked(groups, "_all", ["_source"]), "_all", depth)
    above = joined(over, "_all", depth=depth).select("_source", "path", F.col("subroot").alias("root"))
    drop_cut(written)
    out = joined(rows, "_source", above, depth)
    return out.select(F.col("_key").alias(key), F.col("_source").alias(group), F.col("node").alias("leaf"), "pos", "n", "subroot", "root", "path", *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry or {})))


def tamper_check(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The manifest of documents, and whether each row still leads to the root after half of them lost their line ends.

    Rows whose crc32 of the decimal doc_id is even are tampered with: the line
    feeds of the text are deleted (a null text, and a row with a null doc_id, stay).
    """
    without = F.translate(F.col("text"), "\n", "")
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    seen = leaf([F.when(even, without).otherwise(F.col("text")) if x == "text" else F.col(x) for x in FIELDS])
    made = manifest(docs, carry={"seen": seen}, depth=depth)
    out = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), fold(F.col("seen"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _level(rows: str, k: int, group: str) -> str:
    """SQL for one level: the nodes above level k, and for each node what stands left and right of it."""
    return f"""
{rows}r{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {group}) AS n, string_agg(d, '') OVER (PARTITION BY {group}, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l,
  string_agg(d, '') OVER (PARTITION BY {group}, i // 3 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM {rows}{k}),
{rows}{k + 1} AS MATERIALIZED (SELECT {group}, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d FROM {rows}r{k} GROUP BY {group}, i // 3)"""


def _walk(name: str, rows: str, k: int, group: str, up: str) -> str:
    return f"""
{name}{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (w.{up} // 3 AS {up}, CASE WHEN x.n > 1 THEN proof || coalesce(x.l, '') || coalesce(x.r, '') ELSE proof END AS proof,
  CASE WHEN x.n > 1 THEN sha256(coalesce(x.l, '') || seen || coalesce(x.r, '')) ELSE seen END AS seen) FROM {name}{k} w JOIN {rows}r{k} x ON w.{group} IS NOT DISTINCT FROM x.{group} AND w.{up} = x.i)"""


def _sql(levels: int = 12, top: int = 5) -> str:
    """The same rows in DuckDB, for sources of up to 3 ** levels rows and up to 3 ** top sources."""
    value = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR))::VARCHAR || ':' || {x}::VARCHAR END"
    row = lambda text: "sha256(" + " || ".join(value(x) for x in (*FIELDS[:-1], text)) + ")"
    # crc32 (reflected, polynomial EDB88320) of a decimal number: byte after byte, bit after bit
    bit = "list_reduce([b] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, x: xor(c >> 8, list_transform([xor(c & 255, x)], lambda b: {bit})[1])), 4294967295)"
    parts = [
        f"h AS MATERIALIZED (SELECT doc_id, source, {row('text')} AS d, {row('body')} AS seen FROM (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS body FROM documents))",
        "a AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, d) - 1 AS i FROM h)",
        "n0 AS (SELECT source, i, d FROM a)",
        "w0 AS (SELECT doc_id, source, d AS leaf, i, '' AS proof, seen FROM a)",
    ]
    for k in range(levels):
        parts += [_level("n", k, "source"), _walk("w", "n", k, "source", "i")]
    parts += [
        f"s AS MATERIALIZED (SELECT source, d, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i, 0 AS g FROM n{levels})",
        "t0 AS (SELECT g, i, d FROM s)",
        f"v0 AS (SELECT w.doc_id, w.leaf, s.d AS subroot, 0 AS g, s.i, w.proof, w.seen FROM w{levels} w JOIN s ON w.source IS NOT DISTINCT FROM s.source)",
    ]
    for k in range(top):
        parts += [_level("t", k, "g"), _walk("v", "t", k, "g", "i")]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, (SELECT d FROM t{top}) AS root, sha256(proof) AS proof_sha256, seen AS folded_root, seen = (SELECT d FROM t{top}) AS verified FROM v{top}"


SQL = _sql()
