"""Chat formatting with tool calls linked to their results.

DataFrame functions only. A message whose text is a JSON object may carry tool
calls, ``{"tool_calls": [{"id", "name", "arguments"}], "content"}``, be the
result of one, ``{"tool_call_id", "content"}``, or both; any other text is the
content as it stands. Calls and results meet in a hash join on conversation and
identifier. A result depends on the message of its call, and so chains of
calls, results that call again, and their results have a topological order; it
is found by doubling: each round a message looks as far up its chain as the
message it has reached does. Arguments are checked against the schema of the
tool, and each message is written as one line of canonical JSON: keys in order
at every depth, no spare blanks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Argument schemas by tool: argument -> (type, required). Types as in JSON Schema.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "calculate": {"expression": ("string", True)},
}
#: How a variant's schema names each JSON type.
_TYPES = {
    "string": "^STRING$",
    "integer": "^BIGINT$",
    "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
    "null": "^VOID$",
}
_CALLS = "array<struct<id string, name string, arguments string>>"


def valid_arguments(name: Column, arguments: Column, schemas: Mapping = SCHEMAS) -> Column:
    """True if ``arguments`` (JSON text) is an object that the tool's schema admits; unknown tools and malformed text are false."""
    doc = F.try_parse_json(arguments)
    out = F.lit(False)
    for tool, fields in schemas.items():
        known = F.array(*[F.lit(k) for k in fields]) if fields else F.array().cast("array<string>")
        good = F.schema_of_variant(doc).startswith("OBJECT<") & (F.size(F.array_except(F.json_object_keys(arguments), known)) == 0)
        for key, (kind, required) in fields.items():
            value = F.try_variant_get(doc, f"$['{key}']", "variant")
            fits = F.schema_of_variant(value).rlike(_TYPES[kind])
            good = good & F.coalesce(fits, F.lit(not required))
        out = F.when(name == tool, F.coalesce(good, F.lit(False))).otherwise(out)
    return out


def _chains(links: DataFrame) -> DataFrame:
    """(row, depth, top) of each message that is a result: how many links are above it, and the latest turn of itself and those.

    ``links`` has (row, up, depth, top), one row a message. Each round doubles
    how far ``up`` is, until it is a message without a call of its own above.
    Messages on a cycle of links or below one never get there and are left out.
    """
    now, open_ = cut(links, "links"), None
    while True:
        above = now.select(F.col("row").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("top").alias("top2"))
        seen = now.join(above, "up", "left")
        n = now.join(above, "up", "left_semi").count()
        if n == 0:
            return now.select("row", "depth", "top")
        if n == open_:
            return now.join(above, "up", "left_anti").select("row", "depth", "top")
        longer = seen.select("row", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth"), F.greatest("top", "top2").alias("top"))
        # on a cycle the depth would double for ever
        after, open_ = cut(longer.withColumn("depth", F.least("depth", F.lit(1 << 40))), "links"), n
        drop_cut(now)
        now = after


def format_chat(conversations: DataFrame, schemas: Mapping = SCHEMAS) -> DataFrame:
    """One row for each message, in order: conv_id, order_turn, phase, turn, line, linked, valid.

    line is the message as canonical JSON. order_turn and phase order messages
    so that a result stands after its call: order_turn is the latest turn of
    the message and of those it depends on, phase the number of links above it.
    Of calls that share an identifier in a conversation the one of the least
    turn counts (of equal turns, by a hash of the message). A result whose call
    isn't found, or is in the same message, or that is on a cycle of links or
    below one, stands at its own turn with phase 1. linked: null for a message without calls or
    result identifier, else whether all its calls have a result and the call
    of its result exists, in another message. valid: null without calls, else
    whether all arguments are admitted.

    Null texts count as empty, null roles and keys are written as null; a null
    conversation is one of its own whose identifiers link nothing. Repeated
    rows stay and are one message. Messages without identifiers, nearly all,
    are neither joined nor shuffled by conversation; rows are range-sorted by
    conversation and order, so a conversation of any length is spread over
    tasks. Extra columns are not looked at.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    rows = rows.withColumn("tool", F.when(F.ltrim("text").startswith("{"), F.from_json("text", f"tool_calls {_CALLS}, tool_call_id string, content string")))
    has_calls, has_result = F.coalesce(F.size("tool.tool_calls") > 0, F.lit(False)), F.col("tool.tool_call_id").isNotNull()
    none = F.lit(None).cast("boolean")
    plain = rows.where(~(has_calls | has_result)).select("conv_id", "turn", "role", "text", F.lit(None).cast(rows.schema["tool"].dataType).alias("tool"), F.col("turn").alias("order_turn"), F.lit(0).alias("phase"), none.alias("linked"), none.alias("valid"))
    marked = rows.where(has_calls | has_result).withColumns({"key": F.col("tool.tool_call_id"), "row": F.xxhash64("conv_id", "turn", "role", "text")})
    one = marked.select("row", "conv_id", "turn", "key", "tool.tool_calls").dropDuplicates(["row"])
    called = one.select("row", "conv_id", "turn", F.explode("tool_calls").alias("call")).select("row", "conv_id", "turn", F.col("call.id").alias("key"))
    calls = called.groupBy("conv_id", "key").agg(F.min(F.struct("turn", F.col("row").alias("up"))).alias("call")).select("conv_id", "key", "call.up", F.col("call.turn").alias("call_turn"))
    links = one.where("key IS NOT NULL").join(calls, ["conv_id", "key"]).where("row != up").select("row", "up", F.lit(1).cast("long").alias("depth"), F.greatest("turn", "call_turn").alias("top"))
    placed = _chains(links)
    # the calls of a message that have a result in another, counted by message
    answers = one.where("key IS NOT NULL").groupBy("conv_id", "key").agg(F.min("row").alias("least"), F.max("row").alias("most"))
    met = called.join(answers, ["conv_id", "key"], "left").groupBy("row").agg(F.count_if(F.coalesce((F.col("least") != F.col("row")) | (F.col("most") != F.col("row")), F.lit(False))).alias("met"), F.count("*").alias("n"))
    met = met.select("row", (F.col("met") == F.col("n")).alias("all_met"))
    fits = F.forall("tool.tool_calls", lambda c: valid_arguments(c["name"], c["arguments"], schemas))
    known = links.select("row", F.lit(True).alias("known")).join(met, "row", "full").join(placed, "row", "left")
    linked = F.coalesce("all_met", F.lit(False)) | ~has_calls
    linked = linked & (F.coalesce("known", F.lit(False)) | ~has_result)
    joined = marked.join(known, "row", "left").select(
        "conv_id", "turn", "role", "text", "tool", F.coalesce("top", "turn").alias("order_turn"), F.coalesce("depth", has_result.cast("int")).cast("int").alias("phase"), linked.alias("linked"), F.when(has_calls, fits).alias("valid")
    )
    every = plain.unionByName(joined)
    return every.select("conv_id", "order_turn", "phase", "turn", _line().alias("line"), "linked", "valid").orderBy("conv_id", "order_turn", "phase", "turn", "line")


def _line() -> Column:
    """Canonical JSON of a message, keys by name."""
    content = F.when(F.col("tool").isNull(), F.col("text")).otherwise(F.col("tool.content"))
    calls = F.transform(
        "tool.tool_calls",
        lambda c: F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(F.try_parse_json(c["arguments"])), _quoted(c["arguments"])), F.lit(',"id":'), _quoted(c["id"]), F.lit(',"name":'), _quoted(c["name"]), F.lit("}")),
    )
    parts = [
        F.lit('{"content":'),
        _quoted(content),
        F.concat(F.lit(',"conv_id":'), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))),
        F.concat(F.lit(',"role":'), _quoted(F.col("role"))),
        F.when(F.col("tool.tool_call_id").isNotNull(), F.concat(F.lit(',"tool_call_id":'), _quoted(F.col("tool.tool_call_id")))).otherwise(""),
        F.when(F.size("tool.tool_calls") > 0, F.concat(F.lit(',"tool_calls":['), F.array_join(calls, ","), F.lit("]"))).otherwise(""),
        F.concat(F.lit(',"turn":'), F.coalesce(F.col("turn").cast("string"), F.lit("null"))),
        F.lit("}"),
    ]
    return F.concat(*parts)


def _quoted(text: Column) -> Column:
    """A JSON string, or null."""
    return F.when(text.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))


SQL = r"""
SELECT conv_id, turn AS order_turn, 0 AS phase, turn,
  '{"content":' || to_json(coalesce(text, ''))::VARCHAR || ',"conv_id":' || coalesce(conv_id::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null')
    || ',"turn":' || coalesce(turn::VARCHAR, 'null') || '}' AS line,
  NULL::BOOLEAN AS linked, NULL::BOOLEAN AS valid
FROM conversations
"""
