"""Chat formatting: tool calls linked with their results, ordered, checked and written as canonical JSON.

Native: DataFrame functions only. Messages become events (calls, results,
others). Calls and results meet in a hash join by conversation and identifier;
calls that refer to results of other calls (``{"$ref": "<id>"}`` in their
arguments) get a topological level, round by round; arguments are checked
against schemas; every event is one row, with a JSON text whose keys are in
code point order, so a conversation of any length is never gathered in one
place. Events in the order (level, turn, call_id) respect all references.

Defined cases: a null role is ``none``, a null text gives no content; a call
without a result, a result without a call, a repeated call id, a reference to
an unknown call and a cycle are errors of the event. Of several results to a
call the first by turn (then text) is linked, the others stay results. Rows
without conversation id or turn are kept and link with nothing. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: What a plain user turn must hold, seen as a call that the next assistant turn answers.
REPLY = {"reply": {"required": ["text"], "types": {"text": "string"}}}

EVENT = ["conv_id", "turn", "role", "kind", "call_id", "name", "arguments", "content"]


def events(messages: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as events.

    An assistant text ``{"tool_calls": [{"id", "name", "arguments"}]}`` gives a
    call for each entry, a tool text ``{"tool_call_id", "content"}`` a result.
    A plain user turn is a call ``reply`` and the plain assistant turn right
    after it its result.
    """
    m = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("none")).alias("role"), F.col("text").cast("string").alias("text"))
    calls = F.from_json("text", "struct<tool_calls:array<struct<id:string,name:string,arguments:string>>>")["tool_calls"]
    given = F.when((F.col("role") == "assistant") & F.col("text").startswith("{"), calls)
    reply = F.when((F.col("role") == "tool") & F.col("text").startswith("{"), F.from_json("text", "struct<tool_call_id:string,content:string>"))
    m = m.withColumn("given", given).withColumn("reply", reply)
    name_of = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    none = F.lit(None).cast("string")
    tools = m.filter("given is not null").withColumn("c", F.explode("given")).select("conv_id", "turn", "role", F.lit("call").alias("kind"), F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), none.alias("content"))
    plain = m.filter("given is null")
    kind = F.when(F.col("reply.tool_call_id").isNotNull(), "result").when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("message")
    call_id = F.when(F.col("reply.tool_call_id").isNotNull(), F.col("reply.tool_call_id")).when(known & (F.col("role") == "user"), name_of(F.col("turn"))).when(known & (F.col("role") == "assistant"), name_of(F.col("turn") - 1))
    is_call = F.col("role") == "user"
    rest = plain.select(
        "conv_id", "turn", "role", kind.alias("kind"), call_id.alias("call_id"), F.when(is_call, F.lit("reply")).alias("name"), F.when(is_call, F.to_json(F.struct("text"))).alias("arguments"), F.when(~is_call, F.when(F.col("reply.tool_call_id").isNotNull(), F.col("reply.content")).otherwise(F.col("text"))).alias("content")
    )
    return tools.unionByName(rest)


def argument_errors(schemas: dict[str, dict]) -> Column:
    """Array of what is wrong with ``arguments`` (JSON text) of tool ``name``."""
    value = F.try_parse_json("arguments")
    shape = F.schema_of_variant(value)

    def is_type(field: str, wanted: str) -> Column:
        got = F.schema_of_variant(F.try_variant_get(value, f"$.{field}", "variant"))
        return {
            "string": got == "STRING",
            "integer": got == "BIGINT",
            "number": got.rlike("^(BIGINT|DOUBLE|DECIMAL)"),
            "boolean": got == "BOOLEAN",
            "array": got.startswith("ARRAY"),
            "object": got.startswith("OBJECT"),
        }[wanted]

    def has(field: str) -> Column:
        raw = F.try_variant_get(value, f"$.{field}", "variant")
        return raw.isNotNull() & ~F.coalesce(F.is_variant_null(raw), F.lit(False))

    checks = F.array().cast("array<string>")
    for tool in sorted(schemas):
        s, out = schemas[tool], []
        for field in s.get("required", []):
            out.append(F.when(~has(field), F.lit(f"missing {field}")))
        for field, wanted in sorted(s.get("types", {}).items()):
            out.append(F.when(has(field) & ~is_type(field, wanted), F.lit(f"{field} is no {wanted}")))
        checks = F.when(F.col("name") == tool, F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")).otherwise(checks)
    known = F.col("name").isin(*schemas) if schemas else F.lit(False)
    return F.when(~F.coalesce(known, F.lit(False)), F.array(F.lit("unknown tool"))).when(value.isNull() | ~shape.startswith("OBJECT"), F.array(F.lit("arguments are no JSON object"))).otherwise(checks)


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, trouble) of the calls that refer to others; all others have level 0.

    A round settles the calls whose references are all settled; rounds are as
    many as the longest chain, and there is none where nothing refers.
    """
    refs = calls.select("conv_id", "call_id", F.explode(F.array_distinct(F.regexp_extract_all("arguments", F.lit(r'"\$ref"\s*:\s*"([^"]+)"'), F.lit(1)))).alias("ref"))
    names = calls.select("conv_id", "call_id").distinct()
    edges = stored(refs.distinct().join(names.select("conv_id", F.col("call_id").alias("ref"), F.lit(True).alias("there")), ["conv_id", "ref"], "left"), "references")
    empty = edges.select("conv_id", "call_id", F.lit(0).alias("level"), F.lit(None).cast("string").alias("trouble")).limit(0)
    if edges.isEmpty():
        return empty
    lost = edges.filter("there is null").select("conv_id", "call_id", F.lit(0).alias("level"), F.lit("unknown reference").alias("trouble")).distinct()
    left = edges.filter("there").select("conv_id", "call_id", "ref")
    first = left.select("conv_id", F.col("ref").alias("call_id")).distinct().join(left.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti")
    settled = stored(first.withColumn("level", F.lit(0)), "levels")
    while True:
        met = left.join(settled.select("conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below")), ["conv_id", "ref"], "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count_if(F.col("below").isNull()).alias("open"), (F.max("below") + 1).alias("level")).filter("open = 0").drop("open")
        new = stored(ready.join(settled.select("conv_id", "call_id"), ["conv_id", "call_id"], "left_anti"), "levels")
        if new.isEmpty():
            break
        settled = stored(settled.unionByName(new), "levels")
    stuck = left.select("conv_id", "call_id").distinct().join(settled, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(None).cast("int").alias("level"), F.lit("cyclic reference").alias("trouble"))
    sure = settled.withColumn("trouble", F.lit(None).cast("string"))
    return sure.unionByName(lost).unionByName(stuck).groupBy("conv_id", "call_id").agg(F.max("level").alias("level"), F.max("trouble").alias("trouble"))


def linked(found: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """Events with ``linked_turn``, ``level``, ``valid``, ``errors`` and ``json``."""
    schemas = REPLY if schemas is None else schemas
    calls = found.filter("kind = 'call'")
    results = found.filter("kind = 'result'")
    others = found.filter("kind = 'message'")
    answer = results.filter("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("answer"))
    asked = calls.filter("call_id is not null and conv_id is not null").groupBy("conv_id", "call_id").agg(F.min("turn").alias("asked"), F.count(F.lit(1)).alias("times"))
    depth = levels(calls.filter("call_id is not null and conv_id is not null"))
    c = (
        calls.join(answer.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
        .join(asked.select("conv_id", "call_id", "times").hint("shuffle_hash"), ["conv_id", "call_id"], "left")
        .join(depth, ["conv_id", "call_id"], "left")
        .select(
            *EVENT,
            F.col("answer.turn").alias("linked_turn"),
            F.when(F.col("trouble") == "cyclic reference", F.lit(None)).otherwise(F.coalesce("level", F.lit(0))).alias("level"),
            F.array_compact(F.concat(argument_errors(schemas), F.array(F.when(F.col("answer").isNull(), "no result"), F.when(F.col("times") > 1, "repeated call id"), F.col("trouble")))).alias("errors"),
        )
    )
    r = results.join(asked.select("conv_id", "call_id", "asked").hint("shuffle_hash"), ["conv_id", "call_id"], "left").select(
        *EVENT, F.col("asked").alias("linked_turn"), F.lit(0).alias("level"), F.when(F.col("asked").isNull(), F.array(F.lit("no call"))).otherwise(F.array().cast("array<string>")).alias("errors")
    )
    o = others.select(*EVENT, F.lit(None).cast("long").alias("linked_turn"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("errors"))
    every = c.unionByName(r).unionByName(o).withColumn("valid", F.size("errors") == 0)
    canonical = F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "content", "errors", "kind", "linked_turn", "name", "role", "turn")
    return every.withColumn("json", F.to_json(canonical))
