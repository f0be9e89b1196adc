"""Chat formatting: links tool calls to their results, orders them, checks arguments and writes canonical JSON.

DataFrame functions only. Calls and results meet in a join on (conversation, identifier), so neither a long conversation nor a
common identifier is gathered in one task: of several results for a call the first is taken by an aggregate before the join, and
the others are rows of their own.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: JSON schema type -> pattern of Spark's name for a variant's type (fixed values).
_TYPES = {
    "string": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN",
    "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID",
}


def _faults(value: Column, name: str, spec: dict) -> list[Column]:
    """What is wrong with a variant, as texts or nulls, by ``type`` (a name or several), ``enum``, ``properties``, ``required``,
    ``additionalProperties`` and ``items``. A type without a meaning here is an error of the schema."""
    kinds = spec.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if unknown := [k for k in kinds if k not in _TYPES]:
        raise ValueError(f"no such type in the schema of {name}: {', '.join(map(str, unknown))}")
    out = []
    if kinds:
        wrong = ~F.schema_of_variant(value).rlike("|".join(_TYPES[k] for k in kinds))
        if "integer" in kinds:  # by value: 1e3 is one, and so are numbers of more digits than a decimal has
            real = F.when(F.schema_of_variant(value) == "DOUBLE", F.try_variant_get(value, "$", "double"))
            wrong &= ~F.coalesce(real == F.rint(real), F.lit(False))
        out.append(F.when(value.isNotNull() & wrong, F.lit(f"{name} is no {' or '.join(kinds)}")))
    if "enum" in spec:
        allowed = [json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for x in spec["enum"]]
        out.append(F.when(value.isNotNull() & ~F.to_json(value).isin(allowed), F.lit(f"{name} is none of {', '.join(allowed)}")))
    if "items" in spec:
        items = F.try_variant_get(value, "$", "array<variant>")
        bad = lambda x: F.coalesce(*_faults(x, "item", spec["items"]), F.lit(None).cast("string")).isNotNull()
        out.append(F.when(F.coalesce(F.exists(items, bad), F.lit(False)), F.lit(f"{name} has a wrong item")))
    return out + _members(value, f"{name}.", spec)


def _member(value: Column, key: str) -> Column:
    """A member of an object, whatever characters its key has: a path quotes it one way or the other, and a key with both quotes is
    looked up in a map."""
    for quote in "'\"":
        if quote not in key:
            return F.try_variant_get(value, f"$[{quote}{key}{quote}]", "variant")
    return F.try_element_at(F.try_variant_get(value, "$", "map<string,variant>"), F.lit(key))


def _members(value: Column, prefix: str, spec: dict) -> list[Column]:
    """The faults of an object's members."""
    out = []
    for key, inner in spec.get("properties", {}).items():
        out += _faults(_member(value, key), prefix + key, inner)
    is_object = F.schema_of_variant(value).rlike("^OBJECT")
    for key in spec.get("required", []):
        out.append(F.when(is_object & _member(value, key).isNull(), F.lit(f"{prefix}{key} is missing")))
    if spec.get("additionalProperties") is False:
        keys = F.map_keys(F.from_json(F.to_json(value), "map<string,string>"))
        extra = F.array_except(keys, F.array(*map(F.lit, spec.get("properties", {}))).cast("array<string>"))
        out.append(F.when(is_object & (F.size(extra) > 0), F.concat(F.lit(f"{prefix}unknown: " if prefix else "unknown: "), F.array_join(F.array_sort(extra), ","))))
    return out


def problems(arguments: Column, name: Column, schemas: dict[str, dict]) -> Column:
    """array<string> of what is wrong with a call's arguments, in the order of its schema; empty if nothing is.

    Of JSON Schema: ``type`` (one or several), ``enum``, ``properties``, ``required``, ``additionalProperties`` (false) and ``items``,
    at any depth. An unknown name gives ["unknown tool"]; text that is no JSON object ["not an object"].
    """
    parsed = F.try_parse_json(arguments)
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        found = F.array(*_members(parsed, "", schema)).cast("array<string>")
        out = F.when(name == tool, F.filter(found, lambda x: x.isNotNull())).otherwise(out)
    return F.when(F.schema_of_variant(parsed).rlike("^OBJECT"), out).otherwise(F.array(F.lit("not an object")))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of ``calls`` (conv_id, call_id, after): 0 for calls that wait for none, else 1 + the highest
    they wait for. Calls in a cycle or behind one have no row, nor have those without an identifier.

    Identifiers in ``after`` that aren't calls of the conversation don't hold a call up. Chains of calls that wait for one
    other each are followed by pointer doubling, so a chain of n calls takes about log2(n) joins; calls that wait for
    several are then resolved round by round, over chains that count as one step.
    """
    keys = ["conv_id", "call_id"]
    ids = calls.select(*keys).where("conv_id is not null and call_id is not null").distinct()
    waits = calls.select(*keys, F.explode("after").alias("first")).distinct()
    waits = written(waits.join(ids.select("conv_id", F.col("call_id").alias("first")), ["conv_id", "first"]).select(*keys, "first"))
    degree = waits.groupBy(*keys).agg(F.count("*").alias("k"), F.min("first").alias("up"))
    single = F.coalesce(F.col("k") == 1, F.lit(False))
    start = F.when(single, F.col("up")).otherwise(F.col("call_id"))
    step = written(ids.join(degree, keys, "left").select(*keys, start.alias("up"), single.cast("long").alias("far"), (~single).alias("done"), F.col("k").isNull().alias("free")))
    longest = step.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    far = 1  # of calls that aren't done; beyond their conversation's size only in a cycle
    while far <= longest and not step.where("not done").isEmpty():
        ahead = step.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("to"), F.col("far").alias("more"), F.col("done").alias("end"))
        moved = step.where("not done").join(ahead, ["conv_id", "up"]).select(*keys, F.col("to").alias("up"), (F.col("far") + F.col("more")).alias("far"), F.col("end").alias("done"), "free")
        step = written(step.where("done").unionByName(moved))
        far *= 2
    step = step.where("done")
    known = step.where("free").select(*keys, F.lit(0).cast("long").alias("level"))
    to = step.select("conv_id", F.col("call_id").alias("first"), "up", "far")
    edges = written(waits.join(degree.where("k > 1").select(*keys), keys).join(to, ["conv_id", "first"], "left").select(*keys, "up", "far"))
    while not edges.isEmpty():
        seen = edges.join(known.select("conv_id", F.col("call_id").alias("up"), "level"), ["conv_id", "up"], "left")
        ready = seen.groupBy(*keys).agg(F.max(F.col("level") + F.col("far") + 1).alias("level"), F.count("*").alias("n"), F.count("level").alias("m"))
        ready = written(ready.where("n = m").select(*keys, "level"))
        if ready.isEmpty():
            break
        known = known.unionByName(ready)
        edges = written(edges.join(ready.select(*keys), keys, "left_anti"))
    known = known.select("conv_id", F.col("call_id").alias("up"), "level")
    return step.join(known, ["conv_id", "up"]).select(*keys, (F.col("level") + F.col("far")).cast("int").alias("level"))


def _repeats(rows: DataFrame, one: DataFrame, cols: list[str]) -> DataFrame:
    """(conv_id, call_id, *cols): those of ``rows`` that ``one``, the first of each identifier and their count n, doesn't hold."""
    keys = ["conv_id", "call_id"]
    many = written(one.where("n > 1").select(*keys, F.struct(*cols).alias("first")))
    copies = rows.join(many, keys).groupBy(*keys, *cols).agg(F.count("*").alias("n"), F.first("first").alias("first"))
    is_first = F.lit(True)
    for c in cols:
        is_first = is_first & F.col(c).eqNullSafe(F.col("first")[c])
    left = F.col("n") - is_first.cast("long")
    return copies.where(left > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), left))).select(*keys, *cols)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, call_id, turn, level, status, problems, json), one row for each call and each result that no call has taken.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (identifiers it waits for); ``results``: conv_id,
    call_id, turn, content. Of calls or results with one identifier the first by turn, then by text, counts; each other one is a
    row with the level of its identifier. status: linked, unanswered, early (the result stands before its call), invalid
    (arguments don't meet the schema), cycle, orphan (a result without a call), or duplicate (not the first call or result of its
    identifier). Rows without an identifier are each their own orphans or unanswered calls. ``json``: one object with
    sorted keys and no white space; canonical arguments if they are JSON. Order: conv_id, level, turn, call_id.
    """
    keys = ["conv_id", "call_id"]
    of_call, of_result = ["turn", "name", "arguments", "after"], ["turn", "content"]
    known = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    calls, results = calls.select(*keys, *of_call), results.select(*keys, *of_result)
    first = lambda df, cols: df.where(known).groupBy(*keys).agg(F.min(F.struct(*cols)).alias("x"), F.count("*").alias("n")).select(*keys, "x.*", "n")
    one, answer = first(calls, of_call), first(results, of_result)
    called = lambda df: df.withColumn("called", F.lit(True))
    answered = lambda df: df.withColumnRenamed("turn", "result_turn").withColumn("answered", F.lit(True))
    both = called(one.drop("n")).join(answered(answer.drop("n")), keys, "full_outer").withColumn("repeat", F.lit(False))
    for repeat, some, other in ((True, _repeats(calls, one, of_call), _repeats(results, answer, of_result)), (False, calls.where(~known), results.where(~known))):
        for rows in (called(some), answered(other)):
            both = both.unionByName(rows.withColumn("repeat", F.lit(repeat)), allowMissingColumns=True)
    both = both.join(levels(one), keys, "left")
    both = both.withColumn("problems", F.when(F.col("called"), problems(F.col("arguments"), F.col("name"), schemas)).otherwise(F.array().cast("array<string>")))
    status = (
        F.when(F.col("repeat"), "duplicate").when(F.col("called").isNull(), "orphan").when(F.size("problems") > 0, "invalid").when(F.col("level").isNull() & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), "cycle")
        .when(F.col("answered").isNull(), "unanswered").when(F.col("result_turn") < F.col("turn"), "early").otherwise("linked")
    )
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("text"))))
    text = lambda c: F.coalesce(F.expr(f"substring(to_json(struct(cast({c} as string) as x)), 6, length(to_json(struct(cast({c} as string) as x))) - 6)"), F.lit(""))
    part = lambda name, value: F.when(value != "", F.concat(F.lit(f'"{name}":'), value))
    body = F.concat_ws(",", part("arguments", F.when(F.col("called"), canonical).otherwise("")), part("id", text("call_id")), part("name", text("name")), part("result", text("content")), part("status", F.concat(F.lit('"'), status, F.lit('"'))))
    return both.select(*keys, F.coalesce("turn", "result_turn").alias("turn"), "level", status.alias("status"), "problems", F.concat(F.lit("{"), body, F.lit("}")).alias("json"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The calls and results in a table of turns (conv_id, turn, role, text).

    A user's turn is a call of the tool ``reply`` with the identifier of its turn, which waits for the user's turn two before;
    an assistant's or tool's turn is the result for the turn before it. A turn of any other role, such as system, is a result
    without an identifier, so that it has a row of its own as an orphan. Turns whose number is null have no identifier either.
    """
    t = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    name = lambda c: F.concat(F.lit("t"), c.cast("string"))
    calls = t.where("role = 'user'").select(
        "conv_id", name(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"))).alias("arguments"), F.array(name(F.col("turn") - 2)).alias("after"),
    )
    answers = F.when(F.col("role").isin("assistant", "tool"), name(F.col("turn") - 1))
    results = t.where("role is null or role <> 'user'").select("conv_id", answers.alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


#: The schema of ``exchanges``.
REPLY = {"reply": {"properties": {"prompt": {"type": "string"}, "turn": {"type": "integer"}}, "required": ["prompt", "turn"], "additionalProperties": False}}
