"""Chat formatting: tool calls are linked to results, ordered, validated and written as canonical JSON.

A message whose text is a JSON object with "tool_calls" (a list of {"id", "name", "arguments"}) gives
an event for its own "content" and one for each call; one with "tool_call_id" is a result; any other
text is an event as it stands. Arguments may be JSON in a string; {"$result": id} anywhere in them
asks for another call's result.

Calls and results are hash-joined by conversation and identifier; of several with one identifier the
first counts and the rest are "duplicate". Order is topological: a result comes after its call and a
call after the results it asks for, else turns decide. Events that wait for each other, directly or
through others, are one component; identifiers alone, without texts, are dealt in buckets of whole
components (about `bucket` events, or one component) and ordered there in one pass. Events in a cycle, or that
ask for a result that is missing, keep their turn and say so in `status`. No conversation is gathered
in one task for its length: an event's order_key sorts it within its conversation.

Null texts give an event with null content, empty ones an empty string; very long ones are parsed whole.
Rows without conv_id link to nothing; a null turn sorts before all others, negative ones before 0. JSON that
can't be parsed, is nested too deeply, or holds NaN, infinity, numbers that no double holds or halves of
characters, is plain text. Equal rows give equal events. An empty table gives no events. Only conv_id, turn,
role and text are read, so other columns may have any name. Schemas with keywords that aren't checked are refused.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ethogrid.operators.graph import components, replaced
from ethogrid.session import cut

#: What names a call or a result.
KEYS = ["conv_id", "call_id", "kind"]

#: JSON schemas of tools, by name, for conversations that bring no others.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 100}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string", "minLength": 1}}, "required": ["expression"], "additionalProperties": False},
    "fetch": {"type": "object", "properties": {"url": {"type": "string"}, "method": {"enum": ["GET", "HEAD"]}}, "required": ["url"]},
}
TYPES = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str),
    "integer": lambda x: isinstance(x, int) and not isinstance(x, bool) or isinstance(x, float) and x.is_integer(),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool), "null": lambda x: x is None,
}


def canonical(value) -> str:
    """JSON with sorted keys and no blanks; whole floats are written as integers."""

    def plain(x):
        if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 53:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _same(a, b) -> bool:
    """Whether two JSON values are equal: 1 is 1.0, but not true."""
    return canonical(a) == canonical(b)


#: The keywords of schemas that are checked, and those that say nothing about values (fixed values).
CHECKED = (
    "type enum const minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength pattern items minItems maxItems"
    " uniqueItems properties required additionalProperties minProperties maxProperties anyOf oneOf allOf not"
).split()
SILENT = "title description default examples deprecated readOnly writeOnly format $schema $id $comment".split()


def checked(schema, path: str = "$") -> None:
    """Refuse a schema with a keyword that violation() doesn't know, at any depth."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{path}: not a schema")
    if unknown := sorted(set(schema) - set(CHECKED) - set(SILENT)):
        raise ValueError(f"{path}: unknown keywords {unknown}")
    kinds = schema.get("type", [])
    if any(k not in TYPES for k in ([kinds] if isinstance(kinds, str) else kinds)):
        raise ValueError(f"{path}: unknown type {kinds}")
    for name in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"):
        bound = schema.get(name, 1)
        if not TYPES["number"](bound) or not math.isfinite(bound) or name == "multipleOf" and bound <= 0:
            raise ValueError(f"{path}: {name} can't be {bound!r}")
    if not isinstance(schema.get("pattern", ""), str):
        raise ValueError(f"{path}: not a pattern")
    re.compile(schema.get("pattern", ""))
    for name, under in schema.get("properties", {}).items():
        checked(under, f"{path}.{name}")
    for name in ("items", "additionalProperties", "not"):
        checked(schema.get(name, True), f"{path}/{name}")
    for name in ("anyOf", "oneOf", "allOf"):
        for under in schema.get(name, []):
            checked(under, f"{path}/{name}")


def violation(value, schema, path: str = "$") -> str | None:
    """The first rule of the schema that the value breaks, or None. A {"$result": id} fits any schema."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return None
    if schema is True or schema == {}:
        return None
    if schema is False:
        return f"{path}: not allowed"
    kinds = schema.get("type", [])
    if kinds and not any(TYPES[k](value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return f"{path}: not {kinds}"
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        return f"{path}: not in enum"
    if "const" in schema and not _same(value, schema["const"]):
        return f"{path}: not const"
    if error := _number(value, schema, path) or _text(value, schema, path) or _list(value, schema, path) or _object(value, schema, path):
        return error
    fits = lambda name: [violation(value, under, path) is None for under in schema[name]]
    if "allOf" in schema and (error := next((e for under in schema["allOf"] if (e := violation(value, under, path))), None)):
        return error
    if "anyOf" in schema and not any(fits("anyOf")):
        return f"{path}: none of anyOf"
    if "oneOf" in schema and sum(fits("oneOf")) != 1:
        return f"{path}: not one of oneOf"
    if "not" in schema and violation(value, schema["not"], path) is None:
        return f"{path}: excluded"
    return None


def _number(value, schema, path: str) -> str | None:
    if not TYPES["number"](value):
        return None
    low, high = schema.get("exclusiveMinimum", -math.inf), schema.get("exclusiveMaximum", math.inf)
    if not schema.get("minimum", value) <= value <= schema.get("maximum", value) or not low < value < high:
        return f"{path}: out of range"
    if "multipleOf" in schema and (Fraction(value) / Fraction(str(schema["multipleOf"]))).denominator != 1 and (Fraction(str(value)) / Fraction(str(schema["multipleOf"]))).denominator != 1:
        return f"{path}: not a multiple"
    return None


def _text(value, schema, path: str) -> str | None:
    if not isinstance(value, str):
        return None
    if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", math.inf):
        return f"{path}: length"
    return f"{path}: pattern" if "pattern" in schema and not re.search(schema["pattern"], value) else None


def _list(value, schema, path: str) -> str | None:
    if not isinstance(value, list):
        return None
    if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", math.inf):
        return f"{path}: length"
    if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
        return f"{path}: repeated items"
    return next((e for i, x in enumerate(value) if (e := violation(x, schema.get("items", True), f"{path}[{i}]"))), None)


def _object(value, schema, path: str) -> str | None:
    if not isinstance(value, dict):
        return None
    rules = schema.get("properties", {})
    for name in schema.get("required", []):
        if name not in value:
            return f"{path}.{name}: missing"
    if not schema.get("minProperties", 0) <= len(value) <= schema.get("maxProperties", math.inf):
        return f"{path}: length"
    for name in sorted(value):
        if e := violation(value[name], rules[name] if name in rules else schema.get("additionalProperties", True), f"{path}.{name}"):
            return e
    return None


def _asked(value) -> set[str]:
    if isinstance(value, dict):
        return {value["$result"]} if set(value) == {"$result"} and isinstance(value["$result"], str) else set().union(*map(_asked, value.values()))
    return set().union(*map(_asked, value)) if isinstance(value, list) else set()


def _load(text: str):
    """The value of a JSON text; ValueError for NaN, for numbers that no double holds and for halves of characters."""

    def refuse(x):
        raise ValueError(x)

    def finite(x):
        number = float(x)
        return number if math.isfinite(number) else refuse(x)

    value = json.loads(text, parse_constant=refuse, parse_float=finite)
    canonical(value).encode()
    return value


@dataclass
class Event:
    kind: str
    json: str
    call_id: str | None = None
    asks: list[str] = field(default_factory=list)
    error: str | None = None


def events(role: str | None, text: str | None, tools: dict) -> list[Event]:
    """The events of a message."""
    whole = [Event("message", canonical({"role": role, "content": text}))]
    if not text or text.lstrip()[:1] != "{":
        return whole
    try:
        said = _load(text)
        if isinstance(said.get("tool_call_id"), str):
            i = said["tool_call_id"]
            return [Event("result", canonical({"role": role, "tool_call_id": i, "content": said.get("content")}), i)]
        calls = said.get("tool_calls")
        if not isinstance(calls, list) or not calls or not all(isinstance(c, dict) and isinstance(c.get("id"), str) for c in calls):
            return whole
        out = [Event("message", canonical({"role": role, "content": said["content"]}))] if said.get("content") is not None else []
        for c in calls:
            name, arguments, error = c.get("name"), c.get("arguments", {}), None
            if isinstance(arguments, str):
                try:
                    arguments = _load(arguments)
                except (ValueError, RecursionError):
                    error = "$: not JSON"
            if error is None:
                error = violation(arguments, tools[name]) if isinstance(name, str) and name in tools else "unknown tool"
            body = {"role": role, "id": c["id"], "name": name, "arguments": arguments}
            out.append(Event("call", canonical(body), c["id"], sorted(_asked(arguments)), error))
        return out
    except (ValueError, RecursionError, AttributeError):
        return whole


def _reader(tools: dict):
    names = ["conv_id", "turn", "item", "kind", "call_id", "asks", "error", "json"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = []
            for conv, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                for item, e in enumerate(events(role, text, tools)):
                    rows.append((conv, turn, item, e.kind, e.call_id, e.asks, e.error, e.json))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return run


def placed(nodes: dict, waits: dict) -> dict:
    """(at, depth) of each node that can be placed: nodes gives each one's own place, waits what it waits for.

    A node stands at its own place, or right behind the last of those it waits for if that is later. Nodes of a cycle,
    that wait for what isn't there, or for such ones, are left out.
    """
    need = {n: len(waits.get(n, ())) for n in nodes}
    after: dict = {}
    for n, wanted in waits.items():
        for w in wanted:
            after.setdefault(w, []).append(n)
    out, last = {}, {}
    ready = [n for n, k in need.items() if k == 0]
    while ready:
        n = ready.pop()
        at, depth = nodes[n], 0
        if n in last and last[n][0] >= at:
            at, depth = last[n][0], last[n][1] + 1
        out[n] = at, depth
        for m in after.get(n, ()):
            last[m] = max(last.get(m, out[n]), out[n])
            need[m] -= 1
            if not need[m]:
                ready.append(m)
    return out


def _placer(table: pa.Table) -> pa.Table:
    """The places of all nodes of a bucket of whole components."""
    names = list(zip(*(table.column(c).to_pylist() for c in KEYS), strict=True))
    nodes = dict(zip(names, table.column("own").to_pylist(), strict=True))
    waits = {n: [(n[0], w["for_id"], w["for_kind"]) for w in wanted] for n, wanted in zip(names, table.column("waits").to_pylist(), strict=True) if wanted}
    found = placed(nodes, waits)
    columns = [[n[k] for n in found] for k in range(3)] + [[at for at, _ in found.values()], [depth for _, depth in found.values()]]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*KEYS, "at", "depth"])


def _own(turn: Column) -> Column:
    """A string that sorts as turns do, whatever their sign; null first."""
    digits = F.lpad((turn.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 21, "0")
    return F.when(turn.isNull(), F.lit("0" * 22)).otherwise(F.concat(F.lit("1"), digits))


def link_tools(messages: DataFrame, tools: dict | None = None, bucket: int = 65_536) -> DataFrame:
    """conv_id, turn, item, kind, call_id, status, error, order_key and json of every event.

    status: plain for messages; linked, unanswered, duplicate, waiting (asks for what is missing) or
    cyclic for calls; linked, orphan, duplicate or cyclic for results. error: what is wrong with a
    call's arguments.
    """
    tools = TOOLS if tools is None else tools
    for schema in tools.values():
        checked(schema)
    kinds = {"conv_id": "long", "turn": "long", "role": "string", "text": "string"}
    rows = messages.select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    schema = "conv_id long, turn long, item int, kind string, call_id string, asks array<string>, error string, json string"
    every = cut(rows.mapInArrow(_reader(tools), schema).withColumn("own", _own(F.col("turn"))))
    tied = every.where("kind <> 'message'").select(*KEYS, "own", "item", "asks")
    firsts = tied.where("conv_id is not null").groupBy(*KEYS).agg(F.min(F.struct("own", "item", "asks")).alias("at"))
    firsts = firsts.select(*KEYS, "at.own", "at.item", "at.asks")
    both = firsts.groupBy("conv_id", "call_id").agg((F.count("*") == 2).alias("both"))
    nodes = firsts.join(both, ["conv_id", "call_id"])
    # what each event waits for: a result for its call, a call for the results it asks for
    wait = lambda i, kind: F.struct(i.alias("for_id"), F.lit(kind).alias("for_kind"))
    own_call = F.when(F.col("both"), F.array(wait(F.col("call_id"), "call"))).otherwise(F.array().cast("array<struct<for_id:string,for_kind:string>>"))
    nodes = cut(nodes.withColumn("waits", F.when(F.col("kind") == "call", F.transform("asks", lambda x: wait(x, "result"))).otherwise(own_call)))
    # whole components of events that wait for each other go to one bucket, without their texts
    one, other = F.xxhash64(*KEYS).alias("a"), F.xxhash64("conv_id", "wait.for_id", "wait.for_kind").alias("b")
    links = nodes.select(*KEYS, F.explode("waits").alias("wait")).select(one, other)
    buckets = max(1, -(-nodes.count() // bucket))
    dealt = nodes.select(F.xxhash64(*KEYS).alias("part"), *KEYS, "own", "waits")
    if buckets > 1:  # one bucket holds all components, whatever they are
        dealt = replaced(dealt, "part", components(links))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(buckets)))
    places = dealt.groupBy("part").applyInArrow(_placer, "conv_id long, call_id string, kind string, at string, depth int")
    # of those that have no place, some ask for what isn't there, and the others wait for them or go round
    there = nodes.where("kind = 'result' and both").select("conv_id", F.col("call_id").alias("for_id"), F.lit(True).alias("there"))
    asked = nodes.where("kind = 'call'").select(*KEYS, F.explode("waits.for_id").alias("for_id"))
    missing = asked.join(there, ["conv_id", "for_id"], "left").where("there is null").select(*KEYS).distinct().withColumn("missing", F.lit(True))
    info = (
        nodes.select(*KEYS, "both", F.col("own").alias("first_own"), F.col("item").alias("first_item"))
        .join(places, KEYS, "left").join(missing, KEYS, "left")
    )
    first = (F.col("own") == F.col("first_own")) & (F.col("item") == F.col("first_item"))
    status = (
        F.when(F.col("kind") == "message", "plain")
        .when(F.col("first_own").isNull(), F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
        .when(~first, "duplicate")
        .when(F.col("missing"), "waiting")
        .when(F.col("at").isNull(), "cyclic")
        .when(F.col("both"), "linked")
        .otherwise(F.when(F.col("kind") == "call", "unanswered").otherwise("orphan"))
    )
    moved = first & F.col("at").isNotNull()
    at, depth = F.when(moved, F.col("at")).otherwise(F.col("own")), F.when(moved, F.col("depth")).otherwise(0)
    key = F.format_string("%s.%09d.%s.%06d", at, depth, F.col("own"), F.col("item"))
    # plain messages, which no identifier spreads, don't join
    plain = every.where("kind = 'message'").select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in info.dtypes if c not in KEYS])
    rows = plain.unionByName(every.where("kind <> 'message'").join(info, KEYS, "left"))
    return rows.select("conv_id", "turn", "item", "kind", "call_id", status.alias("status"), "error", key.alias("order_key"), "json")


def conversation_json(linked: DataFrame) -> DataFrame:
    """conv_id and one canonical JSON list of its events, for conversations that each fit in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("order_key", "json")))
    return linked.groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["json"]), ","), F.lit("]")).alias("json"))
