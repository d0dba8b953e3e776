"""Chat formatting: tool calls linked with their results, ordered, validated, serialised.

Messages are rows (conv_id, turn, role, text).  A text that is a JSON object with
``tool_calls`` (objects with id, name, arguments and, if wanted, depends_on: a list of call
identifiers) holds calls; one with ``tool_call_id`` is a result.  In a plain conversation a
user turn is a call of the tool ``reply`` named ``turn-<turn>``, whose result is the
assistant's next turn; other turns are messages.

1. Calls and results are linked by a hash join on (conv_id, call identifier).  Of calls that
   share an identifier the first (by turn, then text) is the call, the others are
   ``duplicate_call``; so for results.  Each side is joined with one row per identifier, so a
   frequent identifier never multiplies.
2. Topological order: a result comes after its call, a call after the results of the calls
   it depends on.  Each entry gets an order key: the latest turn among itself and what it
   needs, then its depth.  Logs that are in order keep their turns.  Calls on or behind a cycle
   of dependencies have no such order: they get the status ``cyclic`` and keep their turn.
   Conversations with up to ``GRAPH`` dependencies are ordered each within a task, in linear
   time; in larger ones the keys spread by joins, a round for each level of dependency.
3. Arguments are validated against the JSON schema of the tool.
4. Each entry is serialised as canonical JSON: keys sorted, no white space, UTF-8.

Statuses: ok, invalid (arguments break the schema, or depends_on is no list of identifiers),
unknown_tool, unanswered (a call without a result), orphan (a result without a call),
duplicate_call, duplicate_result, cyclic, message; the first that holds in the order
duplicate, cyclic, unknown_tool, invalid, unanswered.

Edge cases: a null text counts as empty; null conversations link nothing and a null
turn sorts first; malformed JSON is plain text, and so is JSON with NaN or infinite numbers or
nested too deeply; identifiers are strings or integers, a call or result with any other or none
links nothing and is nobody's duplicate; a tool's name that is no string is unknown; half
surrogate pairs become U+FFFD; fully equal rows give as many entries; a text may hold any
number of calls; columns other than the four are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship, shared_root

#: Schemas of the known tools.
TOOLS: dict[str, dict] = {
    "reply": {
        "type": "object",
        "properties": {"text": {"type": "string", "minLength": 1}},
        "required": ["text"],
        "additionalProperties": False,
    }
}
#: Dependencies of a conversation that is ordered within one task, at most.
GRAPH = 100_000
TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def whole(text: str) -> str:
    """The text with half surrogate pairs replaced."""
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def canonical_json(value) -> str:
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _no_number(name: str):
    raise ValueError(f"{name} is no JSON")


def _loads(text: str):
    return json.loads(text, parse_constant=_no_number)


def _identifier(value) -> str | None:
    """An identifier as text; None for what can't be one."""
    if isinstance(value, str):
        return whole(value)
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else None


def conforms(value, schema: dict) -> bool:
    """Whether a value meets a schema: type, enum, const, bounds, lengths, items, properties."""
    kind = schema.get("type")
    if kind is not None:
        kinds = kind if isinstance(kind, list) else [kind]
        if not any(_is_a(value, k) for k in kinds):
            return False
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        return False
    if isinstance(value, str) and not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
        return False
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if not schema.get("minimum", value) <= value <= schema.get("maximum", value):
            return False
    if isinstance(value, list):
        if not schema.get("minItems", 0) <= len(value) <= schema.get("maxItems", len(value)):
            return False
        return "items" not in schema or all(conforms(x, schema["items"]) for x in value)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if any(k not in value for k in schema.get("required", ())):
            return False
        if schema.get("additionalProperties") is False and any(k not in known for k in value):
            return False
        return all(conforms(v, known[k]) for k, v in value.items() if k in known)
    return True


def _is_a(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES.get(kind, object))


ENTRIES = (
    "conv_id bigint, turn bigint, place int, role string, kind string, call_id string, "
    "verdict string, depends_on array<string>, canonical string"
)
ENTRY_TYPES = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("place", pa.int32()), ("role", pa.string()), ("kind", pa.string()), ("call_id", pa.string())]
    + [("verdict", pa.string()), ("depends_on", pa.list_(pa.string())), ("canonical", pa.string())]
)


def _parsed(text: str) -> dict | None:
    if not text.lstrip().startswith("{"):
        return None
    try:
        found = _loads(text)
        canonical_json(found)
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) and ("tool_calls" in found or "tool_call_id" in found) else None


def _call(row: dict, place: int, call: dict, tools: dict) -> dict:
    name, arguments, needs = call.get("name"), call.get("arguments"), call.get("depends_on")
    if isinstance(arguments, str):
        try:
            arguments = _loads(arguments)
            canonical_json(arguments)
        except (ValueError, RecursionError):
            arguments = call["arguments"]
    needs = [] if needs is None else needs
    depends = [_identifier(x) for x in needs] if isinstance(needs, list) else [None]
    call_id = _identifier(call.get("id"))
    if not isinstance(name, str) or name not in tools:
        verdict = "unknown_tool"
    else:
        verdict = "ok" if None not in depends and conforms(arguments, tools[name]) else "invalid"
    shown = canonical_json({"arguments": arguments, "id": call_id, "name": name, "type": "tool_call"})
    depends = [x for x in depends if x is not None]
    return row | {"place": place, "kind": "call", "call_id": call_id, "verdict": verdict, "depends_on": depends, "canonical": shown}


def _result(row: dict, call_id: str | None, content) -> dict:
    shown = canonical_json({"content": content, "id": call_id, "type": "tool_result"})
    return row | {"place": 0, "kind": "result", "call_id": call_id, "verdict": "ok", "depends_on": [], "canonical": shown}


def entries_of(conv_id, turn, role: str | None, text: str | None, tools: dict) -> list[dict]:
    """The calls, the result or the message of one row."""
    text, row = text or "", {"conv_id": conv_id, "turn": turn, "role": role}
    found = _parsed(text)
    if found is not None and "tool_call_id" in found:
        return [_result(row, _identifier(found["tool_call_id"]), found.get("content"))]
    if found is not None and isinstance(found["tool_calls"], list):
        calls = [c for c in found["tool_calls"] if isinstance(c, dict)]
        if calls:
            return [_call(row, i, c, tools) for i, c in enumerate(calls)]
    if role == "user":
        return [_call(row, 0, {"id": f"turn-{turn}", "name": "reply", "arguments": {"text": text}}, tools)]
    if role == "assistant" and turn is not None:
        return [_result(row, f"turn-{turn - 1}", text)]
    shown = canonical_json({"content": text, "role": role, "type": "message"})
    return [row | {"place": 0, "kind": "message", "call_id": None, "verdict": "message", "depends_on": [], "canonical": shown}]


def _parse(tools: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            yield pa.RecordBatch.from_pylist([e for row in rows for e in entries_of(*row, tools)], schema=ENTRY_TYPES)

    return run


def _cyclic(needs: DataFrame, home: str) -> DataFrame:
    """The calls (conv_id, call_id) that lie on or behind a cycle of ``needs`` (…, parent).

    Calls whose needs are all met are peeled off, round by round.
    """
    step, left, now = 0, needs.count(), needs
    while left:
        step += 1
        open_calls = now.select("conv_id", F.col("call_id").alias("parent")).distinct()
        now = materialise(now.join(open_calls, ["conv_id", "parent"], "left_semi"), f"{home}/needs-{step}")
        after = now.count()
        if after == left:
            break
        left = after
    return now.select("conv_id", "call_id").distinct()


def _order(firsts: DataFrame, needs: DataFrame, home: str) -> DataFrame:
    """(conv_id, call_id, call_after, call_depth) of the first calls; ``needs`` has no cycle."""
    calls = firsts.where("kind = 'call'").select("conv_id", "call_id", F.col("turn").alias("after"))
    answers = firsts.where("kind = 'result'").select("conv_id", "call_id", F.col("turn").alias("answered"))
    now = calls.join(answers, ["conv_id", "call_id"], "left").select("conv_id", "call_id", "after", F.lit(0).alias("depth"), "answered")
    now, step = materialise(now, f"{home}/order-0"), 0
    while True:
        step += 1
        parents = now.select(
            "conv_id", F.col("call_id").alias("parent"), F.greatest("after", "answered").alias("x"), (F.col("depth") + 2).alias("d")
        )
        latest = needs.join(parents, ["conv_id", "parent"]).groupBy("conv_id", "call_id").agg(F.max("x").alias("x"), F.max("d").alias("d"))
        later, deeper = F.greatest("after", "x"), F.greatest("depth", "d")
        moved = now.join(latest, ["conv_id", "call_id"], "left").select(
            "conv_id",
            "call_id",
            later.alias("after"),
            deeper.alias("depth"),
            "answered",
            ((later > F.col("after")) | (deeper > F.col("depth"))).alias("changed"),
        )
        moved = materialise(moved, f"{home}/order-{step}")
        if moved.where("changed").isEmpty():
            return moved.select("conv_id", "call_id", F.col("after").alias("call_after"), F.col("depth").alias("call_depth"))
        now = moved.drop("changed")


ORDERED = "conv_id bigint, call_id string, cyclic boolean, call_after bigint, call_depth int"


def _order_one(calls: pd.DataFrame) -> pd.DataFrame:
    """The order keys of one conversation's calls (call_id, after, answered, parents) that need or are needed."""
    names = calls["call_id"].tolist()
    at = {name: i for i, name in enumerate(names)}
    turns = [[None if pd.isna(x) else int(x) for x in calls[c]] for c in ("after", "answered")]
    after, answered = turns
    depth, left = [0] * len(names), [0] * len(names)
    children: list[list[int]] = [[] for _ in names]
    for i, parents in enumerate(calls["parents"]):
        for parent in () if parents is None else parents:
            children[at[parent]].append(i)
            left[i] += 1
    ready = [i for i, n in enumerate(left) if not n]
    for i in ready:  # grows while it is read
        done = [x for x in (after[i], answered[i]) if x is not None]
        for k in children[i]:
            later = [x for x in (after[k], *done) if x is not None]
            after[k], depth[k] = max(later, default=None), max(depth[k], depth[i] + 2)
            left[k] -= 1
            if not left[k]:
                ready.append(k)
    bad = [n > 0 for n in left]
    out = pd.DataFrame({"conv_id": calls["conv_id"], "call_id": names, "cyclic": bad})
    out["call_after"] = pd.array([None if b else x for x, b in zip(after, bad, strict=True)], "Int64")
    out["call_depth"] = pd.array([None if b else x for x, b in zip(depth, bad, strict=True)], "Int32")
    return out


def _order_small(firsts: DataFrame, needs: DataFrame) -> DataFrame:
    """ORDERED of the calls that need or are needed, in conversations of a bounded size."""
    parents = needs.groupBy("conv_id", "call_id").agg(F.collect_list("parent").alias("parents"))
    named = needs.select("conv_id", "call_id").union(needs.select("conv_id", "parent")).distinct()
    calls = firsts.where("kind = 'call'").select("conv_id", "call_id", F.col("turn").alias("after"))
    answers = firsts.where("kind = 'result'").select("conv_id", "call_id", F.col("turn").alias("answered"))
    key = ["conv_id", "call_id"]
    nodes = named.join(calls, key).join(answers, key, "left").join(parents, key, "left")
    return nodes.groupBy("conv_id").applyInPandas(_order_one, ORDERED)


def _order_large(firsts: DataFrame, needs: DataFrame, home: str) -> DataFrame:
    """ORDERED of the calls that need or are needed, by rounds of joins."""
    named = needs.select("conv_id", "call_id").union(needs.select("conv_id", "parent")).distinct()
    bad = materialise(_cyclic(needs, home), f"{home}/cyclic")
    own = firsts.join(named, ["conv_id", "call_id"], "left_semi")
    order = _order(own, needs.join(bad, ["conv_id", "call_id"], "left_anti"), home)
    order = order.join(bad.withColumn("cyclic", F.lit(True)), ["conv_id", "call_id"], "left")
    good = F.col("cyclic").isNull()
    return order.select(
        "conv_id", "call_id", (~good).alias("cyclic"), F.when(good, F.col("call_after")).alias("call_after"), F.when(good, F.col("call_depth")).alias("call_depth")
    )


def link(messages: DataFrame, tools: dict[str, dict] = TOOLS) -> DataFrame:
    """One row per call, result and message.

    conv_id, turn, place, role, kind, call_id, status, after and depth (the order key is
    conv_id, after, depth, turn, place), canonical.
    """
    spark = messages.sparkSession
    ship(spark)
    home = shared_root(spark)
    rows = messages.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    entries = rows.mapInArrow(_parse(tools), ENTRIES).withColumn("row", F.monotonically_increasing_id())
    entries = materialise(entries, f"{home}/entries")
    named = entries.where("call_id is not null")
    least = F.min(F.struct("turn", "place", "canonical", "row"))
    firsts = named.groupBy("conv_id", "call_id", "kind").agg(least.alias("x")).select("conv_id", "call_id", "kind", "x.row", "x.turn")
    firsts = materialise(firsts, f"{home}/firsts")
    # one row per identifier on the right: a frequent identifier never multiplies
    other = firsts.select(
        "conv_id",
        "call_id",
        F.when(F.col("kind") == "call", "result").otherwise("call").alias("kind"),
        F.lit(True).alias("linked"),
        F.col("turn").alias("other_turn"),
    )
    linked = entries.join(firsts.select("row", F.lit(True).alias("first")).hint("shuffle_hash"), "row", "left").join(
        other.hint("shuffle_hash"), ["conv_id", "call_id", "kind"], "left"
    )
    linked = linked.withColumns({"first": F.coalesce("first", F.lit(False)), "linked": F.coalesce("linked", F.lit(False))})
    calls = firsts.where("kind = 'call'")
    depends = entries.where("kind = 'call' and size(depends_on) > 0").join(calls.select("row"), "row", "left_semi")
    needs = depends.select("conv_id", "call_id", F.explode("depends_on").alias("parent")).distinct()
    needs = materialise(needs.join(calls.select("conv_id", F.col("call_id").alias("parent")), ["conv_id", "parent"], "left_semi"), f"{home}/needs")
    if needs.isEmpty():
        linked = linked.withColumns({"call_after": F.lit(None).cast("bigint"), "call_depth": F.lit(None).cast("int"), "cyclic": F.lit(False)})
    else:
        sizes = materialise(needs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), f"{home}/sizes")
        small, large = (needs.join(sizes.where(x).select("conv_id"), "conv_id", "left_semi") for x in (F.col("n") <= GRAPH, F.col("n") > GRAPH))
        order = _order_small(firsts, small)
        if not large.isEmpty():
            order = order.union(_order_large(firsts, materialise(large, f"{home}/large"), home))
        linked = linked.join(materialise(order, f"{home}/ordered"), ["conv_id", "call_id"], "left")
        linked = linked.withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    status = (
        F.when(F.col("kind") == "message", F.lit("message"))
        .when(~F.col("first") & F.col("call_id").isNotNull(), F.concat(F.lit("duplicate_"), F.col("kind")))
        .when((F.col("kind") == "call") & F.col("cyclic"), F.lit("cyclic"))
        .when(F.col("verdict") != "ok", F.col("verdict"))
        .when(~F.col("linked"), F.when(F.col("kind") == "call", F.lit("unanswered")).otherwise(F.lit("orphan")))
        .otherwise(F.lit("ok"))
    )
    is_result = F.col("kind") == "result"
    after = F.when(F.col("kind") == "call", F.coalesce("call_after", "turn")).when(is_result, F.greatest("turn", F.coalesce("call_after", "other_turn")))
    depth = F.when(F.col("kind") == "message", 0).otherwise(F.coalesce("call_depth", F.lit(0)) + (is_result & F.col("linked")).cast("int"))
    return linked.select(
        "conv_id",
        "turn",
        "place",
        "role",
        "kind",
        "call_id",
        status.alias("status"),
        F.coalesce(after, "turn").alias("after"),
        depth.cast("int").alias("depth"),
        "canonical",
    )
