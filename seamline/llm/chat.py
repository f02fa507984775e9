"""Chat formatting: link tool calls with results and serialise (operator 5).

A message row is (conversation, turn, role, text). Calls and results are read
from the text as JSON: {"tool_calls": [{"id", "name", "arguments": {...}}]} on
assistant rows and {"tool_call_id", "content"} on tool rows. Calls are joined to
results by (conversation, identifier), a hash join that Spark deals by that
pair; per identifier the first call and the first result after it count, and
the others are marked. Arguments are validated against a JSON-Schema subset
(type, required, properties, enum, minLength, additionalProperties).

Order: a result stands after its call and a call after every result that it
names in "after" (a list of identifiers); depth is the longest such chain before a
call, and the calls of a message stand by depth, then place. Depths come from
joins over the links: each round settles the calls whose links all lead to settled
ones, and lets all other links jump over calls that have one link only, so a
chain of n calls takes about log2(n) rounds. Calls on or behind a cycle get no
depth and are marked `cycle`.

Canonical JSON: keys sorted, no spaces, UTF-8 characters kept (halves of surrogate
pairs stay escapes), numbers as Python writes them. What is no strict JSON (NaN,
Infinity, numbers beyond double range, nesting of over 200 levels) is no call
and passes as text. Conversations with no tool messages pass through as text.

Null texts are empty messages; null roles are "unknown"; null conversation ids
form one conversation; calls whose id is missing or no string are never linked
(status `no id`). Each row is a message of its own: rows with equal turns, and
repeated rows, stay, with their own calls only; of calls with one identifier the
first by turn, then name, arguments and place, counts. Very long texts are parsed
in the task that holds them. Extra columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline.llm.shared import table, written

SURROGATE = re.compile("[\ud800-\udfff]")
DEEPEST = 200


def valid_utf8(x: str) -> str:
    """Halves of surrogate pairs as escapes."""
    return SURROGATE.sub(lambda m: "\\u%04x" % ord(m[0]), x)


def canonical(x: object) -> str:
    return valid_utf8(json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def equal(a: object, b: object) -> bool:
    """Equality of JSON values: true is not 1, 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """What of a value does not fit the schema."""
    kinds = schema.get("type")
    kinds = kinds if isinstance(kinds, list) else [kinds]
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    whole = number and (isinstance(value, int) or value.is_integer())
    if not any({"integer": whole, "number": number}.get(k, isinstance(value, TYPES[k]) if k in TYPES else True) for k in kinds):
        return [f"{at}: not {' or '.join(map(str, kinds))}"]
    out = [f"{at}: not one of the values"] if "enum" in schema and not any(equal(value, x) for x in schema["enum"]) else []
    if isinstance(value, str) and len(value) < schema.get("minLength", 0):
        out.append(f"{at}: too short")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known.keys() & value.keys()):
            out += problems(value[k], known[k], f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def number(x: str) -> float:
    if not math.isfinite(y := float(x)):
        raise ValueError(f"{x} is out of range")
    return y


def refused(x: str) -> None:
    raise ValueError(f"{x} is no JSON")


def depth_of(x: object) -> int:
    """How deep lists and objects stand in each other."""
    deep, level = 0, [x]
    while level:
        level = [y for v in level if isinstance(v, (dict, list)) for y in (v.values() if isinstance(v, dict) else v)]
        deep += 1
    return deep


def strict(text: str | None) -> dict | None:
    """The object that a text is, if it is strict JSON; else None."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        got = json.loads(text, parse_float=number, parse_constant=refused)
        return got if isinstance(got, dict) and depth_of(got) <= DEEPEST else None
    except (ValueError, RecursionError):
        return None


def parsed(text: str | None) -> dict:
    return strict(text) or {}


CALL = "msg long, conv_id {0}, turn long, no int, call_id string, name string, arguments string, after array<string>, valid boolean, problem string"


def numbered(messages: DataFrame) -> DataFrame:
    """msg (a number for each row), conv_id, turn, role, text; written, so that numbers stay."""
    turn = F.col("turn").cast("long").alias("turn")
    rows = messages.select("conv_id", turn, F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return written(rows.withColumn("msg", F.monotonically_increasing_id()), "messages")


def tool_calls(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """All calls in assistant messages, with validated canonical arguments."""
    kind = messages.schema["conv_id"].dataType.simpleString()
    sent = dict(schemas)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for msg, conv, turn, text in zip(*(batch.column(c).to_pylist() for c in ("msg", "conv_id", "turn", "text"))):
                calls = parsed(text).get("tool_calls")
                for no, call in enumerate(calls if isinstance(calls, list) else ()):
                    if not isinstance(call, dict):
                        continue
                    name, args, call_id = call.get("name"), call.get("arguments", {}), call.get("id")
                    name = valid_utf8(name) if isinstance(name, str) else ""
                    wrong = []
                    if isinstance(args, str):
                        read = strict(args) if args.strip() else {}
                        args, wrong = (args, ["$: no JSON object"]) if read is None else (read, [])
                    wrong = wrong or (problems(args, sent[name]) if name in sent else ["no such tool"])
                    after = call.get("after")
                    after = [valid_utf8(x) for x in after if isinstance(x, str)] if isinstance(after, list) else []
                    call_id = valid_utf8(call_id) if isinstance(call_id, str) else None
                    out.append((msg, conv, turn, no, call_id, name, canonical(args), after, not wrong, valid_utf8("; ".join(wrong)) or None))
            names = ["msg", "conv_id", "turn", "no", "call_id", "name", "arguments", "after", "valid", "problem"]
            types = [pa.int64(), batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 10, types)], names)

    return messages.where("role = 'assistant'").select("msg", "conv_id", "turn", "text").mapInArrow(run, CALL.format(kind))


def tool_results(messages: DataFrame) -> DataFrame:
    """All results in tool messages, read as calls are: identifiers are strings. Content that
    is no string is given as canonical JSON."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [parsed(t) for t in batch.column("text").to_pylist()]
            ids = [valid_utf8(x) if isinstance(x := g.get("tool_call_id"), str) else None for g in got]
            content = [None if (x := g.get("content")) is None else valid_utf8(x) if isinstance(x, str) else canonical(x) for g in got]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(ids, pa.string()), pa.array(content, pa.string())], ["conv_id", "turn", "call_id", "content"])

    kind = messages.schema["conv_id"].dataType.simpleString()
    got = messages.where("role = 'tool'").select("conv_id", "turn", "text").mapInArrow(run, f"conv_id {kind}, turn long, call_id string, content string")
    return got.where("call_id is not null")


def same(left: str, right: str):
    """Join condition: the same conversation (null is one) and identifier; columns prefixed."""
    return F.col(f"{left}conv_id").eqNullSafe(F.col(f"{right}conv_id")) & (F.col(f"{left}call_id") == F.col(f"{right}call_id"))


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*(F.col(c).alias(p + c) for c in df.columns))


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, depth of all calls (conv_id, call_id unique, after) that no cycle is before."""
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode(F.array_distinct("after")).alias("before"), F.lit(1).alias("far"), F.lit(0).alias("settled"))
    known = prefixed(nodes, "k_")
    edges = written(edges.join(known, F.col("conv_id").eqNullSafe(F.col("k_conv_id")) & (F.col("before") == F.col("k_call_id")), "left_semi"), "call-links")
    depth = written(nodes.join(prefixed(edges.select("conv_id", "call_id").distinct(), "k_"), same("", "k_"), "left_anti").withColumn("depth", F.lit(0)), "depth")
    settled = depth
    while not edges.isEmpty():
        # a link to a settled call gets its depth; one to a call with a single link, and none that was settled before, jumps over it
        single = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max("settled").alias("was"), F.first("before").alias("next"), F.first("far").alias("more")).where("n = 1 and was = 0").drop("n", "was")
        state = edges.join(prefixed(settled, "d_"), F.col("conv_id").eqNullSafe(F.col("d_conv_id")) & (F.col("before") == F.col("d_call_id")), "left")
        state = state.join(prefixed(single, "s_"), F.col("conv_id").eqNullSafe(F.col("s_conv_id")) & (F.col("before") == F.col("s_call_id")), "left")
        to = F.when(F.col("d_depth").isNotNull(), F.lit(None)).otherwise(F.coalesce("s_next", "before"))
        far = F.when(F.col("d_depth").isNotNull(), F.col("far") + F.col("d_depth")).otherwise(F.col("far") + F.coalesce("s_more", F.lit(0)))
        # before is null where the way is settled; then far is the depth by that way
        moved = state.select("conv_id", "call_id", "settled", to.alias("before"), far.alias("far"))
        moved = moved.select("conv_id", "call_id", "before", "far", F.when(F.col("before").isNull(), F.greatest("settled", "far")).otherwise(F.col("settled")).alias("settled"))
        moved = written(moved.groupBy("conv_id", "call_id", "before").agg(F.max("far").alias("far"), F.max("settled").alias("settled")), "call-links")
        new = written(moved.groupBy("conv_id", "call_id").agg(F.count("before").alias("open"), F.max("settled").alias("depth")).where("open = 0").drop("open"), "depth")
        if new.isEmpty():
            break  # the rest is on cycles, or behind one
        settled = settled.union(new)
        best = moved.groupBy("conv_id", "call_id").agg(F.max("settled").alias("settled"))
        still = moved.where("before is not null").drop("settled").join(prefixed(best, "b_"), same("", "b_")).select("conv_id", "call_id", "before", "far", F.col("b_settled").alias("settled"))
        edges = written(still, "call-links")
    return settled


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """calls with result, result_turn, status (ok, invalid, unanswered, repeated, cycle, no id) and depth."""
    calls = written(calls, "parsed-calls")
    order = F.struct("turn", "name", "arguments", "no", "msg")
    named = calls.where("call_id is not null")
    first = prefixed(named.groupBy("conv_id", "call_id").agg(F.min(order).alias("f")), "f_")
    named = named.join(first, same("", "f_")).withColumn("nth", F.when(F.col("f_f").eqNullSafe(order), 1).otherwise(2)).drop(*first.columns)
    once = named.where("nth = 1")
    joined = once.select("conv_id", "call_id", "turn").join(prefixed(results, "r_"), same("", "r_") & (F.col("r_turn") > F.col("turn")))
    answers = prefixed(joined.groupBy("conv_id", "call_id").agg(F.min(F.struct("r_turn", "r_content")).alias("r")), "a_")
    every = once.join(answers, same("", "a_"), "left").select(*once.columns, F.col("a_r.r_turn").alias("result_turn"), F.col("a_r.r_content").alias("result"))
    every = written(every, "calls")
    deep = prefixed(depths(every.select("conv_id", "call_id", "after")), "d_")
    every = every.join(deep, same("", "d_"), "left").withColumn("depth", F.col("d_depth")).drop(*deep.columns)
    rest = named.where("nth = 2").unionByName(calls.where("call_id is null").withColumn("nth", F.lit(0)))
    every = every.unionByName(rest, allowMissingColumns=True)
    status = F.when(F.col("nth") == 0, "no id").when(F.col("nth") > 1, "repeated").when(F.col("depth").isNull(), "cycle").when(~F.col("valid"), "invalid").when(F.col("result_turn").isNull(), "unanswered").otherwise("ok")
    return every.select("msg", "conv_id", "turn", "no", "call_id", "name", "arguments", "after", "problem", "result_turn", "result", status.alias("status"), "depth")


def formatted(messages: DataFrame, links: DataFrame) -> DataFrame:
    """One row per message (see numbered()), with the calls of assistant messages in
    topological order and canonical JSON in column json; call_order lists their
    identifiers, depth is the greatest one of them."""
    each = F.struct(F.coalesce("depth", F.lit(1 << 30)).alias("depth"), "no", "call_id", "name", "arguments", "status", "result")
    calls = links.groupBy(F.col("msg").alias("of")).agg(F.array_sort(F.collect_list(each)).alias("calls"), F.max("depth").cast("long").alias("depth"))
    both = messages.join(calls, F.col("msg") == F.col("of"), "left")
    kind = messages.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, n, good, order = [], [], [], []
            for role, text, calls in zip(*(batch.column(c).to_pylist() for c in ("role", "text", "calls"))):
                message = {"role": role, "content": text}
                if calls:
                    message |= {"content": "", "tool_calls": [{"id": c["call_id"], "name": c["name"], "arguments": json.loads(c["arguments"]), "status": c["status"], "result": c["result"]} for c in calls]}
                lines.append(canonical(message))
                n.append(len(calls or ()))
                good.append(sum(c["status"] == "ok" for c in calls or ()))
                order.append(",".join(c["call_id"] or "" for c in calls) if calls else None)
            arrays = [batch.column("conv_id"), batch.column("turn"), pa.array(n, pa.int64()), pa.array(good, pa.int64()), pa.array(order, pa.string()), batch.column("depth"), pa.array(lines, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "n_calls", "n_ok", "call_order", "depth", "json"])

    return both.select("conv_id", "turn", "role", "text", "calls", "depth").mapInArrow(run, f"conv_id {kind.simpleString()}, turn long, n_calls long, n_ok long, call_order string, depth long, json string")


def chat(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Parse, link, order, validate and serialise."""
    rows = numbered(messages)
    return formatted(rows, linked(tool_calls(rows, schemas), tool_results(rows)))


#: The schema of the query's only tool.
REPLY = {"reply": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string", "minLength": 1}}, "additionalProperties": False}}


def as_tool_protocol(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool messages, as the test tables hold no calls: a user
    turn becomes an assistant message with a call of `reply` for each of its first
    two sentences and one for the rest, listed from the last to the first; each waits
    for the one before it, and the first for the last one of the user turn before.
    The assistant turn after it is the result of its last call. Other roles stay."""
    turn = F.col("turn").cast("long")
    text = F.coalesce("text", F.lit(""))
    key = lambda c, k: F.concat(F.lit("t"), c.cast("string"), F.lit("."), k.cast("string"))
    parts = F.reverse(F.split(text, r"(?<=[.!?])\s+", 3))
    waits = lambda k: F.when(k + 1 < F.size(parts), F.array(key(turn, k + 1))).otherwise(F.array(key(turn - 2, F.lit(0))))
    calls = F.transform(parts, lambda x, k: F.struct(key(turn, k).alias("id"), F.lit("reply").alias("name"), F.struct(x.alias("text")).alias("arguments"), waits(k).alias("after")))
    call = F.to_json(F.struct(calls.alias("tool_calls")))
    result = F.to_json(F.struct(key(turn - 1, F.lit(0)).alias("tool_call_id"), text.alias("content")))
    user, answer = F.col("role") == "user", (F.col("role") == "assistant") & (turn > 0)
    return conversations.select("conv_id", turn.alias("turn"), F.when(user, "assistant").when(answer, "tool").otherwise(F.col("role")).alias("role"), F.when(user, call).when(answer, result).otherwise(F.col("text")).alias("text"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat(as_tool_protocol(table(spark, sf_dir, "conversations")), REPLY)


QUERIES = {"op5_chat": op5_chat}
ORACLE_SQL: dict[str, str] = {}
