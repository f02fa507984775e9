import json

from seamline.llm import chat as c

SCHEMA = {"add": {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}, "unit": {"enum": ["m", "s"]}}, "additionalProperties": False}}


def call(i, name="add", args=None, after=()):
    return {"id": i, "name": name, "arguments": {"a": 1} if args is None else args, "after": list(after)}


def test_schema_subset():
    s = SCHEMA["add"]
    assert c.problems({"a": 2, "unit": "m"}, s) == []
    assert c.problems({"a": True}, s) and c.problems({"a": 1.5}, s) and c.problems({"a": 1, "unit": "x"}, s)
    assert c.problems({}, s) == ["$.a: missing"] and c.problems({"a": 1, "z": 0}, s) == ["$.z: unknown"] and c.problems([], s)
    assert c.canonical({"b": [1, "é"], "a": None}) == '{"a":null,"b":[1,"é"]}'


def test_links_order_validation_and_json(spark):
    j = json.dumps
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", j({"tool_calls": [call("c", after=["b"]), call("b", after=["a"]), call("a"), call("x", "none"), call("y", args={"a": "1"})]})),
        (1, 2, "tool", j({"tool_call_id": "a", "content": "ra"})),
        (1, 3, "tool", j({"tool_call_id": "b", "content": "rb"})),
        (1, 4, "tool", j({"tool_call_id": "b", "content": "later"})),
        (1, 5, "assistant", j({"tool_calls": [call("a"), call("p", after=["q"]), call("q", after=["p"]), "odd"]})),
        (1, 6, "assistant", "{broken"),
        (2, 0, "tool", j({"tool_call_id": "a", "content": "before its call"})),
        (2, 1, "assistant", j({"tool_calls": [call("a", args='{"a": 7}')]})),
        (None, 0, None, None),
        (3, 0, "user", ""),
        (3, 0, "user", ""),
    ]
    messages = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, json string")
    messages_ = c.numbered(messages)
    links = c.linked(c.tool_calls(messages_, SCHEMA), c.tool_results(messages_))
    got = {(r.conv_id, r.turn, r.call_id): (r.status, r.depth, r.result) for r in links.collect()}
    assert got == {
        (1, 1, "a"): ("ok", 0, "ra"), (1, 1, "b"): ("ok", 1, "rb"), (1, 1, "c"): ("unanswered", 2, None),
        (1, 1, "x"): ("invalid", 0, None), (1, 1, "y"): ("invalid", 0, None),
        (1, 5, "a"): ("repeated", None, None), (1, 5, "p"): ("cycle", None, None), (1, 5, "q"): ("cycle", None, None),
        (2, 1, "a"): ("unanswered", 0, None),
    }
    out = c.chat(messages, SCHEMA).collect()
    assert len(out) == len(rows)
    line = next(r for r in out if (r.conv_id, r.turn) == (1, 1))
    assert [x["id"] for x in json.loads(line.json)["tool_calls"]] == ["a", "x", "y", "b", "c"] and (line.n_calls, line.n_ok) == (5, 2)
    assert line.json == c.canonical(json.loads(line.json))
    assert next(r for r in out if r.conv_id is None).json == '{"content":"","role":"unknown"}'
    assert c.chat(messages.limit(0), SCHEMA).count() == 0


def test_query_protocol_links_every_pair(spark):
    rows = [(7, 0, "system", "s"), (7, 1, "user", "q1"), (7, 2, "assistant", "a1"), (7, 3, "user", "q2"), (7, 4, "assistant", "a2"), (8, 0, "assistant", "alone"), (8, 1, "user", None)]
    out = {(r.conv_id, r.turn): (r.n_calls, r.n_ok, json.loads(r.json)) for r in c.chat(c.as_tool_protocol(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), c.REPLY).collect()}
    assert out[7, 1][:2] == (1, 1) and out[7, 3][2]["tool_calls"][0]["result"] == "a2"
    assert out[8, 0][2] == {"role": "assistant", "content": "alone"} and out[8, 1][2]["tool_calls"][0]["status"] == "invalid"


def test_what_is_no_strict_json_passes_as_text(spark):
    j = json.dumps
    deep = '{"tool_calls": ' + "[" * 100_000 + "]" * 100_000 + "}"
    nested = '{"tool_calls": ' + "[" * 3000 + "]" * 3000 + "}"
    texts = [
        '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": 1e999}}]}',
        '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": Infinity}}]}',
        '{"tool_calls": [{"id": "a", "name": "add", "arguments": {"a": NaN}}]}',
        deep,
        nested,
        "[" * 10,
    ]
    half = '{"tool_calls": [{"id": "\\ud800", "name": "\\udfff", "arguments": {"a": "\\ud800"}, "after": ["\\ud800"]}]}'
    bare = j({"tool_calls": [{"name": "add", "arguments": {"a": 1}}, {"id": None, "name": None}, {"id": 5, "arguments": 2.0}, call("z", args={"a": 2.0})]})
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)] + [(2, 0, "assistant", half), (3, 0, "assistant", bare), (3, 1, "tool", j({"tool_call_id": "None", "content": "x"})), (3, 2, "tool", '{"tool_call_id": "z", "content": "\\ud800"}')]
    out = {(r.conv_id, r.turn): r for r in c.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMA).collect()}
    assert all(out[1, k].n_calls == 0 and json.loads(out[1, k].json)["content"] == t for k, t in enumerate(texts))
    assert out[2, 0].n_calls == 1 and json.loads(out[2, 0].json)["tool_calls"][0]["status"] == "cycle"
    got = json.loads(out[3, 0].json)["tool_calls"]
    assert [x["status"] for x in got] == ["ok", "no id", "no id", "no id"] and {x["result"] is None for x in got[1:]} == {True}


def brute(rows):
    """Status and depth of every call, one conversation and call after the other."""
    calls, results = {}, {}
    for m, (conv, turn, role, text) in enumerate(rows):
        got = json.loads(text)
        for no, x in enumerate(got.get("tool_calls", ())):
            calls.setdefault((conv, x["id"]), []).append((turn, x["name"], c.canonical(x["arguments"]), no, m, x["after"]))
        if role == "tool":
            results.setdefault((conv, got["tool_call_id"]), []).append(turn)
    first = {k: min(v) for k, v in calls.items()}
    after = {k: [(k[0], x) for x in v[5] if (k[0], x) in first] for k, v in first.items()}
    depth, more = {}, True
    while more:
        new = {k: max((depth[x] + 1 for x in v), default=0) for k, v in after.items() if k not in depth and all(x in depth for x in v)}
        depth |= new
        more = bool(new)
    out = {}
    for k, v in calls.items():
        for x in v:
            if x != first[k]:
                out[x[4], x[3]] = ("repeated", None)
            elif k not in depth:
                out[x[4], x[3]] = ("cycle", None)
            else:
                answered = any(t > x[0] for t in results.get(k, ()))
                out[x[4], x[3]] = ("ok" if answered else "unanswered", depth[k])
    return out


def test_random_conversations_match_brute_force(spark):
    import random

    rng = random.Random(6)
    rows = []
    for conv in (1, 2, 3, None):
        names = ["n%d" % i for i in range(25)]
        for turn in range(12):
            if rng.random() < 0.4:
                rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice(names), "content": "r"})))
            else:
                some = [call(i, args={"a": rng.randrange(9)}, after=rng.sample(names[: names.index(i)] if rng.random() < 0.97 else names, min(rng.randrange(4), names.index(i)))) for i in rng.sample(names, 4)]
                rows.append((conv, turn, "assistant", json.dumps({"tool_calls": some})))
    chain = [call("c%d" % i, after=["c%d" % (i - 1)] if i else []) for i in range(70)]
    rows.append((9, 0, "assistant", json.dumps({"tool_calls": chain[::-1]})))
    rows += [rows[0]] * 2
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "conv_id long, turn long, role string, text string, k int")
    numbered = c.numbered(docs.coalesce(1).sortWithinPartitions("k"))
    number = {r.msg: k for k, r in enumerate(numbered.orderBy("msg").collect())}
    got = {(number[r.msg], r.no): (r.status, r.depth) for r in c.linked(c.tool_calls(numbered, SCHEMA), c.tool_results(numbered)).collect()}
    assert got == brute(rows)
    assert max(d for _, d in got.values() if d is not None) == 69
    line = next(r for r in c.chat(docs, SCHEMA).collect() if r.conv_id == 9)
    assert line.call_order == ",".join("c%d" % i for i in range(70)) and line.depth == 69


def test_arguments_that_are_no_json_and_ids_that_are_no_strings(spark):
    j = json.dumps
    calls = [call("1", args="not json"), call("2", args=" "), call("3", args="[1]"), call("4", args='{"a": 1}')]
    rows = [(1, 0, "assistant", j({"tool_calls": calls})), (1, 1, "tool", '{"tool_call_id": 4, "content": "a number"}'), (1, 2, "tool", j({"tool_call_id": "4", "content": {"b": 1, "a": None}})), (1, 3, "tool", "{broken"), (1, 4, "tool", None)]
    m = c.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.call_id: (r.status, r.arguments, r.problem, r.result) for r in c.linked(c.tool_calls(m, SCHEMA), c.tool_results(m)).collect()}
    assert got == {"1": ("invalid", '"not json"', "$: no JSON object", None), "2": ("invalid", "{}", "$.a: missing", None), "3": ("invalid", '"[1]"', "$: no JSON object", None), "4": ("ok", '{"a":1}', None, '{"a":null,"b":1}')}


def test_types_in_a_list_and_values_of_an_enum():
    either = {"type": ["string", "null"]}
    assert c.problems(None, either) == [] and c.problems("x", either) == [] and c.problems(1, either) == ["$: not string or null"]
    ones = {"enum": [1, "a", [0], {"k": False}]}
    assert c.problems(1, ones) == [] and c.problems(1.0, ones) == [] and c.problems([0], ones) == [] and c.problems({"k": False}, ones) == []
    assert all(c.problems(x, ones) for x in (True, "1", [False], {"k": 0}, {}))


def test_very_long_messages(spark):
    long = "wort " * 200_000
    rows = [(1, 0, "assistant", json.dumps({"tool_calls": [call("a", args={"a": 1, "unit": long})]})), (1, 1, "tool", json.dumps({"tool_call_id": "a", "content": long}))]
    out = {r.turn: json.loads(r.json) for r in c.chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMA).collect()}
    assert out[0]["tool_calls"][0]["result"] == long and out[0]["tool_calls"][0]["status"] == "invalid"
