import json
import random
import time

import pytest

from panelforge.llm import chat_formatting as cf
from panelforge.llm import json_schema as js

TURNS = "conv_id long, turn long, role string, text string, extra string"


def formatted(spark, *rows):
    return cf.format_messages(spark.createDataFrame([(*r, "x") for r in rows], TURNS))


def call(id_, name, arguments, *needs):
    return json.dumps({"id": id_, "name": name, "arguments": arguments, "depends_on": list(needs)})


def test_links_orders_and_validates(spark):
    text = f"Look. <tool_call>{call('b', 'search', {'query': 1, 'z': 2}, 'a')}</tool_call> and <tool_call>[{call('a', 'weather', {'place': 'X', 'days': 2})}]</tool_call>"
    got = {
        r.turn: r
        for r in formatted(
            spark,
            (1, 0, "assistant", text),
            (1, 1, "tool", '{"tool_call_id":"a","content":{"t":1}}'),
            (1, 2, "tool", '{"tool_call_id":"a","content":"again"}'),
            (1, 3, "tool", '{"tool_call_id":"zz","content":"no"}'),
            (1, 4, "assistant", call("a", "fetch", {"url": "u"})),
            (2, 5, "tool", '{"tool_call_id":"a","content":"other conversation"}'),
        ).collect()
    }
    first = json.loads(got[0].json)["tool_calls"]
    assert [(c["id"], c["level"], c["status"]) for c in first] == [("a", 0, "linked"), ("b", 1, "invalid")]
    assert first[0]["result"] == '{"t":1}' and first[1]["errors"] == ["query is no string", "unknown z"]
    assert json.loads(got[4].json)["tool_calls"][0]["status"] == "duplicate"
    assert [got[k].unmatched for k in (1, 2, 3, 5)] == [False, True, True, True]
    assert (got[0].n_calls, got[0].n_invalid, got[0].n_linked) == (2, 1, 1)


def test_cycles_and_unknown_needs_have_no_order(spark):
    rows = [(1, 0, "assistant", call("c", "fetch", {"url": "u"}, "d")), (1, 1, "assistant", call("d", "fetch", {"url": "u"}, "c")), (1, 2, "assistant", call("e", "fetch", {"url": "u"}, "nobody"))]
    got = [json.loads(r.json)["tool_calls"][0] for r in formatted(spark, *rows).collect()]
    assert all(c["level"] is None and c["status"] == "unordered" for c in got)


def test_json_is_canonical_and_total(spark):
    rows = [(1, 0, "user", 'q "x" \\ \n\t   é 日 </s>'), (None, None, None, None), (1, 1, "assistant", "{not json"), (1, 2, "tool", "plain"), (1, 3, "assistant", ""), (1, 0, "user", 'q "x" \\ \n\t   é 日 </s>'), (1, 5, "user", "a" * 200000)]
    got = formatted(spark, *rows).collect()
    assert len(got) == 6  # repeated rows count once
    for r in got:
        assert js.canonical(json.loads(r.json)) == r.json
    assert {json.loads(r.json)["content"] for r in got} == {rows[0][3], None, "{not json", "plain", "", "a" * 200000}
    assert formatted(spark).count() == 0


def test_chains_are_followed_level_by_level(spark):
    rows = [(1, i, "assistant", call(f"c{i}", "fetch", {"url": "u"}, *([f"c{i + 1}"] if i < 6 else []))) for i in range(7)]
    got = {r.turn: json.loads(r.json)["tool_calls"][0]["level"] for r in formatted(spark, *rows).collect()}
    assert got == {i: 6 - i for i in range(7)}


def test_long_chains_are_followed_to_their_end(spark):
    n = 400
    rows = [(None, i, "assistant", call(f"c{i}", "fetch", {"url": "u"}, *([f"c{i - 1}", "c0"] if i else []))) for i in range(n)]
    rows += [(None, i, "tool", json.dumps({"tool_call_id": f"c{i}", "content": "x"})) for i in range(n)]
    got = [r for r in formatted(spark, *rows).collect() if r.role == "assistant"]
    calls = {r.turn: json.loads(r.json)["tool_calls"][0] for r in got}
    assert {i: (c["level"], c["status"]) for i, c in calls.items()} == {i: (i, "linked") for i in range(n)}
    assert sum(r.n_linked for r in got) == n


@pytest.mark.parametrize("fold", [0, 5, 1000])
def test_levels_by_folds_and_by_rounds_are_equal(spark, fold):
    needs = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c", "a"], "e": ["nobody", "a"], "f": ["g"], "g": ["f"], "h": ["g", "a"], "i": ["i"], "j": ["d", "b", "b"]}
    want = {"a": 0, "b": 1, "c": 2, "d": 3, "j": 4}
    rows = [(conv, k, 0, i, True, list(x)) for conv in (1, None) for k, (i, x) in enumerate(needs.items(), 100 * (conv or 2))]
    rows += [(3, 500, 0, "a", True, []), (3, 500, 1, "z", True, ["a"]), (3, 501, 0, "a", False, ["z"])]  # a few needs; the last is a duplicate
    rows = [(c, k, *x) for k, (c, *x) in enumerate(rows)]  # each its own turn
    calls = spark.createDataFrame(rows, "conv_id long, turn long, row long, place int, call_id string, owner boolean, depends_on array<string>")
    got = {(r.conv_id, r.call_id, r.row): r.level for r in cf.order(calls, fold).collect()}
    assert got == {(c, i, r): want.get(i) for c, _, r, _, i, _, _ in rows if c != 3} | {(3, "a", 500): 0, (3, "z", 500): 1, (3, "a", 501): 2}


@pytest.mark.parametrize("fold", [1, 7, 10**6])
def test_levels_of_large_conversations(spark, fold):
    rng = random.Random(fold)
    n, rows, want = 120, [], {}
    for i in range(n):  # chains within and across turns, back and forth
        needs = sorted(rng.sample(range(i), min(i, rng.randrange(3))))
        rows.append((None, i if i % 5 else 0, i, 0, f"c{i}", True, [f"c{k}" for k in needs]))
        want[i] = max((want[k] + 1 for k in needs), default=0)
    calls = spark.createDataFrame(rows, "conv_id long, turn long, row long, place int, call_id string, owner boolean, depends_on array<string>")
    assert {r.row: r.level for r in cf.order(calls, fold).collect()} == want


ODD = [
    "[" * 100_000,
    "[" * 500 + "]" * 500,
    '{"name":"fetch","arguments":{"url":"\\ud800"}}',
    '{"name":"fetch","arguments":{"url":NaN}}',
    '{"name":"fetch","arguments":{"n":1e999}}',
    '{"name":"fetch","id":"\\udfff"}',
    '{"name":"fetch","arguments":' + "9" * 5000 + "}",
    "{" * 300,
    '{"name":"' + "[" * 300 + '"}',
]


def test_no_text_stops_the_job(spark):
    rows = [(1, i, role, t) for i, t in enumerate(ODD) for role in ("assistant", "tool")] + [(1, 99, "tool", '{"tool_call_id":"\\ud800","content":1}')]
    got = formatted(spark, *rows).collect()
    assert len(got) == len(rows)
    assert all(r.n_calls == (r.role == "assistant" and r.turn == len(ODD) - 1) for r in got)  # only the last is a call, of an odd name
    assert {json.loads(r.json)["content"] for r in got} == {r[3] for r in rows}


CASES = [
    ({"type": "object", "properties": {"a": {"type": "array", "items": {"type": "integer"}}}}, {"a": [1, 2.0, "x", True]}, ["a[2] is no integer", "a[3] is no integer"]),
    ({"properties": {"a": {"properties": {"b": {"enum": [1, "1", None]}}, "required": ["b", "c"], "additionalProperties": False}}}, {"a": {"b": True, "d": 1}}, ["a.b is none of its values", "missing a.c", "unknown a.d"]),
    ({"type": "object"}, [1], ["arguments is no object"]),
    ({"properties": {"n": {"minimum": 1, "exclusiveMaximum": 5, "multipleOf": 2}}}, {"n": 5}, ["n breaks exclusiveMaximum", "n breaks multipleOf"]),
    ({"properties": {"s": {"minLength": 2, "maxLength": 3, "pattern": "^a"}}}, {"s": "日"}, ["s breaks minLength", "s breaks pattern"]),
    ({"properties": {"x": {"anyOf": [{"type": "string"}, {"type": "null"}]}, "y": {"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "z": {"not": {"type": "string"}}}}, {"x": 1, "y": 3, "z": "q"}, ["x fits none or too many of its forms", "y fits none or too many of its forms", "z is of an excluded form"]),
    ({"additionalProperties": {"type": "string"}}, {"p": 1, "q": "x"}, ["p is no string"]),
    ({"properties": {"u": {"uniqueItems": True, "minItems": 3, "prefixItems": [{"const": 1}], "items": False}}}, {"u": [1.0, 1]}, ["u breaks minItems", "u[1] is not allowed"]),
    (True, {"any": 1}, []),
]


@pytest.mark.parametrize("schema, value, wrong", CASES)
def test_validation_of_nested_arguments(schema, value, wrong):
    assert js.errors(value, schema) == sorted(wrong)


def test_schemas_from_a_table(spark):
    tools = spark.createDataFrame([("t", '{"required":["a"]}'), ("t", '{"required":["b"]}'), (None, "{}"), ("u", None)], "name string, schema string")
    assert cf.schemas_of(tools) == {"t": {"required": ["b"]}}


def brute(turns, schemas):
    """All messages by plain loops over whole conversations: (conv, turn, role, text) to (n_calls, n_invalid, n_linked, unmatched, calls)."""
    out = {}
    for conv in {t[0] for t in turns}:
        mine = sorted({t for t in turns if t[0] == conv}, key=lambda t: t[1])
        calls, results = [], []
        for t in mine:
            if t[2] == "assistant":
                calls += [(t, k, c) for k, c in enumerate(cf.calls_in(t[3]))]
            elif t[2] == "tool":
                try:
                    v = js.read(t[3])
                except ValueError:
                    v = None
                if isinstance(v, dict) and "tool_call_id" in v:
                    results.append((t, v))
        owner, answer = {}, {}
        for t, k, c in calls:
            if c.get("id") is not None:
                owner.setdefault(c["id"], (t, k))
        for t, v in results:
            if v["tool_call_id"] in owner:
                answer.setdefault(v["tool_call_id"], t)
        level = {}
        for _ in range(len(calls) + 1):
            for t, k, c in calls:
                needs = [owner.get(x) for x in c.get("depends_on", [])]
                if all(x in level for x in needs):
                    level[(t, k)] = max((level[x] + 1 for x in needs), default=0)
        for t in mine:
            own = []
            for k, c in [(k, c) for u, k, c in calls if u == t]:
                wrong = cf.errors_of(c["name"], c.get("arguments", {}), schemas)
                i, at = c.get("id"), (t, k)
                status = "duplicate" if i is not None and owner[i] != at else "unordered" if at not in level else "invalid" if wrong else "linked" if i in answer else "unanswered"
                own.append((level.get(at, 1 << 30), k, i, status, wrong))
            unmatched = any(u == t and answer.get(v["tool_call_id"]) != t for u, v in results)
            out[t] = (len(own), sum(bool(x[4]) for x in own), sum(x[3] == "linked" for x in own), unmatched, [(x[2], x[3]) for x in sorted(own, key=lambda x: x[:2])])
    return out


def test_thousands_of_calls_match_brute_force(spark):
    rng = random.Random(8)
    turns = []
    for conv in range(40):
        n = 0
        for turn in range(rng.randrange(2, 120)):
            if rng.random() < 0.6:
                some = []
                for _ in range(rng.randrange(1, 4)):
                    name, args = rng.choice([("search", {"query": "q", "filters": [{"field": "f", "value": rng.choice([1, None])}]}), ("weather", {"place": "P", "unit": rng.choice("CFX")}), ("fetch", {"url": "u"}), ("none", {})])
                    needs = [f"c{rng.randrange(n + 1)}" for _ in range(rng.choice([0, 0, 1, 2]))] if rng.random() < 0.9 else [f"c{rng.randrange(n + 4)}"]
                    some.append({"id": rng.choice([f"c{n}", f"c{n}", f"c{max(0, n - 1)}"]), "name": name, "arguments": args, "depends_on": needs})
                    n += 1
                turns.append((conv, turn, "assistant", json.dumps(some)))
            else:
                turns.append((conv, turn, "tool", json.dumps({"tool_call_id": f"c{rng.randrange(n + 2)}", "content": turn})))
    want = brute(turns, cf.SCHEMAS)
    got = formatted(spark, *turns).collect()
    assert sum(x[0] for x in want.values()) > 2000 and len(got) == len(turns)
    texts = {t[:3]: t for t in turns}
    for r in got:
        calls = [(c["id"], c["status"]) for c in json.loads(r.json)["tool_calls"]]
        assert (r.n_calls, r.n_invalid, r.n_linked, r.unmatched, calls) == want[texts[(r.conv_id, r.turn, r.role)]]


def test_marks_are_read_once():
    assert cf.marked("a <tool_call> x </tool_call><tool_call>\ny <tool_call> z</tool_call> <tool_call> open") == ["x", "y <tool_call> z"]
    began = time.time()
    assert cf.marked("<tool_call>" * 500_000) == []
    assert cf.marked("<tool_call>x</tool_call>" * 200_000) == ["x"] * 200_000
    assert time.time() - began < 5


def test_multiples_are_exact():
    of = lambda value, number: js.errors(value, {"multipleOf": number})
    assert of(int("9" * 400), 0.5) == of(0.3, 0.1) == of(1e300, 2) == of(6, 3) == []
    assert of(0.35, 0.1) and of(7, 2) and of(int("9" * 400), 2)


@pytest.mark.parametrize("keyword", ["$ref", "if", "patternProperties", "contains", "dependentRequired", "propertyNames"])
def test_keywords_that_would_go_unseen_are_refused(keyword):
    for schema in ({keyword: {}}, {"properties": {"a": {keyword: {}}}}, {"anyOf": [True, {"items": {keyword: {}}}]}):
        with pytest.raises(ValueError, match="not supported"):
            js.checked(schema)
    assert js.checked({"type": "object", "properties": {"if": {"type": "string"}}, "description": "x"})
