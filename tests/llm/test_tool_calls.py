import json

from fxspark.llm import tool_calls as tc

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, parent_id string, state string, level string"
RESULTS = "conv_id long, call_id string, turn long, content string, errors string"
SCHEMA = {"find": {"required": ["q"], "additionalProperties": False, "properties": {
    "q": {"type": "string", "minLength": 2, "maxLength": 5}, "n": {"type": "integer", "minimum": 1, "maximum": 9}, "how": {"type": "string", "enum": ["a", "b"]},
    "deep": {"type": "object"}, "x": {"type": "number"}, "ok": {"type": "boolean"}, "l": {"type": "array"}}}, "free": {}}


def run(spark, calls, results):
    c = spark.createDataFrame([(*x, "z", "z") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, "z") for x in results], RESULTS)
    return {(x.conv_id, x.call_id): x for x in tc.records(c, r, SCHEMA).collect()}


def test_checks_and_canonical_json(spark):
    args = {"a": '{"q":"abc"}', "b": '{"q":"a"}', "c": '{"n":0,"q":"ab"}', "d": '{"q":5}', "e": "{}", "f": "not json", "g": "[1]", "h": '{"zz":1,"q":"ab","yy":2}', "i": '{"q":"ab","how":"c"}',
            "j": '{"x":1.5,"ok":true,"l":[2,1],"deep":{"b":1,"a":[{"d":1,"c":2}]},"q":"é\\"\\n"}', "k": '{"q":"ab","ok":"true","n":1.5}', "l": None, "m": '{ "q" : null }'}
    got = run(spark, [(1, k, 1, "find", v, None) for k, v in args.items()] + [(1, "o", 1, "odd", "{}", None), (1, "p", 1, "free", '{"b":1,"a":2}', None), (1, "q", 1, None, "{}", None)], [(1, "a", 2, "done")])
    errors = {k[1]: list(v.errors) for k, v in got.items()}
    assert errors == {"a": [], "b": ["q has a wrong length"], "c": ["n is out of range"], "d": ["q is not of type string"], "e": ["q is missing"], "f": ["not an object"], "g": ["not an object"],
                      "h": ["unknown arguments: yy, zz"], "i": ["how is none of the choices"], "j": [], "k": ["n is not of type integer", "ok is not of type boolean"], "l": ["not an object"],
                      "m": ["q is not of type string"], "o": ["unknown tool"], "p": [], "q": ["unknown tool"]}
    for k, v in got.items():
        record = json.loads(v.record)
        assert list(record) == sorted(record)
        if k[1] not in ("f", "g", "l"):
            want = json.loads(args.get(k[1]) or {"o": "{}", "p": '{"a":2,"b":1}', "q": "{}"}[k[1]])
            assert json.dumps(record["arguments"], ensure_ascii=False, separators=(",", ":")) == json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    assert json.loads(got[1, "a"].record)["result"] == "done" and got[1, "a"].state == "linked" and got[1, "b"].state == "no result"


def test_links_levels_and_odd_rows(spark):
    chain = [(2, f"c{i}", i, "free", "{}", f"c{i - 1}" if i else None) for i in range(40)]
    ring = [(3, "x", 0, "free", "{}", "z"), (3, "y", 1, "free", "{}", "x"), (3, "z", 2, "free", "{}", "y"), (3, "behind", 3, "free", "{}", "z"), (3, "self", 4, "free", "{}", "self")]
    other = [(4, "a", 5, "free", "{}", "gone"), (4, "a", 3, "free", '{"k":1}', None), (4, "b", 6, "free", "{}", "a"), (None, "a", 1, "free", "{}", None), (5, None, None, None, None, None)]
    got = run(spark, chain + ring + other, [(2, "c0", 1, "r"), (2, "c0", 0, "s"), (9, "lost", 1, None), (None, "n", 1, "t")])
    assert [got[2, f"c{i}"].level for i in range(40)] == list(range(40))
    assert [got[3, k].level for k in ("x", "y", "z", "behind", "self")] == [None] * 5
    assert got[4, "a"].copies == 2 and got[4, "a"].turn == 3 and got[4, "b"].level == 1 and got[4, "a"].level == 0
    assert got[2, "c0"].result_turn == 0 and got[9, "lost"].state == "no call" and got[None, "a"].state == "no id" and got[5, None].state == "no id"
    assert tc.records(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMA).count() == 0


def test_plain_turns_and_no_python(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "a question that is long enough"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (2, 0, "assistant", "hello"),
                                   (None, 0, "user", "x"), (1, None, "user", "x")], "conv_id long, turn long, role string, text string")
    calls, results = tc.from_turns(turns)
    got = tc.records(calls, results, tc.SCHEMAS)
    by = {(r.conv_id, r.call_id): r for r in got.collect()}
    assert by[1, "call-1"].level == 0 and by[1, "call-1"].errors == [] and by[1, "call-3"].level == 1 and by[1, "call-3"].state == "no result"
    assert by[2, "call--1"].state == "no call" and by[None, "call-0"].state == "no id"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_results_without_id_stay(spark):
    calls = [(1, "a", 1, "free", "{}", None), (None, "n", 1, "free", "{}", None)]
    c = spark.createDataFrame([(*x, "z", "z") for x in calls], CALLS)
    r = spark.createDataFrame([(1, "a", 2, "r", "z"), (None, "n", 1, "t", "z"), (None, "n", 1, "t", "z"), (7, None, 3, "u", "z"), (None, None, None, None, "z")], RESULTS)
    got = [(x.conv_id, x.call_id, x.turn, x.result_turn, x.state, x.copies, x.errors, json.loads(x.record).get("result")) for x in tc.records(c, r, SCHEMA).collect()]
    assert sorted(got, key=str) == sorted([(1, "a", 1, 2, "linked", 1, [], "r"), (None, "n", 1, None, "no id", 1, [], None), (None, "n", None, 1, "no id", 0, None, "t"),
                                           (None, "n", None, 1, "no id", 0, None, "t"), (7, None, None, 3, "no id", 0, None, "u"), (None, None, None, None, "no id", 0, None, None)], key=str)


def test_assistant_turns_without_conversation_or_turn_stay(spark):
    turns = spark.createDataFrame([(None, 1, "assistant", "x"), (1, None, "assistant", "y"), (1, 0, "system", "s"), (1, 1, None, "n")], "conv_id long, turn long, role string, text string")
    got = tc.records(*tc.from_turns(turns), tc.SCHEMAS).collect()
    assert sorted([(x.conv_id, x.call_id, x.result_turn, x.state) for x in got], key=str) == sorted([(None, "call-0", 1, "no id"), (1, None, None, "no id")], key=str)
