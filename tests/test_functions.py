"""Python and column functions against plain expectations."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import expr as E
from tidemill.functions.toolcall import Limits, is_flat, matched_share, normalized_row, normalized_tool, parsed_call, schema_errors


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f("x").alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [(None, False), ("", False), (" \t\n", False), ("  ", False), ("\x1c", False), ("a", True), (" é ", True), ("​", True)])
def test_nonblank(spark, text, want):
    assert _one(spark, text, E.nonblank) == want


def test_python_agrees_on_the_split_hash(spark):
    import hashlib

    for text in ("a", "é\n", ""):
        want = int.from_bytes(hashlib.sha256(f"42:{text}".encode()).digest()[:4], "big") % 10_000 / 10_000
        assert _one(spark, text, lambda c: E.hash_position(c, 42)) == want


@pytest.mark.parametrize(("text", "want"), [("The answer is 1,234.", 1234.0), ("1 2\nFinal answer: -3.5", -3.5), ("final ANSWER - 7 of 9", 9.0), ("none", None), ("Final answer: none 4? 5", 5.0)])
def test_final_number(spark, text, want):
    assert _one(spark, text, E.final_number) == want


def test_repetition(spark):
    assert _one(spark, "a b c d e " * 10, E.repeats_itself)
    assert not _one(spark, "a a a", E.repeats_itself)
    assert not _one(spark, " ".join(f"w{i}" for i in range(30)), E.repeats_itself)
    assert not _one(spark, None, E.repeats_itself)


def test_cleaned_reasoning(spark):
    assert _one(spark, "a  <<1+1=2>> b\r\n\n  c\td  \n", E.cleaned_reasoning) == "a b\nc d"


def test_special_tokens(spark):
    assert _one(spark, "im_start im_assistant\nHello im_end more", E.assistant_content) == "Hello"
    assert _one(spark, "a tool_calling im_end", E.masked_special) == "a [SPECIAL_5]ing [SPECIAL_1]"
    assert _one(spark, "x tool_call {1} tool_call_end", E.call_payload) == "{1}"
    assert _one(spark, "{2}", E.call_payload) == "{2}"


def test_learning_rate(spark):
    lr = [r[0] for r in spark.range(6).select(E.learning_rate("id", 1.0, 2, 6)).collect()]
    assert lr == pytest.approx([0.0, 0.5, 1.0, 0.853553, 0.5, 0.146447], abs=1e-6)


def test_close(spark):
    rows = spark.createDataFrame([(1.0, 1.0000005), (1.0, 1.00001), (0.0, 1e-10), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(E.close("a", "b")).collect()] == [True, False, True, None]


SCHEMA = {"type": "object", "properties": {"a": {"type": "integer"}, "b": {"type": "array", "items": {"type": "string"}, "maxItems": 2}, "c": {"enum": ["x", "y"]}}, "required": ["a"], "additionalProperties": False}


@pytest.mark.parametrize(
    ("value", "n"),
    [({"a": 1}, 0), ({"a": True}, 1), ({"a": 1.0}, 1), ({}, 1), ({"a": 1, "z": 2}, 1), ({"a": 1, "b": ["p", 3]}, 1), ({"a": 1, "b": ["p", "q", "r"]}, 1), ({"a": 1, "c": "z"}, 1), ({"a": "1", "c": "z"}, 2), ([], 1), ({"a": 1, "b": None}, 1)],
)
def test_schema_errors(value, n):
    assert len(schema_errors(SCHEMA, value)) == n


def test_schema_errors_name_the_path():
    deep = {"type": "object", "properties": {"l": {"type": "array", "items": SCHEMA}}}
    assert schema_errors(deep, {"l": [{"a": 1}, {"a": "x"}]}) == ['$.l[1].a: not of type "integer"']
    assert schema_errors({"type": ["integer", "null"]}, None) == []
    assert schema_errors({"type": "unheard of"}, 1) == []
    assert schema_errors("no schema", 1) == []


def test_both_tool_formats():
    short = {"name": "f", "parameters": {"a": {"type": "int", "description": "A"}, "b": {"type": "List[str], optional", "default": ""}}}
    got = normalized_tool(short, Limits())["function"]["parameters"]
    assert got["required"] == ["a"] and got["properties"]["b"] == {"type": "array", "items": {"type": "string"}, "maxItems": 10}
    wrapped = {"type": "function", "function": {"name": "f", "parameters": {"type": "object", "properties": {"a": {"enum": ["x"]}, "l": {"type": "array", "items": {"type": "number"}, "maxItems": 99}}, "required": ["a", "gone"]}}}
    got = normalized_tool(wrapped, Limits())["function"]["parameters"]
    assert got["required"] == ["a"] and got["properties"]["a"] == {"type": "string", "enum": ["x"]} and got["properties"]["l"]["maxItems"] == 10


TOOL = [{"name": "f", "parameters": {"a": {"type": "int"}}}]
CALL = [{"name": "f", "arguments": {"a": 1}}]


@pytest.mark.parametrize(
    ("query", "answers", "tools", "why"),
    [
        ("q", CALL, TOOL, None), (None, CALL, TOOL, "no_query"), ("  ", CALL, TOOL, "no_query"), ("q" * 513, CALL, TOOL, "long_query"), ("q", CALL, [], "tool_count"), ("q", CALL, TOOL * 6, "tool_count"), ("q", CALL, TOOL * 2, "tool_names"),
        ("q", CALL * 2, TOOL, "call_count"), ("q", "prose", TOOL, "call_count"), ("q", [{"name": "f", "arguments": {"a": {"b": 1}}}], TOOL, "call_form"), ("q", [{"name": "g", "arguments": {}}], TOOL, "unknown_tool"),
        ("q", [{"name": "f", "arguments": {"a": "x"}}], TOOL, "call_schema"), ("q", CALL, [{"name": "f", "parameters": {"a": {"type": "dict"}}}], "tool_type"), ("q", CALL, [{"name": "f", "description": "d" * 3000, "parameters": {}}], "tool_size"),
    ],
)
def test_normalized_row(query, answers, tools, why):
    for form in (lambda x: x, json.dumps):
        got = normalized_row(query, form(answers), form(tools), frozenset(), Limits())
        assert got == why if why else not isinstance(got, str)
    if why is None:
        assert normalized_row(query, answers, tools, frozenset({"f"}), Limits()) == "excluded_tool"


def test_parsed_call():
    text = 'tool_call {"name": "f", "arguments": {"a": 1}} tool_call_end'
    assert parsed_call(text, TOOL)["schema_valid"]
    assert not parsed_call("no marker", TOOL)["attempted"]
    assert parsed_call("tool_call {", TOOL)["error"] == "invalid JSON"
    assert parsed_call('tool_call {"name": "g", "arguments": {}} tool_call_end', TOOL)["error"] == "unknown tool"
    assert not parsed_call(None, TOOL)["attempted"]


def test_flat_and_matched():
    assert is_flat({"a": [1, "x"], "b": True}) and not is_flat({"a": None}) and is_flat({"a": None}, nulls=True) and not is_flat({"a": [1] * 3}, most_items=2)
    assert matched_share({}, {}) == 1 and matched_share({}, {"a": 1}) == 0 and matched_share({"a": 1, "b": 2}, {"a": 1, "b": 3}) == 0.5


def test_bound_is_evaluated_once(spark):
    df = spark.range(3).select(E.bound(F.rand(1), lambda x: x - x).alias("zero"))
    assert {r["zero"] for r in df.collect()} == {0.0}


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', True), ("{}", True), ('{"a": 1}, {"b": 2}', False), ('{"a": 1} x', False), ("[1]", False), ("{", False), ("", False), (None, False), ('"a"', False)])
def test_one_json_object(spark, text, want):
    assert _one(spark, text, E.is_json_object) == want
