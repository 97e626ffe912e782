"""Chat rows: conversion, the rules they must meet, rendering, prompts and evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.expr import SPECIAL_TOKENS, call_json, cleaned_reasoning, compact_json, is_json_object, nonblank, quoted, stripped

MESSAGES = "array<struct<role:string,content:string,name:string,tool_calls:array<struct<type:string,function:struct<name:string,arguments:string>>>>>"
TOOLS = "array<struct<type:string,function:struct<name:string,description:string,parameters:string>>>"
TOOL_BLOCK = "Available tools:\n"


def _text(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def plain_chat(messages: Column) -> Column:
    """Messages with role and content alone if all roles are known, nothing is blank and the assistant speaks; else null."""
    known = F.forall(messages, lambda m: F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) & nonblank(m["content"]))
    speaks = F.exists(messages, lambda m: m["role"] == "assistant")
    opened = F.get(messages, F.lit(0))["role"].isin("system", "user")
    brief = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return F.when((F.size(messages) > 0) & known & F.coalesce(speaks, F.lit(False)) & opened, brief)


def math_chat(question: Column, answer: Column) -> Column:
    """A worked problem as user and assistant turn: the reasoning before the first ####, the final answer after it."""
    at = F.instr(answer, "####")
    final = stripped(F.substring(answer, at + F.lit(4), F.length(answer)))
    reasoning = cleaned_reasoning(F.substring(answer, F.lit(1), at - F.lit(1)))
    reply = F.concat(F.when(reasoning != "", F.concat(reasoning, F.lit("\n\n"))).otherwise(""), F.lit("Final answer: "), final)
    asked = stripped(question)
    return F.when((asked != "") & (at > 0) & (final != ""), F.array(_text("user", asked), _text("assistant", reply)))


def rule_breaks(messages: Column, tools: Column) -> Column:
    """Names of the schema rules a row breaks, sorted; none if it is valid.

    Null arrays count as empty; a null content of a user, system or tool message breaks a rule.
    """
    m, t = F.coalesce(messages, F.array().cast(MESSAGES)), F.coalesce(tools, F.array().cast(TOOLS))
    calls = lambda x: F.coalesce(F.size(x["tool_calls"]), F.lit(-1))
    call = lambda x: F.get(x["tool_calls"], F.lit(0))["function"]["name"]
    names = F.transform(t, lambda x: x["function"]["name"])
    before = F.slice(F.concat(F.array(F.lit(None).cast(MESSAGES[6:-1])), m), F.lit(1), F.size(m))
    follows = F.zip_with(m, before, lambda x, p: (x["role"] != "tool") | F.coalesce((p["role"] == "assistant") & (call(p) == x["name"]), F.lit(False)))
    any_ = lambda f: F.coalesce(F.exists(m, f), F.lit(False))
    speaks = lambda x: x["role"] == "assistant"
    rules = {
        "no_messages": F.size(m) == 0,
        "unknown_role": any_(lambda x: ~F.coalesce(x["role"].isin("system", "user", "assistant", "tool"), F.lit(False))),
        "first_role": F.coalesce(~F.get(m, F.lit(0))["role"].isin("system", "user"), F.size(m) > 0),
        "no_content": any_(lambda x: x["role"].isin("system", "user", "tool") & x["content"].isNull()),
        "empty_turn": any_(lambda x: speaks(x) & x["content"].isNull() & (calls(x) < 0)),
        "content_and_call": any_(lambda x: speaks(x) & x["content"].isNotNull() & (calls(x) >= 0)),
        "call_count": any_(lambda x: speaks(x) & (calls(x) >= 0) & (calls(x) != 1)),
        "tool_name": any_(lambda x: (x["role"] == "tool") & (F.coalesce(x["name"], F.lit("")) == "")),
        "tool_follows": ~F.forall(follows, lambda x: F.coalesce(x, F.lit(False))),
        "tool_names": F.size(F.array_distinct(names)) != F.size(names),
        "undeclared_call": any_(lambda x: speaks(x) & (calls(x) == 1) & ~F.coalesce(F.array_contains(names, call(x)), F.lit(False))),
    }
    return F.array_sort(F.filter(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules.items())), lambda x: x.isNotNull()))


def tool_text(tools: Column) -> Column:
    """What the system turn says of a row's tools."""
    one = lambda t: F.concat(F.lit('{"name":'), quoted(t["function"]["name"]), F.lit(',"description":'), quoted(t["function"]["description"]), F.lit(',"parameters":'), F.coalesce(t["function"]["parameters"], F.lit("null")), F.lit("}"))
    return F.concat(F.lit(TOOL_BLOCK + "["), F.array_join(F.transform(tools, one), ","), F.lit("]"))


def tool_block(tools: Column) -> Column:
    """The system turn that lists a row's tools; empty without tools. Parameters are JSON already and stay as they are; compacted does more."""
    return F.when(F.size(tools) > 0, F.concat(F.lit("im_start\nim_system\n"), tool_text(tools), F.lit("\nim_end\n"))).otherwise("")


def compacted(messages: Column, tools: Column) -> tuple[Column, Column]:
    """Messages and tools with arguments and parameters as compact JSON, which is how a trained model sees them."""
    call = lambda c: F.struct(c["type"].alias("type"), F.struct(c["function"]["name"].alias("name"), compact_json(c["function"]["arguments"]).alias("arguments")).alias("function"))
    turn = lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["name"].alias("name"), F.transform(m["tool_calls"], call).alias("tool_calls"))
    tool = lambda t: F.struct(t["type"].alias("type"), F.struct(t["function"]["name"].alias("name"), t["function"]["description"].alias("description"), compact_json(t["function"]["parameters"]).alias("parameters")).alias("function"))
    return F.transform(messages, turn), F.transform(tools, tool)


def rendered_message(m: Column) -> Column:
    """One message in the chat format."""
    body = (
        F.when(m["role"] == "system", F.concat(F.lit("im_system\n"), m["content"], F.lit("\n")))
        .when(m["role"] == "user", F.concat(F.lit("im_user\n"), m["content"], F.lit("\n")))
        .when(m["role"] == "tool", F.concat(F.lit("tool_response\n"), m["content"], F.lit("\ntool_response_end\n")))
        .when(m["content"].isNotNull(), F.concat(F.lit("im_assistant\n"), m["content"], F.lit("\n")))
        .otherwise(F.concat(F.lit("im_assistant\ntool_call\n"), call_json(m), F.lit("\ntool_call_end\n")))
    )
    return F.concat(F.lit("im_start\n"), F.coalesce(body, F.lit("")), F.lit("im_end\n"))


def rendered_text(messages: Column, tools: Column) -> Column:
    return F.concat(tool_block(tools), F.array_join(F.transform(messages, rendered_message), ""))


def prompt_text(messages: Column, tools: Column, turn: Column) -> Column:
    """What a model is given to complete the message at position turn (0-based)."""
    return F.concat(rendered_text(F.slice(messages, F.lit(1), turn), tools), F.lit("im_start\nim_assistant\n"))


def loss_spans(messages: Column) -> Column:
    """(message position, characters that bear loss): assistant content or call payload with their markers, without newlines."""
    own = F.filter(F.transform(messages, lambda m, i: F.struct(i.alias("pos"), m.alias("m"))), lambda x: x["m"]["role"] == "assistant")
    size = lambda m: F.when(m["content"].isNotNull(), F.length(m["content"]) + F.lit(len("im_end"))).otherwise(F.length(call_json(m)) + F.lit(len("tool_calltool_call_endim_end")))
    return F.transform(own, lambda x: F.struct(x["pos"].alias("pos"), size(x["m"]).alias("chars")))


def content_cases(rows: DataFrame, key: str, last: bool) -> DataFrame:
    """One case for each row with assistant content: its last or first one."""
    spoken = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("pos"), m["role"].alias("role"), m["content"].alias("content"))), lambda x: (x["role"] == "assistant") & x["content"].isNotNull())
    found = rows.select(key, F.try_element_at(spoken, F.lit(-1 if last else 1)).alias("case"))
    return found.where("case is not null").select(key, F.col("case.pos").alias("target_index"), F.col("case.content").alias("expected_content"))


def call_cases(rows: DataFrame, key: str) -> DataFrame:
    """One case for each row with a tool call: the first one."""
    calls = F.filter(F.transform("messages", lambda m, i: F.struct(i.alias("pos"), m["role"].alias("role"), m["tool_calls"].alias("calls"))), lambda x: (x["role"] == "assistant") & (F.size(x["calls"]) > 0))
    found = rows.select(key, F.get(calls, F.lit(0)).alias("case")).where("case is not null")
    f = F.get(F.col("case.calls"), F.lit(0))["function"]
    return found.select(key, F.col("case.pos").alias("target_index"), f["name"].alias("expected_tool"), f["arguments"].alias("expected_arguments"))


def parsed_response(text: Column) -> Column:
    """The JSON object of a model's response: without code fences, from the first brace to the last; null if there is none."""
    t = stripped(text)
    t = F.when(t.startswith("```"), stripped(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n?", ""), r"\n\s*```\s*$", ""))).otherwise(t)
    start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + F.lit(1)
    body = F.when((start > 0) & (F.instr(t, "}") > 0) & (end > start), F.substring(t, start, end - start + F.lit(1)))
    return F.when(is_json_object(body), body)


def normalized_answer(value: Column) -> Column:
    """A final answer as plain digits, commas removed; null if it isn't a number."""
    t = stripped(value)
    plain = r"^-?\d+(\.\d+)?$"
    bare = F.replace(t, F.lit(","), F.lit(""))
    return F.when(t.rlike(plain), t).when(bare.rlike(plain), bare)


def context_fits(ids: str, mask: str, context: int) -> Column:
    """Whether a rendered row has 2 to context tokens of which some bear loss."""
    return F.size(ids).between(2, context) & F.coalesce(F.exists(mask, lambda x: x == 1), F.lit(False))


def too_long(text: Column, most: int) -> Column:
    """Whether a text has more than so many characters; null for null."""
    return F.length(text) > most


RESERVED = "|".join(SPECIAL_TOKENS)


def safe_text(c: Column) -> Column:
    """Whether a text isn't blank and has no marker of the chat format in it."""
    return nonblank(c) & ~c.rlike(RESERVED)


def string_field(body: Column, name: str) -> Column:
    """A field of a JSON object if it is a string; null if it is missing or anything else."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.get_json_object(body, f"$.{name}"))


def final_answer(body: Column, name: str = "final_answer") -> Column:
    """A number field, or a string field that holds a plain number, as digits; null if it is neither. Whole floats lose their point."""
    value = F.try_variant_get(F.try_parse_json(body), f"$.{name}", "variant")
    kind, text = F.schema_of_variant(value), F.get_json_object(body, f"$.{name}")
    return F.when(kind == "STRING", normalized_answer(text)).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT)"), F.regexp_replace(text, r"\.0+$", ""))


def _turns(asked: Column, reply: Column, reason: Column) -> Column:
    return F.struct(F.when(reason.isNull(), F.array(_text("user", asked), _text("assistant", reply))).alias("messages"), reason.alias("reason"))


def response_row(text: Column, first: str, second: str, limits: tuple[int, int]) -> Column:
    """A response's two fields as user and assistant turn, or the reason why it is dropped."""
    body = parsed_response(text)
    a, b = string_field(body, first), string_field(body, second)
    reason = (
        F.when(body.isNull(), "invalid_json")
        .when(a.isNull() | b.isNull(), "missing_fields")
        .when(too_long(a, limits[0]), f"{first}_too_long")
        .when(too_long(b, limits[1]), f"{second}_too_long")
        .when(~safe_text(a) | ~safe_text(b), "reserved_token")
    )
    return _turns(a, b, reason)


def math_response(text: Column, limits: tuple[int, int] = (512, 2048)) -> Column:
    """A response with problem, solution and final_answer as user and assistant turn, or the reason why it is dropped.

    The reply ends with the final answer as a plain number. limits are characters of the problem and of the solution."""
    body = parsed_response(text)
    problem, solution, answer = string_field(body, "problem"), string_field(body, "solution"), final_answer(body)
    reason = (
        F.when(body.isNull(), "invalid_json")
        .when(problem.isNull() | solution.isNull(), "missing_fields")
        .when(answer.isNull(), "invalid_final_answer")
        .when(too_long(problem, limits[0]), "problem_too_long")
        .when(too_long(solution, limits[1]), "solution_too_long")
        .when(~safe_text(problem) | ~safe_text(solution), "reserved_token")
    )
    return _turns(problem, F.concat(solution, F.lit("\n\nFinal answer: "), answer), reason)
