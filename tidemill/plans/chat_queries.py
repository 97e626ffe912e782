"""Chat rows: conversion, rules, rendering, cases, tools and tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import tokenizer
from tidemill.operators import chat, generate, toolrows
from tidemill.runtime import written

CONTEXT = 512


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/sft_row.parquet").select("row_id", "source", "split", "messages", "tools")


def _fixture(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/sft_public_tool_fixture.parquet")


def _digest(c: Column) -> Column:
    return F.md5(c.cast("binary"))


def chat_convert(spark: SparkSession, sf: str) -> DataFrame:
    turns = _rows(spark, sf).select("row_id", chat.plain_chat(F.col("messages")).alias("m")).where("m is not null")
    return turns.select("row_id", F.size("m").cast("bigint").alias("turns"), F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["content"])).alias("chars"))


def math_convert(spark: SparkSession, sf: str) -> DataFrame:
    """Problems and worked answers, here cut out of the mathematics dialogues."""
    raw = _rows(spark, sf).where("source in ('gsm8k_math', 'gsm8k_eval')").select("row_id", F.get("messages", F.lit(0))["content"].alias("q"), F.replace(F.get("messages", F.lit(1))["content"], F.lit("Final answer:"), F.lit("####")).alias("a"))
    m = raw.select("row_id", chat.math_chat(F.col("q"), F.col("a")).alias("m")).where("m is not null")
    return m.select("row_id", F.get("m", F.lit(0))["content"].alias("question"), F.get("m", F.lit(1))["content"].alias("reply"))


def chat_schema_check(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).select("row_id", F.array_join(chat.rule_breaks(F.col("messages"), F.col("tools")), ",").alias("breaks"))


def _valid(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(spark, sf).where(F.size(chat.rule_breaks(F.col("messages"), F.col("tools"))) == 0)


def chat_render_text(spark: SparkSession, sf: str) -> DataFrame:
    text = chat.rendered_text(F.col("messages"), F.col("tools"))
    return _valid(spark, sf).select("row_id", text.alias("t")).select("row_id", F.length("t").cast("bigint").alias("chars"), _digest(F.col("t")).alias("digest"))


def chat_prompt(spark: SparkSession, sf: str) -> DataFrame:
    cases = chat.content_cases(_valid(spark, sf), "row_id", last=True)
    both = cases.join(_rows(spark, sf), "row_id").select("row_id", "target_index", chat.prompt_text(F.col("messages"), F.col("tools"), F.col("target_index")).alias("p"))
    return both.select("row_id", F.col("target_index").cast("bigint").alias("target_index"), _digest(F.col("p")).alias("digest"))


def chat_loss_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = _valid(spark, sf).select("row_id", chat.loss_spans(F.col("messages")).alias("s"))
    return spans.select("row_id", F.size("s").cast("bigint").alias("spans"), F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x["chars"]).alias("chars"))


def eval_cases_first_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = _rows(spark, sf)
    first = chat.content_cases(rows, "row_id", last=False).select("row_id", F.col("target_index").alias("first_index"))
    return chat.content_cases(rows, "row_id", last=True).join(first, "row_id").select("row_id", F.col("first_index").cast("bigint").alias("first_index"), F.col("target_index").cast("bigint").alias("last_index"), F.length("expected_content").cast("bigint").alias("chars"))


def eval_call_cases(spark: SparkSession, sf: str) -> DataFrame:
    return chat.call_cases(_rows(spark, sf), "row_id").select("row_id", F.col("target_index").cast("bigint").alias("target_index"), "expected_tool")


def context_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Rendered rows of 2 to CONTEXT tokens of which some bear loss."""
    r = spark.read.parquet(f"{sf}/rendered_sft.parquet")
    return r.where(chat.context_fits("token_ids", "loss_mask", CONTEXT)).select("row_id", F.size("token_ids").cast("bigint").alias("tokens"))


def pad_shift_mask(spark: SparkSession, sf: str) -> DataFrame:
    r = spark.read.parquet(f"{sf}/rendered_sft.parquet").where(F.size("token_ids").between(2, CONTEXT)).select("row_id", "token_ids", F.col("loss_mask").cast("array<int>").alias("loss_mask"))
    ids, target, mask = tokenizer.padded("token_ids", "loss_mask", CONTEXT)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return r.select("row_id", total(ids).alias("input_sum"), total(target).alias("target_sum"), total(mask).alias("mask_sum"), F.size(target).cast("bigint").alias("width"))


def tool_name_set(spark: SparkSession, sf: str) -> DataFrame:
    return toolrows.tool_names(_rows(spark, sf))


def excluded_tools_antijoin(spark: SparkSession, sf: str) -> DataFrame:
    """Fixture rows about none of the tools that evaluation rows declare."""
    held = toolrows.tool_names(_rows(spark, sf).where("split = 'test'"))
    return toolrows.using_tools(_fixture(spark, sf).where("func_name is not null"), held, "func_name", not_=True).select("row_no", "func_name")


def response_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Fenced responses read as JSON objects; here the first call of each fixture answer."""
    fenced = F.concat(F.lit("```json\nHere: "), F.regexp_replace("answers", r"^\[|\]$", ""), F.lit("\n```"))
    return _fixture(spark, sf).where("answers is not null").select("row_no", chat.parsed_response(fenced).isNotNull().alias("is_object"))


def answer_normalize(spark: SparkSession, sf: str) -> DataFrame:
    last = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_extract("text", r"(\S+)\s*$", 1).alias("tail"))
    return last.select("doc_id", chat.normalized_answer(F.regexp_replace("tail", r"\.$", "")).alias("answer"))


def tool_normalize(spark: SparkSession, sf: str) -> DataFrame:
    done = toolrows.normalize_tool_rows(_fixture(spark, sf).select("row_no", "id", "hash_id", "query", "answers", "tools"))
    return done.groupBy(F.coalesce("reason", F.lit("fits")).alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))


def tool_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """For every fixture row whether it fits, or the first reason why not."""
    done = toolrows.normalize_tool_rows(_fixture(spark, sf).select("row_no", "id", "hash_id", "query", "answers", "tools"))
    return done.select("row_no", F.coalesce("reason", F.lit("fits")).alias("outcome"))


def tool_accepted(spark: SparkSession, sf: str) -> DataFrame:
    rows = _fixture(spark, sf).select("row_no", "id", "hash_id", "query", "answers", "tools")
    return toolrows.accepted_tool_rows(rows, generate.held_out_names(spark)).select("row_no")


def json_schema_validate(spark: SparkSession, sf: str) -> DataFrame:
    calls = chat.call_cases(_rows(spark, sf), "row_id").join(_rows(spark, sf), "row_id")
    own = F.filter("tools", lambda t: t["function"]["name"] == F.col("expected_tool"))
    v = calls.select("row_id", toolrows.validation_errors(F.get(own, F.lit(0))["function"]["parameters"], F.col("expected_arguments")).alias("errors"))
    return v.select("row_id", F.size("errors").alias("n_errors"))


def tool_parse(spark: SparkSession, sf: str) -> DataFrame:
    calls = _generated(spark, sf)
    return calls.groupBy("attempted", "valid_json", "schema_valid").agg(F.count(F.lit(1)).alias("calls"))


def _generated(spark: SparkSession, sf: str) -> DataFrame:
    """Expected calls as a model might have written them: right, cut short, without marker, or to another tool."""
    calls = chat.call_cases(_rows(spark, sf), "row_id").join(_rows(spark, sf).select("row_id", toolrows.tools_as_json(F.col("tools")).alias("tools_json")), "row_id")
    body = F.concat(F.lit('{"name":"'), "expected_tool", F.lit('","arguments":'), F.coalesce("expected_arguments", F.lit("{}")), F.lit("}"))
    text = F.when(F.col("row_id") % 7 == 0, body).when(F.col("row_id") % 5 == 0, F.concat(F.lit("tool_call"), F.substring(body, 1, 20), F.lit("tool_call_end"))).otherwise(F.concat(F.lit("tool_call\n"), body, F.lit("\ntool_call_end")))
    return calls.withColumn("c", toolrows.read_call(text, F.col("tools_json"))).select("row_id", "expected_tool", "expected_arguments", "c.*")


def tool_set_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from tidemill.operators import metrics

    calls = _generated(spark, sf).withColumn("m", toolrows.argument_match(F.col("expected_arguments"), F.col("arguments")))
    found = metrics.tool_set_metrics(calls.select("valid_json", "schema_valid", F.coalesce(F.col("name") == F.col("expected_tool"), F.lit(False)).alias("selected"), "m.*"))
    return found.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes))


def tool_generate(spark: SparkSession, sf: str) -> DataFrame:
    rows = generate.training_rows(spark, 7, 0.02).unionByName(generate.evaluation_rows(spark, 7, 0.02))
    return rows.groupBy("kind", "family").agg(F.count(F.lit(1)).alias("rows"))


def tokenize_encode(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet")
    e = tokenizer.encoded(d, ["doc_id", "n_chars"], "text")
    return e.select("doc_id", F.size("token_ids").alias("tokens"), "offset_bytes")


def tokenizer_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").alias("text_bytes"), "text")
    e = tokenizer.encoded(d, ["doc_id", "text_bytes"], "text")
    return e.agg(F.count(F.lit(1)).alias("docs"), F.count_if(~F.col("round_trip")).alias("broken"), F.sum("text_bytes").cast("bigint").alias("text_bytes"))


def token_view(spark: SparkSession, sf: str) -> DataFrame:
    v = tokenizer.token_view(spark.read.parquet(f"{sf}/benchmark_item.parquet"), ["item_id"], "context")
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("tokens"), F.sum("bytes").alias("bytes"))


def token_view_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Per item how far its tokens reach and how many bytes they hold: all of the text."""
    v = tokenizer.token_view(spark.read.parquet(f"{sf}/benchmark_item.parquet"), ["item_id"], "context")
    return v.groupBy("item_id").agg(F.min("start").cast("bigint").alias("first"), F.max("stop").cast("bigint").alias("chars"), F.sum("bytes").alias("bytes"))


def chat_render_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of what the rendered token ids decode to, which is the rendered text, and whether ids and mask are as long."""
    rows = _valid(spark, sf).withColumn("tools_text", F.when(F.size("tools") > 0, chat.tool_text(F.col("tools"))))
    ids = tokenizer.rendered_ids(rows, "row_id", tokenizer.TOKENIZER)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = tokenizer.chat_tokenizer(tokenizer.TOKENIZER)
        for b in batches:
            yield pd.DataFrame({"row_id": b["row_id"], "t": [tokenizer.decoded(t, x.tolist()) for x in b["token_ids"]], "even": [len(x) == len(y) for x, y in zip(b["token_ids"], b["loss_mask"], strict=True)]})

    return ids.mapInPandas(read, "row_id bigint, t string, even boolean").select("row_id", _digest(F.col("t")).alias("digest"), "even")


def _responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses as a model might write them for mathematics: right, with a number in other forms, without a field, too long, not JSON."""
    k = F.col("doc_id") % 7
    text = F.regexp_replace("text", r"[^A-Za-z0-9 .,]", "")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    answer = F.when(k == 1, '"1,234"').when(k == 2, '"many"').when(k == 3, "12.0").otherwise(F.col("n_chars").cast("string"))
    body = F.concat(F.lit('{"problem": '), F.when(k == 4, F.lit("5")).otherwise(quoted(F.substring(text, 1, 520))), F.lit(', "solution": '), quoted(text), F.lit(', "final_answer": '), answer, F.when(k == 5, "").otherwise("}"))
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))


def response_math(spark: SparkSession, sf: str) -> DataFrame:
    r = _responses(spark, sf).select("doc_id", chat.math_response(F.col("response"), (519, 2048)).alias("o"))
    return r.select("doc_id", F.col("o.reason").alias("reason"), _digest(F.get("o.messages", F.lit(1))["content"]).alias("reply"))


def response_tool(spark: SparkSession, sf: str) -> DataFrame:
    """Responses for the tools of the rows that call one: fields in place, and in turn a nested argument, a result that isn't JSON, a missing field."""
    calls = chat.call_cases(_rows(spark, sf), "row_id").join(_rows(spark, sf), "row_id")
    own = F.get(F.filter("tools", lambda t: t["function"]["name"] == F.col("expected_tool")), F.lit(0))
    tool = F.concat(F.lit('{"type":"function","function":{"name":'), chat.quoted(own["function"]["name"]), F.lit(',"description":"","parameters":'), F.coalesce(own["function"]["parameters"], F.lit("{}")), F.lit("}}"))
    k = F.col("row_id") % 5
    body = F.concat(F.lit('{"user_prompt": "Do it.", "arguments": '), F.when(k == 1, '{"x": {"y": 1}}').otherwise(F.coalesce("expected_arguments", F.lit("null"))), F.lit(', "tool_result": '), F.when(k == 2, '"[broken"').otherwise('"{}"'), F.when(k == 3, "}").otherwise(', "final_answer": "Done."}'))
    read = toolrows.tool_response_rows(calls.select("row_id", tool.alias("tool"), body.alias("response")), chat.parsed_response(F.col("response")))
    return read.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason"), (F.col("reason").isNull() & (F.size(chat.rule_breaks(F.col("messages"), F.col("tools"))) > 0)).alias("breaks")).agg(F.count(F.lit(1)).alias("rows"))


def public_tool_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Accepted fixture rows as chat rows: turns, the called tool, and the rules they break, of which there are none."""
    kept = toolrows.accepted_tool_rows(_fixture(spark, sf), generate.held_out_names(spark))
    rows = toolrows.chat_rows_of_calls(kept, "tool_public")
    called = F.get(F.get("messages", F.lit(2))["tool_calls"], F.lit(0))["function"]["name"]
    return rows.select("row_no", F.size("messages").alias("turns"), called.alias("tool"), F.array_join(chat.rule_breaks(F.col("messages"), F.col("tools")), ",").alias("breaks"))


def argument_partial(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of right arguments: of three expected ones, a null one may be left out, and another is wrong in a third of the rows."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id")
    k = F.col("doc_id")
    actual = F.concat(F.lit('{"a":'), (k % 3).cast("string"), F.when(k % 2 == 0, ',"b":null').otherwise(""), F.when(k % 5 == 0, ',"c":"x"').otherwise(""), F.lit("}"))
    m = d.withColumn("m", toolrows.argument_match(F.lit('{"a":0,"b":null,"c":"x"}'), actual))
    return m.select("doc_id", F.col("m.exact").alias("exact"), F.round("m.partial", 6).alias("partial"))


def tool_generate_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows of each kind are generated, and how many of them are valid chat rows: all."""
    rows = generate.as_chat(generate.training_rows(spark, 7, 0.02).unionByName(generate.evaluation_rows(spark, 7, 0.02)))
    fine = F.size(chat.rule_breaks(F.col("messages"), F.col("tools"))) == 0
    called = F.exists("messages", lambda m: F.coalesce(F.size(m["tool_calls"]) == 1, F.lit(False)))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("rows"), F.count_if(fine).alias("valid"), F.count_if(called).alias("calls"))


def vocab_top(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.vocabulary(spark, most=20)


def span_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Per item the sums' first, last and number: one more than there are tokens, up to all characters."""
    s = tokenizer.span_sums(spark.read.parquet(f"{sf}/benchmark_item.parquet"), ["item_id"], "context")
    return s.select("item_id", F.get("sums", F.lit(0)).alias("first"), F.element_at("sums", -1).alias("last"), (F.size("sums") > 1).alias("several"))


def tokenizer_compression(spark: SparkSession, sf: str) -> DataFrame:
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "text")
    e = written(tokenizer.encoded(d, ["doc_id", "n_bytes"], "text"), "tokens")
    return tokenizer.compression(e, "n_bytes", tokenizer.load(tokenizer.TOKENIZER).get_vocab_size()).select("texts", "bytes", (F.col("bytes_a_token") > 1).alias("compresses"), (F.col("vocabulary_used") <= 1).alias("in_vocabulary"))


QUERIES = {f.__name__: f for f in (chat_convert, math_convert, chat_schema_check, chat_render_text, chat_prompt, chat_loss_spans, eval_cases_first_last, eval_call_cases, context_filter, pad_shift_mask, tool_name_set, excluded_tools_antijoin, response_parse, answer_normalize, tool_normalize, tool_accepted, json_schema_validate, tool_parse, tool_set_metrics, tool_generate, tokenize_encode, tokenizer_roundtrip, token_view, token_view_spans, chat_render_ids, response_math, response_tool, public_tool_rows, argument_partial, tool_generate_kinds, tool_outcomes, vocab_top, span_sums, tokenizer_compression)}

_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F\x0B]"
_NB = r"coalesce(regexp_matches({c}, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F\x0B]'), false)"
_STRIP = rf"regexp_replace({{c}}, '^{_WS}+|{_WS}+$', '', 'g')"
_CLEAN = r"""array_to_string(list_filter(list_transform(string_split_regex(regexp_replace({c}, '<<[^>]*>>', '', 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))"""
_HAS = lambda cond: f"coalesce(len(list_filter(m, lambda x: coalesce({cond}, false))), 0) > 0"
_N = "coalesce(len(x.tool_calls), -1)"
_CHECK = f"""b AS (SELECT row_id, messages, tools, coalesce(messages, []) AS m, list_transform(coalesce(tools, []), lambda t: t."function".name) AS names FROM sft_row),
  c AS (SELECT row_id, messages, tools, list_sort(list_filter([
    CASE WHEN len(m) = 0 THEN 'no_messages' END,
    CASE WHEN {_HAS("x.role IS NULL OR x.role NOT IN ('system', 'user', 'assistant', 'tool')")} THEN 'unknown_role' END,
    CASE WHEN len(m) > 0 AND coalesce(m[1].role NOT IN ('system', 'user'), true) THEN 'first_role' END,
    CASE WHEN {_HAS("x.role IN ('system', 'user', 'tool') AND x.content IS NULL")} THEN 'no_content' END,
    CASE WHEN {_HAS(f"x.role = 'assistant' AND x.content IS NULL AND {_N} < 0")} THEN 'empty_turn' END,
    CASE WHEN {_HAS(f"x.role = 'assistant' AND x.content IS NOT NULL AND {_N} >= 0")} THEN 'content_and_call' END,
    CASE WHEN {_HAS(f"x.role = 'assistant' AND {_N} >= 0 AND {_N} <> 1")} THEN 'call_count' END,
    CASE WHEN {_HAS("x.role = 'tool' AND coalesce(x.name, '') = ''")} THEN 'tool_name' END,
    CASE WHEN len(list_filter(range(1, len(m) + 1), lambda i: m[i].role = 'tool' AND NOT coalesce(i > 1 AND m[i - 1].role = 'assistant' AND m[i - 1].tool_calls[1]."function".name = m[i].name, false))) > 0 THEN 'tool_follows' END,
    CASE WHEN len(list_distinct(names)) + (len(list_filter(names, lambda n: n IS NULL)) > 0)::INT <> len(names) THEN 'tool_names' END,
    CASE WHEN {_HAS(f"x.role = 'assistant' AND {_N} = 1 AND NOT coalesce(list_contains(names, x.tool_calls[1].\"function\".name), false)")} THEN 'undeclared_call' END
  ], lambda r: r IS NOT NULL)) AS breaks FROM b)"""
_JSON_CALL = """'{"name":"' || x.tool_calls[1]."function".name || '","arguments":' || coalesce(x.tool_calls[1]."function".arguments, '{}') || '}'"""
_MSG = f"""('im_start' || chr(10) || coalesce(CASE x.role WHEN 'system' THEN 'im_system' || chr(10) || x.content || chr(10) WHEN 'user' THEN 'im_user' || chr(10) || x.content || chr(10)
  WHEN 'tool' THEN 'tool_response' || chr(10) || x.content || chr(10) || 'tool_response_end' || chr(10)
  ELSE CASE WHEN x.content IS NOT NULL THEN 'im_assistant' || chr(10) || x.content || chr(10) ELSE 'im_assistant' || chr(10) || 'tool_call' || chr(10) || {_JSON_CALL} || chr(10) || 'tool_call_end' || chr(10) END END, '') || 'im_end' || chr(10))"""
_TOOLS = """CASE WHEN len(tools) > 0 THEN 'im_start' || chr(10) || 'im_system' || chr(10) || 'Available tools:' || chr(10) || '[' || array_to_string(list_transform(tools, lambda t:
  '{"name":' || to_json(coalesce(t."function".name, ''))::VARCHAR || ',"description":' || to_json(coalesce(t."function".description, ''))::VARCHAR || ',"parameters":' || coalesce(t."function".parameters, 'null') || '}'), ',') || ']' || chr(10) || 'im_end' || chr(10) ELSE '' END"""
_TEXT = lambda messages: f"{_TOOLS} || array_to_string(list_transform({messages}, lambda x: {_MSG}), '')"
#: First calls of rows with their tool's schema; then pairs of schema and value, level by level, and the breaks of each: a wrong type ends a branch.
_IS = "CASE {t} WHEN 'string' THEN {k} = 'VARCHAR' WHEN 'integer' THEN {k} IN ('BIGINT', 'UBIGINT', 'HUGEINT') WHEN 'number' THEN {k} IN ('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE') WHEN 'boolean' THEN {k} = 'BOOLEAN' WHEN 'object' THEN {k} = 'OBJECT' WHEN 'array' THEN {k} = 'ARRAY' WHEN 'null' THEN {k} = 'NULL' ELSE true END"
_VALIDATED = f"""first AS (SELECT row_id, tools, messages[list_filter(range(1, len(messages) + 1), lambda i: messages[i].role = 'assistant' AND len(messages[i].tool_calls) > 0)[1]].tool_calls[1]."function" AS f FROM sft_row
    WHERE len(list_filter(messages, lambda x: x.role = 'assistant' AND len(x.tool_calls) > 0)) > 0),
  own AS (SELECT row_id, f.name AS name, f.arguments AS arguments, list_filter(tools, lambda t: t."function".name = f.name)[1] IS NOT NULL AS known, list_filter(tools, lambda t: t."function".name = f.name)[1]."function".parameters AS schema FROM first),
  texts AS (SELECT *, coalesce(nullif(schema, ''), 'null') AS s0, coalesce(arguments, 'NOTHING') AS v0 FROM own),
  level AS (
    SELECT row_id, s0::JSON AS s, v0::JSON AS v FROM texts WHERE json_valid(s0) AND json_valid(v0)
    UNION ALL
    SELECT row_id, CASE json_type(n.v) WHEN 'OBJECT' THEN n.s->'properties'->k.key ELSE n.s->'items' END AS s, coalesce(k.value, 'null'::JSON) AS v FROM level n, json_each(n.v) k
    WHERE json_type(n.s) = 'OBJECT' AND json_type(n.v) IN ('OBJECT', 'ARRAY')
      AND CASE WHEN json_type(n.s->'type') = 'VARCHAR' THEN {_IS.format(t="n.s->>'type'", k="json_type(n.v)")} WHEN json_type(n.s->'type') = 'ARRAY' THEN len(list_filter((n.s->'type')::VARCHAR[], lambda t: {_IS.format(t="t", k="json_type(n.v)")})) > 0 ELSE true END
      AND CASE json_type(n.v) WHEN 'OBJECT' THEN json_exists(n.s->'properties', '$."' || k.key || '"') ELSE json_exists(n.s, '$.items') END
  ),
  typed AS (SELECT row_id, s, v, CASE WHEN json_type(s->'type') = 'VARCHAR' THEN {_IS.format(t="s->>'type'", k="json_type(v)")} WHEN json_type(s->'type') = 'ARRAY' THEN len(list_filter((s->'type')::VARCHAR[], lambda t: {_IS.format(t="t", k="json_type(v)")})) > 0 ELSE true END AS right_type FROM level WHERE json_type(s) = 'OBJECT'),
  breaks AS (SELECT row_id, (NOT right_type)::INT + coalesce((json_type(s->'enum') = 'ARRAY' AND NOT list_contains((s->'enum')::JSON[]::VARCHAR[], v::VARCHAR))::INT, 0)
    + CASE WHEN right_type AND json_type(v) = 'OBJECT' THEN coalesce(len(list_filter(CASE WHEN json_type(s->'required') = 'ARRAY' THEN (s->'required')::VARCHAR[] ELSE [] END, lambda k: NOT list_contains(json_keys(v), k))), 0)
        + CASE WHEN (s->>'additionalProperties') = 'false' THEN len(list_filter(json_keys(v), lambda k: NOT list_contains(CASE WHEN json_type(s->'properties') = 'OBJECT' THEN json_keys(s->'properties') ELSE [] END, k))) ELSE 0 END
      WHEN right_type AND json_type(v) = 'ARRAY' AND json_type(s->'maxItems') IN ('BIGINT', 'UBIGINT') THEN (json_array_length(v) > (s->>'maxItems')::BIGINT)::INT ELSE 0 END AS n FROM typed),
  checked AS (SELECT t.row_id, t.name, t.arguments, t.known, coalesce(sum(coalesce(b.n, 0)), 0) + (NOT (json_valid(s0) AND json_valid(v0)))::INT AS n_errors FROM texts t LEFT JOIN breaks b USING (row_id) GROUP BY t.row_id, t.name, t.arguments, t.known, s0, v0)"""
#: What the calls are read as that _generated writes of them.
_PARSED = """parsed AS (SELECT row_id, attempted, attempted AND whole AS valid_json, attempted AND whole AND known AND n_errors = 0 AS schema_valid FROM (SELECT c.*, CASE WHEN row_id % 7 = 0 THEN '{"name":"' || name || '","arguments":' || coalesce(arguments, '{}') || '}' LIKE '%tool_call%' ELSE true END AS attempted,
    (row_id % 7 = 0 OR row_id % 5 <> 0) AND coalesce(json_valid(arguments) AND json_type(arguments) = 'OBJECT', arguments IS NULL) AS whole FROM checked c) x)"""
#: Tools of either format as flat parameters, and the first reason why a row doesn't fit, in the order in which the checks go. No tool here is near the limit of size.
_SHORT_KIND = "CASE regexp_extract(lower(coalesce(spec->>'type', 'str')), '^\\s*(?:list\\[)?(\\w+)\\]?\\s*(?:,.*)?$', 1) WHEN 'str' THEN 'string' WHEN 'string' THEN 'string' WHEN 'int' THEN 'integer' WHEN 'integer' THEN 'integer' WHEN 'float' THEN 'number' WHEN 'number' THEN 'number' WHEN 'bool' THEN 'boolean' WHEN 'boolean' THEN 'boolean' END"
_PRIMITIVE = "('string', 'integer', 'number', 'boolean')"
_FITTING = f"""raw AS (SELECT row_no, query, CASE WHEN json_valid(tools) AND json_type(tools) = 'ARRAY' THEN tools::JSON END AS tools, CASE WHEN json_valid(answers) AND json_type(answers) = 'ARRAY' THEN answers::JSON END AS answers FROM sft_public_tool_fixture),
  tool AS (SELECT row_no, k.id AS tool_no, k.value AS item, coalesce(k.value->>'type' = 'function' AND json_type(k.value->'function') = 'OBJECT', false) AS wrapped FROM raw, json_each(raw.tools) k),
  told AS (SELECT row_no, tool_no, wrapped, CASE WHEN wrapped THEN item->'function' ELSE item END AS spec FROM tool),
  given AS (SELECT row_no, tool_no, wrapped, spec->>'name' AS name, spec, CASE WHEN wrapped THEN coalesce(spec->'parameters', '{{}}'::JSON) ELSE spec->'parameters' END AS g FROM told),
  shaped AS (SELECT *, CASE WHEN json_type(spec) <> 'OBJECT' THEN 'tool' WHEN coalesce(json_type(spec->'name') <> 'VARCHAR' OR name = '' OR json_type(spec->'description') <> 'VARCHAR', json_type(spec->'name') IS NULL) THEN 'name' WHEN coalesce(json_type(g) <> 'OBJECT', true) THEN 'parameters' END AS why, CASE WHEN wrapped THEN coalesce(g->'properties', '{{}}'::JSON) ELSE g END AS properties FROM given),
  property AS (SELECT row_no, tool_no, wrapped, name AS tool, g, k.id AS no, k.key AS name, k.value AS spec FROM shaped, json_each(shaped.properties) k WHERE why IS NULL),
  kinds AS (SELECT *, CASE WHEN wrapped THEN coalesce(spec->>'type', CASE WHEN json_exists(spec, '$.enum') THEN 'string' END) WHEN regexp_matches(lower(spec->>'type'), '^\\s*list\\[') THEN 'array' ELSE {_SHORT_KIND} END AS kind,
    CASE WHEN wrapped THEN spec->'items'->>'type' ELSE {_SHORT_KIND} END AS element, CASE WHEN wrapped THEN spec->'enum' END AS choices FROM property),
  faults AS (SELECT *, CASE WHEN NOT wrapped THEN CASE WHEN element IS NULL THEN 'type' END WHEN json_type(spec) <> 'OBJECT' THEN 'property' WHEN kind = 'array' THEN CASE WHEN coalesce(json_type(spec->'items') <> 'OBJECT', true) THEN 'property' WHEN coalesce(element NOT IN {_PRIMITIVE}, true) THEN 'array' END
      WHEN coalesce(kind NOT IN {_PRIMITIVE}, true) THEN 'type' WHEN kind = 'string' AND (json_type(choices) <> 'ARRAY' OR json_array_length(choices) = 0) THEN 'enum' END AS why FROM kinds),
  unfit AS (SELECT row_no, arg_min(why, (tool_no, no)) AS why FROM (SELECT row_no, tool_no, -1 AS no, why FROM shaped UNION ALL SELECT row_no, tool_no, no, why FROM faults) f WHERE why IS NOT NULL GROUP BY row_no),
  names AS (SELECT row_no, count(*) AS n, count(DISTINCT name) AS different FROM shaped GROUP BY row_no),
  call AS (SELECT row_no, answers->0->>'name' AS name, answers->0->'arguments' AS arguments, json_type(answers->0->'name') = 'VARCHAR' AND json_type(answers->0->'arguments') = 'OBJECT' AS formed FROM raw WHERE json_array_length(answers) = 1 AND json_type(answers->0) = 'OBJECT'),
  argument AS (SELECT row_no, c.name AS tool, k.key AS name, k.value AS v FROM call c, json_each(c.arguments) k WHERE formed),
  nested AS (SELECT DISTINCT row_no FROM argument WHERE coalesce(json_type(v) IN ('OBJECT', 'NULL'), true) OR json_type(v) = 'ARRAY' AND len(list_filter((v)::JSON[], lambda x: coalesce(json_type(x) IN ('OBJECT', 'ARRAY', 'NULL'), true))) > 0),
  wrong AS (SELECT DISTINCT row_no FROM argument a LEFT JOIN faults f USING (row_no, tool, name) WHERE f.kind IS NULL
    OR CASE WHEN f.kind = 'array' THEN NOT (json_type(v) = 'ARRAY' AND json_array_length(v) <= least(10, coalesce((f.spec->>'maxItems')::INT, 10)) AND len(list_filter(v::JSON[], lambda x: NOT ({_IS.format(t="f.element", k="json_type(x)")}))) = 0)
      ELSE NOT ({_IS.format(t="f.kind", k="json_type(a.v)")}) OR f.kind = 'string' AND coalesce(NOT list_contains(choices::VARCHAR[], v->>'$'), false) END
    UNION SELECT c.row_no FROM call c JOIN faults f ON f.row_no = c.row_no AND f.tool = c.name WHERE c.formed AND NOT list_contains(json_keys(c.arguments), f.name) AND CASE WHEN f.wrapped THEN coalesce(list_contains((f.g->'required')::VARCHAR[], f.name), false) ELSE NOT json_exists(f.spec, '$.default') END),
  outcome AS (SELECT r.row_no, CASE WHEN coalesce(trim(query), '') = '' THEN 'no_query' WHEN length(trim(query)) > 512 THEN 'long_query' WHEN coalesce(json_array_length(r.tools), 0) NOT BETWEEN 1 AND 5 THEN 'tool_count' WHEN u.why IS NOT NULL THEN 'tool_' || u.why WHEN n.n <> n.different THEN 'tool_names'
      WHEN c.row_no IS NULL THEN 'call_count' WHEN coalesce(NOT c.formed, true) OR x.row_no IS NOT NULL THEN 'call_form' WHEN NOT EXISTS (SELECT 1 FROM shaped s WHERE s.row_no = r.row_no AND s.name = c.name) THEN 'unknown_tool' WHEN w.row_no IS NOT NULL THEN 'call_schema' ELSE 'fits' END AS outcome
    FROM raw r LEFT JOIN unfit u USING (row_no) LEFT JOIN names n USING (row_no) LEFT JOIN call c USING (row_no) LEFT JOIN nested x USING (row_no) LEFT JOIN wrong w USING (row_no))"""
_SPOKEN = "list_filter(range(1, len(messages) + 1), lambda i: messages[i].role = 'assistant' AND messages[i].content IS NOT NULL)"
ORACLES = {
    "chat_convert": f"""SELECT row_id, len(messages)::BIGINT AS turns, list_sum(list_transform(messages, lambda x: length(x.content)))::BIGINT AS chars FROM sft_row
        WHERE len(messages) > 0 AND len(list_filter(messages, lambda x: NOT (coalesce(x.role IN ('system', 'user', 'assistant'), false) AND {_NB.replace('{c}', 'x.content')}))) = 0
          AND len(list_filter(messages, lambda x: x.role = 'assistant')) > 0 AND messages[1].role IN ('system', 'user')""",
    "math_convert": f"""WITH r AS (SELECT row_id, messages[1].content AS q, replace(messages[2].content, 'Final answer:', '####') AS a FROM sft_row WHERE source IN ('gsm8k_math', 'gsm8k_eval')),
        p AS (SELECT row_id, {_STRIP.replace('{c}', 'q')} AS question, {_STRIP.replace('{c}', "substr(a, instr(a, '####') + 4)")} AS final, {_CLEAN.replace('{c}', "substr(a, 1, instr(a, '####') - 1)")} AS why FROM r WHERE instr(a, '####') > 0)
        SELECT row_id, question, CASE WHEN why <> '' THEN why || chr(10) || chr(10) ELSE '' END || 'Final answer: ' || final AS reply FROM p WHERE question <> '' AND final <> ''""",
    "chat_schema_check": f"WITH {_CHECK} SELECT row_id, array_to_string(breaks, ',') AS breaks FROM c",
    "chat_render_text": f"WITH {_CHECK}, t AS (SELECT row_id, {_TEXT('messages')} AS t FROM c WHERE len(breaks) = 0) SELECT row_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM t",
    "chat_prompt": f"WITH {_CHECK}, k AS (SELECT *, {_SPOKEN}[-1] - 1 AS target_index FROM c WHERE len(breaks) = 0) SELECT row_id, target_index, md5({_TEXT('messages[1:target_index]')} || 'im_start' || chr(10) || 'im_assistant' || chr(10)) AS digest FROM k WHERE target_index IS NOT NULL",
    "chat_loss_spans": f"WITH {_CHECK}, s AS (SELECT row_id, list_filter(messages, lambda x: x.role = 'assistant') AS a FROM c WHERE len(breaks) = 0) SELECT row_id, len(a)::BIGINT AS spans, coalesce(list_sum(list_transform(a, lambda x: CASE WHEN x.content IS NOT NULL THEN length(x.content) + 6 ELSE length({_JSON_CALL}) + 28 END)), 0)::BIGINT AS chars FROM s",
    "eval_cases_first_last": f"SELECT row_id, {_SPOKEN}[1] - 1 AS first_index, {_SPOKEN}[-1] - 1 AS last_index, length(messages[{_SPOKEN}[-1]].content)::BIGINT AS chars FROM sft_row WHERE len({_SPOKEN}) > 0",
    "eval_call_cases": "WITH k AS (SELECT *, list_filter(range(1, len(messages) + 1), lambda i: messages[i].role = 'assistant' AND len(messages[i].tool_calls) > 0)[1] AS i FROM sft_row) SELECT row_id, i - 1 AS target_index, messages[i].tool_calls[1].\"function\".name AS expected_tool FROM k WHERE i IS NOT NULL",
    "context_filter": f"SELECT row_id, len(token_ids)::BIGINT AS tokens FROM rendered_sft WHERE len(token_ids) BETWEEN 2 AND {CONTEXT} AND list_contains(loss_mask, 1)",
    "pad_shift_mask": f"SELECT row_id, list_sum(token_ids)::BIGINT AS input_sum, (list_sum(token_ids) - token_ids[1])::BIGINT AS target_sum, coalesce(list_sum(loss_mask[2:]), 0)::BIGINT AS mask_sum, {CONTEXT}::BIGINT AS width FROM rendered_sft WHERE len(token_ids) BETWEEN 2 AND {CONTEXT}",
    "tool_name_set": "SELECT DISTINCT name FROM (SELECT unnest(list_transform(tools, lambda t: t.\"function\".name)) AS name FROM sft_row) WHERE name IS NOT NULL",
    "excluded_tools_antijoin": "SELECT row_no, func_name FROM sft_public_tool_fixture WHERE func_name IS NOT NULL AND func_name NOT IN (SELECT name FROM (SELECT unnest(list_transform(tools, lambda t: t.\"function\".name)) AS name FROM sft_row WHERE split = 'test') WHERE name IS NOT NULL)",
    "response_parse": r"""WITH b AS (SELECT row_no, regexp_replace(answers, '^\[|\]$', '', 'g') AS t FROM sft_public_tool_fixture WHERE answers IS NOT NULL), c AS (SELECT row_no, CASE WHEN instr(t, '{') > 0 AND instr(t, '}') > 0 THEN substr(t, instr(t, '{'), length(t) - instr(reverse(t), '}') + 2 - instr(t, '{')) END AS j FROM b)
        SELECT row_no, coalesce(json_valid(j) AND j <> '', false) AS is_object FROM c""",
    "answer_normalize": rf"WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_extract(text, '(\S+)\s*$', 1), '\.$', ''), '^{_WS}+|{_WS}+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN regexp_full_match(t, '-?[0-9]+(\.[0-9]+)?') THEN t WHEN regexp_full_match(replace(t, ',', ''), '-?[0-9]+(\.[0-9]+)?') THEN replace(t, ',', '') END AS answer FROM t",
    "tool_normalize": f"WITH {_FITTING} SELECT outcome, count(*) AS rows FROM outcome GROUP BY outcome",
    "tool_outcomes": f"WITH {_FITTING} SELECT row_no, outcome FROM outcome",
    "response_tool": f"""WITH RECURSIVE {_VALIDATED.replace('NOTHING', 'null')}, r AS (SELECT *, row_id % 5 AS k, coalesce(json_type(CASE WHEN json_valid(arguments) THEN arguments END) = 'OBJECT', false) AS whole FROM checked),
        deep AS (SELECT DISTINCT row_id FROM r, json_each(CASE WHEN whole THEN arguments ELSE '{{}}' END) k WHERE json_type(k.value) = 'OBJECT' OR json_type(k.value) = 'ARRAY' AND (json_array_length(k.value) > 10 OR len(list_filter(k.value::JSON[], lambda x: json_type(x) IN ('OBJECT', 'ARRAY'))) > 0))
        SELECT coalesce(CASE WHEN k <> 1 AND arguments IS NOT NULL AND NOT json_valid(arguments) THEN 'invalid_json' WHEN k = 3 OR k <> 1 AND NOT whole THEN 'missing_fields' WHEN k = 1 OR d.row_id IS NOT NULL THEN 'non_flat_arguments' WHEN n_errors > 0 THEN 'schema_invalid_arguments' WHEN k = 2 THEN 'invalid_tool_result_json' END, 'ok') AS reason,
          false AS breaks, count(*) AS rows FROM r LEFT JOIN deep d USING (row_id) GROUP BY ALL""",
    "json_schema_validate": f"WITH RECURSIVE {_VALIDATED.replace('NOTHING', 'null')} SELECT row_id, n_errors::INT AS n_errors FROM checked",
    "tool_parse": f"WITH RECURSIVE {_VALIDATED.replace('NOTHING', '{}')}, {_PARSED} SELECT attempted, valid_json, schema_valid, count(*) AS calls FROM parsed GROUP BY ALL",
    "tool_set_metrics": f"""WITH RECURSIVE {_VALIDATED.replace('NOTHING', '{}')}, {_PARSED} SELECT count(*) AS rows, round(avg(valid_json::INT), 6) AS valid_json_rate, round(avg(schema_valid::INT), 6) AS schema_valid_rate, round(avg(valid_json::INT), 6) AS tool_selection_rate,
        round(avg(valid_json::INT), 6) AS argument_exact_rate, round(avg(valid_json::INT), 6) AS argument_partial_accuracy FROM parsed""",
    "tool_generate_kinds": "SELECT kind, rows, rows AS valid, CASE WHEN kind IN ('no_tool', 'no_call', 'missing_info') THEN 0 ELSE rows END::BIGINT AS calls FROM (VALUES " + ", ".join(f"('{k}', {n}::BIGINT)" for k, n in {**{k: round(n * 0.02) for k, n in generate.TRAIN_KINDS.items()}, **{k: round(n * 0.02) for k, n in generate.EVAL_KINDS.items()}, "missing_info": round(generate.TRAIN_KINDS["missing_info"] * 0.02) + round(generate.EVAL_KINDS["missing_info"] * 0.02)}.items()) + ") t(kind, rows)",
    "span_sums": "SELECT item_id, 0::BIGINT AS first, length(context)::BIGINT AS last, true AS several FROM benchmark_item",
    "tokenizer_compression": "SELECT count(*) AS texts, sum(strlen(text))::BIGINT AS bytes, true AS compresses, true AS in_vocabulary FROM documents",
    "chat_render_ids": f"WITH {_CHECK}, t AS (SELECT row_id, {_TEXT('messages')} AS t FROM c WHERE len(breaks) = 0) SELECT row_id, md5(t) AS digest, true AS even FROM t",
    "token_view_spans": "SELECT item_id, 0::BIGINT AS first, length(context)::BIGINT AS chars, strlen(context)::BIGINT AS bytes FROM benchmark_item WHERE context <> ''",
    "argument_partial": """SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AND doc_id % 5 = 0 AS exact, round(((doc_id % 3 = 0)::INT + 1 + (doc_id % 5 = 0)::INT) / 3.0::DOUBLE, 6) AS partial FROM documents""",
    "response_math": rf"""WITH t AS (SELECT doc_id, n_chars, doc_id % 7 AS k, regexp_replace(text, '[^A-Za-z0-9 .,]', '', 'g') AS t FROM documents),
        r AS (SELECT *, CASE k WHEN 1 THEN '1234' WHEN 2 THEN NULL WHEN 3 THEN '12' ELSE n_chars::VARCHAR END AS answer, CASE WHEN k = 5 THEN 'invalid_json' WHEN k = 4 THEN 'missing_fields' WHEN k = 2 THEN 'invalid_final_answer'
          WHEN length(t) > 519 THEN 'problem_too_long' WHEN length(t) > 2048 THEN 'solution_too_long' WHEN trim(t, ' ') = '' OR regexp_matches(t, 'im_start|im_end|im_system|im_user|im_assistant|tool_call|tool_response') THEN 'reserved_token' END AS reason FROM t)
        SELECT doc_id, reason, CASE WHEN reason IS NULL THEN md5(t || chr(10) || chr(10) || 'Final answer: ' || answer) END AS reply FROM r""",
    "tokenizer_roundtrip": "SELECT count(*) AS docs, 0::BIGINT AS broken, sum(strlen(text))::BIGINT AS text_bytes FROM documents",
}
