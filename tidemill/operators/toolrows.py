"""Tool rows and calls over DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tidemill.functions.expr import normalized_key, quoted, stripped
from tidemill.functions.toolcall import Limits, matched_share, normalized_row, parsed_call, schema_errors, tool_response
from tidemill.operators.chat import MESSAGES, TOOLS
from tidemill.operators.dedup import greedy_first_wins

_CALL = T.StructType([T.StructField(n, T.BooleanType() if n in ("attempted", "valid_json", "schema_valid") else T.StringType()) for n in ("attempted", "valid_json", "name", "arguments", "schema_valid", "error")])
_MATCH = T.StructType([T.StructField("exact", T.BooleanType()), T.StructField("partial", T.DoubleType())])


def normalize_tool_rows(rows: DataFrame, excluded: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """rows (row_no, query, answers, tools) with their normalised tools and call as JSON, or the reason to drop them.

    excluded (name) are held-out tool names: rows that use one are dropped by an anti-join on their tools' names.
    """
    limits = limits or Limits()

    @pandas_udf("tools_json string, call_json string, reason string")
    def normalized(query: pd.Series, answers: pd.Series, tools: pd.Series) -> pd.DataFrame:
        out = []
        for q, a, t in zip(query, answers, tools, strict=True):
            got = normalized_row(q, a, t, frozenset(), limits)
            out.append((None, None, got) if isinstance(got, str) else (json.dumps(got[0], ensure_ascii=False), json.dumps(got[1], ensure_ascii=False), None))
        return pd.DataFrame(out, columns=["tools_json", "call_json", "reason"])

    done = rows.withColumn("_n", normalized("query", "answers", "tools")).select(*rows.columns, "_n.*")
    if excluded is None:
        return done
    names = done.where("reason is null").select("row_no", F.explode(F.from_json("tools_json", "array<struct<function:struct<name:string>>>")).alias("t")).select("row_no", F.col("t.function.name").alias("name"))
    held = using_tools(names, excluded).select("row_no").distinct().withColumn("_held", F.lit(True))
    return done.join(held, "row_no", "left").withColumn("reason", F.when(F.col("_held"), "excluded_tool").otherwise(F.col("reason"))).drop("_held")


def using_tools(rows: DataFrame, names: DataFrame, name: str = "name", not_: bool = False) -> DataFrame:
    """Rows whose tool is among names (a column name), or those whose tool isn't; rows without a tool's name use none."""
    those = names.select(F.col("name").alias(name)).distinct()
    return rows.join(those, name, "left_anti" if not_ else "left_semi")


def accepted_tool_rows(rows: DataFrame, excluded: DataFrame | None = None, limits: Limits | None = None) -> DataFrame:
    """Rows that fit, without those whose id, hash or query one accepted before has."""
    fit = normalize_tool_rows(rows, excluded, limits).where("reason is null").withColumn("query_key", normalized_key("query")).withColumn("hash_key", F.nullif("hash_id", F.lit("")))
    return greedy_first_wins(fit, ["id", "hash_key", "query_key"], "row_no")


#: What opens a row with a call.
CALL_SYSTEM = "You are a helpful assistant that can use the given tools."


def _turn(role: str, content: Column | None = None, name: Column | None = None, arguments: Column | None = None) -> Column:
    """One message of a chat row; with arguments it is a call of the tool name."""
    null = F.lit(None).cast("string")
    call = F.array(F.struct(F.lit("function").alias("type"), F.struct(name.alias("name"), arguments.alias("arguments")).alias("function"))) if arguments is not None else F.lit(None)
    return F.struct(F.lit(role).alias("role"), (null if content is None else content).alias("content"), (null if name is None or arguments is not None else name).alias("name"), call.alias("tool_calls")).cast(MESSAGES[6:-1])


def chat_rows_of_calls(kept: DataFrame, source: str) -> DataFrame:
    """Accepted public rows as chat rows (row_no, source, tools, messages): system, user, and the assistant's call."""
    f = F.from_json("call_json", "name string, arguments string")
    turns = F.array(_turn("system", F.lit(CALL_SYSTEM)), _turn("user", stripped("query")), _turn("assistant", name=f["name"], arguments=f["arguments"]))
    return kept.select("row_no", F.lit(source).alias("source"), F.from_json("tools_json", TOOLS).alias("tools"), turns.alias("messages"))


@pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("user_prompt", "name", "arguments", "tool_result", "final_answer", "reason")]))
def _read_response(text: pd.Series, tool: pd.Series) -> pd.DataFrame:
    out = []
    for t, x in zip(text, tool, strict=True):
        got, why = tool_response(t, x)
        out.append((None,) * 5 + (why,) if got is None else (got["user_prompt"], got["function"]["name"], json.dumps(got["arguments"], ensure_ascii=False), got["tool_result"], got["final_answer"], None))
    return pd.DataFrame(out, columns=["user_prompt", "name", "arguments", "tool_result", "final_answer", "reason"])


def tool_response_rows(answered: DataFrame, text: Column, tool: str = "tool") -> DataFrame:
    """answered with tools, messages and reason: a response for a tool (its JSON) as system, user, call, result and answer turns, or
    why it is dropped. text is the response's JSON object, null if it has none."""
    read = answered.withColumn("_r", _read_response(text, F.col(tool)))
    r = F.col("_r")
    turns = F.array(_turn("system", F.lit(CALL_SYSTEM)), _turn("user", r["user_prompt"]), _turn("assistant", name=r["name"], arguments=r["arguments"]), _turn("tool", r["tool_result"], r["name"]), _turn("assistant", r["final_answer"]))
    fine = r["reason"].isNull()
    tools = F.array(F.from_json(tool, TOOLS[6:-1]))
    return read.select(*answered.columns, F.when(fine, tools).alias("tools"), F.when(fine, turns).alias("messages"), r["reason"].alias("reason"))


@pandas_udf(T.ArrayType(T.StringType()))
def validation_errors(schema: pd.Series, value: pd.Series) -> pd.Series:
    """Breaks of JSON schemas by JSON values; text that isn't JSON breaks with one error."""

    def errors(s: str | None, v: str | None) -> list[str]:
        try:
            return schema_errors(json.loads(s) if s else None, json.loads(v) if v is not None else None)
        except (ValueError, RecursionError):
            return ["$: not JSON"]

    return pd.Series([errors(s, v) for s, v in zip(schema, value, strict=True)])


@pandas_udf(_CALL)
def read_call(text: pd.Series, tools: pd.Series) -> pd.DataFrame:
    """Generated turns read as tool calls, against the row's tools as JSON."""
    out = [parsed_call(t, s) for t, s in zip(text, tools, strict=True)]
    for x in out:
        x["arguments"] = None if x["arguments"] is None else json.dumps(x["arguments"], ensure_ascii=False, sort_keys=True)
    return pd.DataFrame(out, columns=["attempted", "valid_json", "name", "arguments", "schema_valid", "error"])


@pandas_udf(_MATCH)
def argument_match(expected: pd.Series, actual: pd.Series) -> pd.DataFrame:
    """Whether two argument objects are equal, and the share of the expected ones that are right; null is no arguments."""

    def load(x: str | None) -> dict:
        try:
            v = json.loads(x) if x else {}
        except (ValueError, RecursionError):
            v = {}
        return v if isinstance(v, dict) else {}

    pairs = [(load(e), load(a)) for e, a in zip(expected, actual, strict=True)]
    return pd.DataFrame({"exact": [e == a for e, a in pairs], "partial": [matched_share(e, a) for e, a in pairs]})


def tools_as_json(tools: Column) -> Column:
    """A row's tools as the JSON the readers above take; parameters are JSON text already."""
    one = lambda t: F.concat(F.lit('{"function":{"name":'), quoted(t["function"]["name"]), F.lit(',"parameters":'), F.coalesce(t["function"]["parameters"], F.lit("null")), F.lit("}}"))
    return F.concat(F.lit("["), F.array_join(F.transform(tools, one), ","), F.lit("]"))


def tool_names(rows: DataFrame, tools: str = "tools") -> DataFrame:
    """Distinct names of the tools that rows declare."""
    return rows.select(F.explode(tools).alias("t")).select(F.col("t.function.name").alias("name")).where("name is not null").distinct()


def complete(prompts: DataFrame, client_factory, prompt: str = "prompt", at_once: int = 1) -> DataFrame:
    """prompts with the completion of a client made once per task: an object with complete(text) -> text. Failures give null.

    A task asks at_once prompts at the same time; the client must then stand being used by several threads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()

        def answer(text: str) -> str | None:
            try:
                return client.complete(text)
            except Exception:  # noqa: BLE001 - any failure of a client is a missing answer
                return None

        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                yield b.assign(response=list(pool.map(answer, b[prompt])))

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{schema}, response string")
