"""Converters, bundles, growing logs, deep records, hashes and files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemill import config as C
from tidemill import runtime
from tidemill.functions import expr as E
from tidemill.functions import tokenizer
from tidemill.functions.toolcall import Limits, Unfit, matched_share, normalized_row, normalized_tool, tool_response
from tidemill.operators import chat, dedup, generate, nested, runlog, toolrows
from tidemill.plans import pipelines
from tidemill.sources import files, sinks
from tidemill.streaming import runlog_stream


@pytest.mark.parametrize(("word", "kind"), [("str", "string"), ("string", "string"), ("INT", "integer"), ("integer, optional", "integer"), ("number", "number"), ("float", "number"), ("boolean", "boolean"), ("bool", "boolean")])
def test_both_spellings_of_types(word, kind):
    properties = normalized_tool({"name": "f", "parameters": {"a": {"type": word}, "b": {"type": f"List[{word.split(',')[0]}]"}}}, Limits())["function"]["parameters"]["properties"]
    assert properties == {"a": {"type": kind}, "b": {"type": "array", "items": {"type": kind}, "maxItems": 10}}
    assert not isinstance(normalized_row("q", [{"name": "f", "arguments": {}}], [{"name": "f", "parameters": {"a": {"type": word, "default": 1}}}], frozenset(), Limits()), str)


@pytest.mark.parametrize(
    ("spec", "why"),
    [({"type": "object"}, "type"), ({"type": ["string", "null"]}, "type"), ({}, "type"), ({"enum": []}, "enum"), ({"enum": [1]}, "enum"), ({"type": "array"}, "property"), ({"type": "array", "items": {"type": "array", "items": {"type": "string"}}}, "array"), ({"type": "array", "items": {"type": "string"}, "maxItems": True}, "array"), ("x", "property")],
)
def test_schemas_that_do_not_fit(spec, why):
    with pytest.raises(Unfit, match=f"^{why}$"):
        normalized_tool({"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": spec}}}}, Limits())


def test_items_keep_their_choices():
    got = normalized_tool({"type": "function", "function": {"name": "f", "parameters": {"properties": {"a": {"type": "array", "items": {"enum": ["x", "y"], "description": "d"}, "maxItems": 3}}}}}, Limits())
    assert got["function"]["parameters"]["properties"]["a"] == {"type": "array", "items": {"type": "string", "enum": ["x", "y"], "description": "d"}, "maxItems": 3}


def test_an_expected_null_may_be_left_out():
    assert matched_share({"a": None}, {}) == 1 and matched_share({"a": None, "b": 1}, {"a": 2}) == 0


TOOL = json.dumps({"type": "function", "function": {"name": "f", "description": "", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"]}}})
FINE = {"user_prompt": "Do.", "arguments": {"a": 1}, "tool_result": "{}", "final_answer": "Done."}


@pytest.mark.parametrize(
    ("change", "why"),
    [
        ({}, None), ({"user_prompt": 1}, "missing_fields"), ({"arguments": "{}"}, "missing_fields"), ({"user_prompt": "x" * 513}, "prompt_too_long"), ({"tool_result": "x" * 1025}, "tool_result_too_long"), ({"final_answer": "x" * 1025}, "final_answer_too_long"),
        ({"user_prompt": " "}, "reserved_token"), ({"final_answer": "im_end"}, "reserved_token"), ({"arguments": {"a": {"b": 1}}}, "non_flat_arguments"), ({"arguments": {"a": "x"}}, "schema_invalid_arguments"), ({"tool_result": "{"}, "invalid_tool_result_json"),
    ],
)
def test_tool_responses(change, why):
    got, reason = tool_response(json.dumps(FINE | change), TOOL)
    assert reason == why and (got is None) == (why is not None)
    assert tool_response(None, TOOL)[1] == tool_response("{", TOOL)[1] == "invalid_json"


def test_math_responses(spark):
    rows = {
        '{"problem": "p", "solution": "s", "final_answer": 3}': None, '{"problem": "p", "solution": "s", "final_answer": 2.50}': None, '{"problem": "p", "solution": "s", "final_answer": "1,000"}': None, '{"problem": "p", "solution": "s", "final_answer": true}': "invalid_final_answer",
        '{"problem": 1, "solution": "s", "final_answer": 3}': "missing_fields", '{"problem": "p"}': "missing_fields", "no": "invalid_json", '{"problem": "ppppppppppppp", "solution": "s", "final_answer": 3}': "problem_too_long", '{"problem": " ", "solution": "s", "final_answer": 3}': "reserved_token",
    }
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", chat.math_response(F.col("t"), (10, 10)).alias("o"))
    got = {r["t"]: r["o"] for r in df.collect()}
    assert {t: o["reason"] for t, o in got.items()} == rows
    assert [o["messages"][1]["content"] for o in got.values() if o["messages"]] == ["s\n\nFinal answer: 3", "s\n\nFinal answer: 2.5", "s\n\nFinal answer: 1000"]


def test_generated_rows_are_valid_chat_rows(spark):
    rows = generate.as_chat(generate.training_rows(spark, 3, 0.01).unionByName(generate.evaluation_rows(spark, 3, 0.05)))
    broken = rows.where(F.size(chat.rule_breaks(F.col("messages"), F.col("tools"))) > 0)
    assert broken.count() == 0
    families = {r["family"] for r in rows.select("family").distinct().collect()}
    assert families == set(generate.SEEN) | set(generate.UNSEEN)


def test_conversions_are_exact():
    assert generate.converted(100, "heat", "celsius", "fahrenheit") == 212 and generate.converted(32, "heat", "fahrenheit", "celsius") == 0 and generate.converted(2, "distance", "kilometre", "metre") == 2000
    assert generate.exact(generate.SUMS["over"][1](1, 3)) == 0.333333


class Writer:
    """Writes what it is asked for, in the form asked for."""

    def complete(self, prompt):
        n = prompt.rsplit(" ", 1)[1]
        if "user_prompt" in prompt:
            schema = json.loads(next(line for line in prompt.splitlines() if line.startswith("{")))["function"]["parameters"]
            fill = {"string": lambda s: s.get("enum", ["x"])[0], "integer": lambda s: 1, "array": lambda s: []}
            return json.dumps({"user_prompt": f"Do {n}.", "arguments": {k: fill[s["type"]](s) for k, s in schema["properties"].items()}, "tool_result": "{}", "final_answer": "Done."})
        if "problem" in prompt and "solution" in prompt:
            return json.dumps({"problem": f"P{n}?", "solution": "S.", "final_answer": 4})
        return json.dumps({"prompt": f"Ask {n}", "response": "Say."})


def test_bundles(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/sft_row.parquet")
    assistant = rows.select(F.col("row_id").alias("pos"), "messages")
    math = spark.createDataFrame([(i, f"q{i}", f"w #### {i}") for i in range(9)], "pos bigint, question string, answer string")
    fixture = spark.read.parquet(f"{sf}/sft_public_tool_fixture.parquet")
    config = C.from_dict(C.BundleConfig, {"output_dir": str(tmp_path / "train"), "assistant_rows": 20, "math_rows": 5, "tool_rows": 6, "scale": 0.004, "written_rows": {"assistant": 2, "math": 2, "tool": 3}})
    made = pipelines.prepare_all(spark, config, assistant, math, fixture, Writer)
    assert {k: made[k]["written_rows"] for k in ("assistant", "gsm8k", "tool_public", "internal_assistant", "internal_math", "internal_tool")} == {"assistant": 20, "gsm8k": 5, "tool_public": 6, "internal_assistant": 2, "internal_math": 2, "internal_tool": 3}
    assert sinks.read_json(f"{tmp_path}/train/manifest.json") == made
    schema = f"source string, tools {chat.TOOLS}, messages {chat.MESSAGES}"
    for source in made:
        read = files.chat_rows(spark, f"{tmp_path}/train/{source}", schema)
        assert read.count() == made[source]["written_rows"]
        assert read.where(F.size(chat.rule_breaks(F.col("messages"), F.col("tools"))) > 0).count() == 0
    held = pipelines.prepare_eval(spark, C.from_dict(C.BundleConfig, {"output_dir": str(tmp_path / "eval"), "assistant_rows": 4, "math_rows": 3, "scale": 0.01}), assistant, math)
    assert set(held) == {"assistant_eval", "gsm8k_eval", *(f"tool_eval_{k}" for k in generate.EVAL_KINDS)} and held["tool_eval_seen"]["written_rows"] == 5
    with pytest.raises(C.ConfigError, match="unknown categories"):
        C.from_dict(C.BundleConfig, {"output_dir": "x", "written_rows": {"poem": 1}})


def test_a_mixture_takes_equal_lines_once_each(spark, tmp_path):
    (tmp_path / "in" / "a").mkdir(parents=True)
    (tmp_path / "in" / "a" / "part.txt").write_text("same\nsame\nother\nsame\n\n")
    m = pipelines.build_mixture(spark, C.from_dict(C.MixtureConfig, {"input_dir": str(tmp_path / "in"), "output_dir": str(tmp_path / "out"), "recipe": {"a": 4}}))
    assert m["total_rows"] == 4
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out" / "mixture")).collect()) == ["other", "same", "same", "same"]


def test_training_batches_and_checkpoint_evaluation(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/sft_row.parquet").where(F.size(chat.rule_breaks(F.col("messages"), F.col("tools"))) == 0).limit(40)
    got = pipelines.sft_training_batches(rows, "row_id", tokenizer.TOKENIZER, C.BatchConfig(512, 4), epochs=2).collect()
    assert got and len(got) % 8 == 0 and all(len(r["input"]) == len(r["target"]) == len(r["mask"]) == 512 and sum(r["mask"]) for r in got)
    scored = spark.createDataFrame([("c", "web", 4.0, 2, 1), ("c", "code", 2.0, 2, 1)], "checkpoint string, domain string, loss_sum double, tokens bigint, batches bigint")
    card = pipelines.checkpoint_evaluation(spark.createDataFrame([("c",), ("d",)], "checkpoint string"), scored, str(tmp_path / "c.json"))
    assert card["d"] == {"status": "missing"} and card["c"]["mixed"]["loss"] == 1.5 and card["c"]["domains"]["web"]["loss"] == 2.0
    assert sinks.read_json(str(tmp_path / "c.json")) == card


def _tail(spark, tmp_path):
    read = runlog_stream.log_lines(spark, str(tmp_path / "runs")).withColumn("run", F.regexp_extract("run", r"([^/]+)/run\.jsonl$", 1))
    out = runlog_stream.run_available(runlog.parsed_lines(read), "t", f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    return sorted((r["run"], r["step"], r["train_loss"]) for r in out.collect())


def test_a_growing_log_is_tailed_and_read_again_when_it_shrank(spark, tmp_path):
    log = tmp_path / "runs" / "a" / "run.jsonl"
    log.parent.mkdir(parents=True)
    point = lambda step, loss: json.dumps({"step": step, "train_loss": loss}) + "\n"
    log.write_text("".join(point(1, float(i)) for i in range(150)) + '{"step": 2, "tr')
    assert _tail(spark, tmp_path) == [("a", 1, 149.0)]
    with log.open("a") as f:
        f.write('ain_loss": 7.0}\nnonsense\n' + point(1, 3.0))
    assert _tail(spark, tmp_path) == [("a", 1, 3.0), ("a", 2, 7.0)]
    assert _tail(spark, tmp_path) == [("a", 1, 3.0), ("a", 2, 7.0)]
    log.write_text(point(5, 1.0))
    (tmp_path / "runs" / "b").mkdir()
    (tmp_path / "runs" / "b" / "run.jsonl").write_text(point(1, 2.0))
    assert _tail(spark, tmp_path) == [("a", 5, 1.0), ("b", 1, 2.0)]


def test_records_nested_as_deep_as_the_parser_goes(spark):
    deep = '{"a":' * 3000 + "1" + "}" * 3000
    schema = '{"properties":{"a":' * 400 + "{}" + "}}" * 400
    rows = [(1, [("assistant", None, None, [("function", ("f", deep))])], [("function", ("f", "", schema))])]
    df = spark.createDataFrame(rows, f"row_id bigint, messages {chat.MESSAGES.replace(':', ' ')}, tools {chat.TOOLS.replace(':', ' ')}")
    kinds = {r["kind"]: r["n"] for r in nested.nested_nodes(df).groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds["property"] == 400 and kinds.get("argument", 0) in (0, 3000)


def test_typed_node_tables_of_repeated_ids(spark):
    row = (1, [("user", "hi", "n", None), ("assistant", None, None, [("function", ("f", '{"a":[1,2],"b":{"c":"x"}}'))])], [("function", ("f", "d", '{"properties":{"p":{"type":"string","description":"e"}},"required":["p"]}'))])
    df = spark.createDataFrame([row, row], f"row_id bigint, messages {chat.MESSAGES.replace(':', ' ')}, tools {chat.TOOLS.replace(':', ' ')}").repartition(2)
    tables = nested.node_tables(runtime.written(nested.nested_nodes(df), "nodes"))
    one = {k: [r.asDict() for r in t.collect()] for k, t in tables.items()}
    assert [len(one[k]) for k in nested.KINDS] == [4, 2, 6, 2, 2]
    assert {(m["role"], m["name"], m["value"]) for m in one["message"]} == {("user", "n", "hi"), ("assistant", None, None)}
    assert {(p["name"], p["type"], p["description"], p["required"]) for p in one["property"]} == {("p", "string", "e", True)}
    assert {(t["name"], t["description"]) for t in one["tool"]} == {("f", "d")}
    nodes = nested.nested_nodes(df)
    assert {r["n_below"] for r in nested.subtree_sizes(runtime.written(nodes, "nodes")).collect()} == {0, 4, 1}


def test_hashes(spark, tmp_path):
    df = spark.range(2500).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    level = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2500)]
    for _ in range(sinks.LEVELS):
        level = [hashlib.sha256("".join(level[i : i + sinks.FAN_IN]).encode()).hexdigest() for i in range(0, len(level), sinks.FAN_IN)]
    assert sinks.content_hash(df, "v", "k").first()[0] == level[0]
    (tmp_path / "x").write_text("abc")
    assert [(r["name"], r["n_bytes"], r["sha256"]) for r in sinks.file_hashes(spark, str(tmp_path)).collect()] == [("x", 3, hashlib.sha256(b"abc").hexdigest())]
    assert runtime.total_bytes(spark, str(tmp_path)) == 3


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "none"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Fake())


def test_written_tables_can_be_forgotten(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    runtime._WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    spark.range(3).write.parquet(path)
    others = runtime._WRITTEN[spark.sparkContext.applicationId][:-1]
    runtime._WRITTEN[spark.sparkContext.applicationId] = [path]
    assert runtime.forget(spark) == 1 and not runtime.exists(spark, path)
    runtime._WRITTEN[spark.sparkContext.applicationId] = others


def test_domains_of_many_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n')
    (tmp_path / "b c.jsonl").write_text('{"text": "two"}\n{"text": "three"}\n')
    assert sorted(map(tuple, files.corpus_documents(spark, str(tmp_path)).collect())) == [("a", "one"), ("b c", "three"), ("b c", "two")]


def test_a_broken_benchmark_line_is_an_error(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(Exception, match="(?i)malformed|failfast|parse"):
        files.benchmark_rows(spark, str(tmp_path)).collect()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 102), (102, 100), (7, 7), (200, 201)]
    got = {r["node"]: r["root"] for r in dedup.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert dedup.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_compact_json(spark):
    rows = {'{"a": [1, 2],\n "b c": "x  y"}': '{"a":[1,2],"b c":"x  y"}', '{"q": "say \\" : \\\\", "r" : 1}': '{"q":"say \\" : \\\\","r":1}', "{}": "{}", None: None}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", E.compact_json(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in df.collect()} == rows


def test_tool_prompts_carry_their_schema(spark):
    rows = generate.prompts(spark, "tool", 12, 1).collect()
    assert len({r["tool"] for r in rows}) == 8 and all(r["tool"] in r["prompt"] and "user_prompt" in r["prompt"] for r in rows)
    assert all(r["tool"] is None for r in generate.prompts(spark, "math", 3).collect())


def test_public_rows_as_chat_rows(spark):
    rows = [(1, 1, "h", " Do it ", '[{"name": "f", "arguments": {"a": 1}}]', '[{"name": "f", "description": "d", "parameters": {"a": {"type": "int"}}}]')]
    kept = toolrows.accepted_tool_rows(spark.createDataFrame(rows, "row_no bigint, id bigint, hash_id string, query string, answers string, tools string"))
    row = toolrows.chat_rows_of_calls(kept, "s").first()
    assert [m["role"] for m in row["messages"]] == ["system", "user", "assistant"] and row["messages"][1]["content"] == "Do it"
    assert json.loads(row["messages"][2]["tool_calls"][0]["function"]["arguments"]) == {"a": 1}
    assert json.loads(row["tools"][0]["function"]["parameters"])["required"] == ["a"]


def test_exports_sizes_and_limits(spark, tmp_path):
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "x.jsonl").write_text("".join(f'{{"i": {i % 40}}}\n' for i in range(50)))
    plain, mixed, other = (files.exported_rows(spark, str(tmp_path / "e"), seed) for seed in (None, 1, 2))
    assert [r["i"] for r in plain.orderBy("pos").collect()] == [i % 40 for i in range(50)]
    order = [r["i"] for r in mixed.orderBy("pos").collect()]
    assert sorted(order) == sorted(i % 40 for i in range(50)) and order != [r["i"] for r in other.orderBy("pos").collect()]
    assert sorted(r["pos"] for r in mixed.collect()) == list(range(50))
    assert [r["i"] for r in files.first_rows(mixed, "pos", 3).collect()] == order[:3] and files.first_rows(mixed, "pos", None).count() == 50
    assert [(r["directory"].rsplit("/", 1)[-1], r["files"], r["n_bytes"]) for r in files.directory_sizes(spark, str(tmp_path)).collect()] == [("e", 1, (tmp_path / "e" / "x.jsonl").stat().st_size)]


def test_mixed_windows_and_tokenizer_sample(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("domain"), F.col("doc_id").alias("pos"), "text")
    shares = {r["domain"]: 0.5 for r in docs.where("domain is not null").groupBy("domain").count().orderBy(F.desc("count")).limit(2).collect()}
    got = pipelines.mixed_windows(docs, shares, C.BatchConfig(64, 4)).collect()
    assert got and len(got) % 4 == 0 and all(len(r["input"]) == 64 for r in got)
    (tmp_path / "a.txt").write_text("one two\n\nthree\nfour\n")
    made = pipelines.tokenizer_sample(spark, {"a": str(tmp_path / "a.txt")}, 10, str(tmp_path / "out"))
    assert made["a"]["documents"] == 2 and made["a"]["byte_count"] == 12 and sinks.read_json(f"{tmp_path}/out/manifest.json") == made


def test_http_client(tmp_path):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from tidemill.sources.completion import HttpClient

    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"]))), self.headers["Authorization"]))
            code = 503 if len(asked) == 1 else 400 if "bad" in asked[-1][1]["messages"][0]["content"] else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "yes"}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = HttpClient(f"http://127.0.0.1:{server.server_port}/v1", "m", "k", wait=0.01)
    assert client.complete("hello") == "yes" and len(asked) == 2 and asked[0][0] == "/v1/chat/completions" and asked[0][2] == "Bearer k"
    with pytest.raises(Exception, match="400"):
        client.complete("bad")
    server.shutdown()


def test_fine_tuning_settings_and_artifacts():
    assert C.SftConfig(8, 2).keep == 3
    for wrong in ({"keep": 0}, {"learning_rate": 0.0}, {"least_rate": 1.0}, {"warmup_steps": -1}, {"batch_size": 0}):
        with pytest.raises(C.ConfigError):
            C.from_dict(C.SftConfig, {"context_length": 8, "batch_size": 2} | wrong)
    assert C.artifact_problems({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "9", "d": "4"}) == ["b: changed", "c: missing", "d: new"]


def test_top_k(spark):
    df = spark.createDataFrame([([1.0, None, 3.0, 3.0],), ([],), (None,)], "v array<double>").select(E.top_k(F.col("v"), 2).alias("t"))
    assert [None if r["t"] is None else [tuple(x) for x in r["t"]] for r in df.collect()] == [[(2, 3.0), (3, 3.0)], [], None]


def test_run_logs_over_http(tmp_path):
    from tidemill.sources import runlog_api

    (tmp_path / "runs" / "a").mkdir(parents=True)
    log = tmp_path / "runs" / "a" / "run.jsonl"
    log.write_text('{"step": 1}\n{"step": 2}\n')
    (tmp_path / "secret").write_text("x")
    app = runlog_api.application(str(tmp_path / "runs"))

    def get(path, query=""):
        got = {}
        body = b"".join(app({"PATH_INFO": path, "QUERY_STRING": query}, lambda status, headers: got.update(status=int(status[:3]), kind=dict(headers)["Content-Type"])))
        return got["status"], body if got["kind"] != runlog_api.JSON else json.loads(body)

    status, runs = get("/api/runs")
    assert status == 200 and [(r["path"], r["size"]) for r in runs["runs"]] == [("a/run.jsonl", log.stat().st_size)]
    assert get("/api/run", "path=a/run.jsonl&offset=12") == (200, b'{"step": 2}\n')
    assert get("/api/run", "path=a/run.jsonl&offset=999") == (200, b"")
    for query, code in (("", 400), ("path=a/run.jsonl&offset=-1", 400), ("path=a/run.jsonl&offset=x", 400), ("path=../secret", 404), ("path=a", 404), ("path=gone", 404)):
        assert get("/api/run", query)[0] == code
    assert get("/nowhere")[0] == 404 and get("/")[1].startswith(b"<!doctype html>")
