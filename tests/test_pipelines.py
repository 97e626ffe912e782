"""Whole runs on small inputs, and strict configurations."""

import json

import pytest
from pyspark.sql import functions as F

from tidemill import config as C
from tidemill.operators import chat
from tidemill.plans import pipelines


def _corpus(tmp_path, **more):
    for name, n in (("web", 200), ("code", 200)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"text": f"{name} line {i}"}) + "\n" for i in range(n)))
    raw = {"total_bytes": 6000, "output_dir": str(tmp_path / "out"), "val_fraction": 0.2, "components": [{"name": n, "fraction": f, "path": str(tmp_path / f"{n}.jsonl")} for n, f in (("web", 0.75), ("code", 0.25))]}
    return C.from_dict(C.CorpusConfig, raw | more)


def test_corpus_is_built_once(spark, tmp_path):
    config = _corpus(tmp_path)
    first = pipelines.build_corpus(spark, config)
    by = {f["domain"]: sum(x["byte_count"] for m in first.values() for x in m["files"] if x["domain"] == f["domain"]) for f in first["train"]["files"]}
    assert 4500 <= by["web"] < 4600 and 1500 <= by["code"] < 1600
    back = spark.read.json(str(tmp_path / "out" / "documents"))
    assert back.count() == sum(m["doc_count"] for m in first.values())
    assert back.groupBy("text").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    mark = (tmp_path / "out" / "train.manifest.json").stat().st_mtime_ns
    assert pipelines.build_corpus(spark, config) == first
    assert (tmp_path / "out" / "train.manifest.json").stat().st_mtime_ns == mark
    assert pipelines.existing_corpus(_corpus(tmp_path, seed=1)) is None


def test_a_component_that_runs_dry(spark, tmp_path):
    with pytest.raises(ValueError, match="web"):
        pipelines.build_corpus(spark, _corpus(tmp_path, total_bytes=100_000, min_component_fill=0.9))


def test_rows_are_prepared_until_enough(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"q {i}", "why" if i % 3 == 0 else f"because\n#### {i}") for i in range(30)], "k bigint, question string, answer string")
    entry = pipelines.prepare_rows(rows, "k", chat.math_chat(F.col("question"), F.col("answer")), "math", 10, str(tmp_path))
    assert entry["written_rows"] == 10 and entry["candidate_rows"] == 15 and entry["filtered_rows"] == 5
    assert spark.read.json(str(tmp_path / "math")).count() == 10
    assert json.loads((tmp_path / "manifest.json").read_text())["math"] == entry


def test_mixture_falls_back(spark, tmp_path):
    for name, n in (("a", 5), ("b", 3)):
        (tmp_path / "in" / name).mkdir(parents=True)
        (tmp_path / "in" / name / "part.txt").write_text("".join(f'{{"source": "{name}", "i": {i}}}\n' for i in range(n)))
    raw = {"input_dir": str(tmp_path / "in"), "output_dir": str(tmp_path / "out"), "recipe": {"a": 2, "b": 2, "llm": 1}, "fallback_recipe": {"a": 3, "b": 2}, "fallback_when_missing": "llm", "order": ["a", "b", "llm"]}
    m = pipelines.build_mixture(spark, C.from_dict(C.MixtureConfig, raw))
    assert m["recipe_used"] == "fallback" and m["total_rows"] == 5
    again = pipelines.build_mixture(spark, C.from_dict(C.MixtureConfig, raw))
    assert again == m
    short = C.from_dict(C.MixtureConfig, raw | {"fallback_recipe": {"a": 3, "b": 9}, "deficit_policy": "fail"})
    with pytest.raises(Exception, match="short"):
        pipelines.build_mixture(spark, short)


def test_tools(spark, tmp_path, sf):
    made = pipelines.prepare_tools(spark, str(tmp_path), 3, 0.005)
    assert made["tool_local"]["written_rows"] == 51 or made["tool_local"]["written_rows"] > 40
    rows = spark.read.parquet(f"{sf}/sft_public_tool_fixture.parquet")
    entry = pipelines.prepare_public_tools(rows, 5, 1, str(tmp_path))
    assert entry["written_rows"] == 5 and entry["dropped_rows"] > 0


def test_completions(spark, tmp_path):
    class Client:
        def complete(self, prompt):
            n = int(prompt.rsplit(" ", 1)[1])
            return "nothing" if n % 4 == 0 else json.dumps({"prompt": f"Ask {n // 2}", "response": "Say."})

    entry, reasons = pipelines.prepare_completions(spark, "assistant", ("prompt", "response"), (99, 99), 3, 4, Client, str(tmp_path))
    assert entry["written_rows"] == 3
    assert {r["reason"]: r["responses"] for r in reasons.collect()} == {"ok": 9, "invalid_json": 3}


def test_scorecards(spark, tmp_path):
    tools = '[{"name": "f", "parameters": {"type": "object", "properties": {"a": {"type": "integer"}}}}]'
    cases = [("assistant", 1, "x", None, None, None), ("math", 1, "Final answer: 4", None, None, None), ("tool_seen", 1, None, "f", '{"a": 1}', tools), ("tool_no_call", 1, "x", None, None, None)]
    outputs = [("c", "assistant", 1, "Hello."), ("c", "math", 1, "It is 4."), ("c", "tool_seen", 1, 'tool_call {"name": "f", "arguments": {"a": 1}} tool_call_end'), ("c", "tool_no_call", 1, "tool_call {")]
    frames = [spark.createDataFrame([("c",), ("gone",)], "checkpoint string"), spark.createDataFrame(cases, "category string, case_id bigint, expected string, expected_tool string, expected_arguments string, tools_json string")]
    card = pipelines.sft_scorecard(*frames, spark.createDataFrame(outputs, "checkpoint string, category string, case_id bigint, text string"), str(tmp_path / "s.json"))
    assert card["gone"] == {"status": "missing"} and card["c"]["status"] == "ok"
    assert card["c"]["math"]["exact_match_rate"] == 1.0 and card["c"]["tool_seen"]["argument_exact_rate"] == 1.0 and card["c"]["tool_no_call"]["correct_rate"] == 0.0 and card["c"]["assistant"]["non_empty_rate"] == 1.0
    with pytest.raises(Exception, match="no output"):
        pipelines.sft_scorecard(*frames, spark.createDataFrame(outputs[:2], "checkpoint string, category string, case_id bigint, text string"), str(tmp_path / "s.json"))
    lm = spark.createDataFrame([("lambada", 2.0, 3, 4)], "name string, nats double, tokens bigint, bytes bigint")
    mcq = spark.createDataFrame([("piqa", 1, 0, -1.0, 2, 0), ("piqa", 1, 1, -2.0, 2, 0)], "name string, case_id bigint, choice int, logprob double, tokens bigint, label int")
    card = pipelines.benchmark_scorecard(spark, lm, mcq, str(tmp_path / "b.json"), only=["piqa", "lambada", "mmlu"])
    assert card["piqa"]["acc"] == 100.0 and card["lambada"]["bpb"] == pytest.approx(2 / (0.6931471805599453 * 4)) and card["mmlu"]["status"] == "missing"


def test_windows_resume(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    all_ = pipelines.pretrain_windows(docs, "doc_id", "text", C.BatchConfig(64, 4))
    whole = sorted((r["batch_id"], r["slot"], tuple(r["input"])) for r in all_.collect())
    rest = sorted((r["batch_id"], r["slot"], tuple(r["input"])) for r in pipelines.resumed(all_, 2).collect())
    assert rest == [r for r in whole if r[0] > 2] and rest
    capped = pipelines.pretrain_windows(docs, "doc_id", "text", C.BatchConfig(64, 4, total_tokens=300))
    assert capped.count() == 8


@pytest.mark.parametrize(
    ("kind", "raw", "why"),
    [
        (C.BatchConfig, {"context_length": 8, "batch_size": 2, "x": 1}, "unknown"), (C.BatchConfig, {"context_length": 8}, "missing"), (C.BatchConfig, {"context_length": "8", "batch_size": 2}, "int is needed"), (C.BatchConfig, {"context_length": True, "batch_size": 2}, "int is needed"),
        (C.BatchConfig, {"context_length": 1, "batch_size": 2}, "context_length"), (C.TokenizerConfig, {"vocab_size": 100}, "vocab_size"), (C.TokenizerConfig, {"eos_token": "end"}, "eos_token"), (C.TokenizerConfig, {"special_tokens": ["a", "a"], "eos_token": "a"}, "differ"),
        (C.CorpusConfig, {"total_bytes": 1, "output_dir": "x", "components": [{"name": "a", "fraction": 0.5, "path": "p"}]}, "add up"), (C.MixtureConfig, {"input_dir": "a", "output_dir": "b", "recipe": {"a": "1"}}, "int is needed"), (C.MixtureConfig, {"input_dir": "a", "output_dir": "b", "recipe": {}, "deficit_policy": "x"}, "deficit_policy"),
        (C.BatchConfig, [], "mapping"),
    ],
)
def test_strict_configurations(kind, raw, why):
    with pytest.raises(C.ConfigError, match=why):
        C.from_dict(kind, raw)


def test_yaml_and_resume(tmp_path):
    (tmp_path / "c.yaml").write_text("context_length: 8\nbatch_size: 2\n")
    config = C.load(str(tmp_path / "c.yaml"), C.BatchConfig)
    assert config == C.BatchConfig(8, 2)
    assert C.resume_problems(C.as_dict(config) | {"output_dir": "a"}, C.as_dict(C.BatchConfig(8, 3)) | {"output_dir": "b"}) == ["batch_size"]
