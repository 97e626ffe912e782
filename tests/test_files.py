"""Sources, sinks, tokenizers and streams."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from tidemill.functions import tokenizer
from tidemill.operators import runlog
from tidemill.sources import files, sinks
from tidemill.streaming import runlog_stream


def test_json_documents(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text('{"text": "one\\ntwo"}\n\n{"text": " ", "n": 1}\n{"n": 2}\n')
    assert sorted(r["text"] for r in files.json_documents(spark, str(path)).collect()) == ["one\ntwo", '{"n": 2}', '{"text": " ", "n": 1}']
    path.write_text("[1]\n")
    with pytest.raises(Exception, match="not a JSON object"):
        files.json_documents(spark, str(path)).collect()


def test_corpus_directory(spark, tmp_path):
    (tmp_path / "web.txt").write_text("a\n\nb\n")
    assert files.corpus_documents(spark, str(tmp_path)).count() == 2
    (tmp_path / "code.jsonl").write_text('{"text": "x"}\n')
    assert [tuple(r) for r in files.corpus_documents(spark, str(tmp_path)).collect()] == [("code", "x")]
    (tmp_path / "manifest.json").write_text(json.dumps({"files": [{"path": "code.jsonl", "domain": "c", "doc_count": 1, "estimated_token_count": 5, "target_fraction": 1}]}))
    assert files.corpus_sources(str(tmp_path))[0]["tokens"] == 7
    (tmp_path / "manifest.json").write_text(json.dumps({"files": [{"path": "gone.jsonl"}]}))
    with pytest.raises(FileNotFoundError):
        files.corpus_sources(str(tmp_path))
    with pytest.raises(FileNotFoundError):
        files.corpus_sources(str(tmp_path / "nowhere"))


def test_lines_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "rows.jsonl"
    path.write_text('{"source": "a"}\n\n{"source": ""}\n')
    rows = files.chat_rows(spark, str(path), "source string")
    assert sorted((r["line_no"], r["source"]) for r in rows.collect()) == [(0, "a"), (2, "")]
    bad = F.when(F.col("source") == "", F.array(F.lit("empty source"))).otherwise(F.array())
    with pytest.raises(Exception, match="rows.jsonl:3: empty source"):
        files.chat_rows(spark, str(path), "source string", bad).collect()


def test_lines_of_split_files_keep_their_numbers(spark, tmp_path):
    path = tmp_path / "big.txt"
    path.write_text("".join(f"line {i}\n" if i % 5 else "\n" for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = files.numbered_lines(spark, str(path))
        assert lines.where("value <> ''").where("value <> concat('line ', line_no)").count() == 0
        assert lines.agg(F.max("line_no"), F.count("*")).first()[:] == (19_999, 20_000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_benchmark_rows(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as out:
        out.write('{"x": 1}\n{"x": 2, "y": "z"}\n')
    spark.createDataFrame([(3,)], "x bigint").toPandas().to_parquet(tmp_path / "b.parquet")
    assert sorted(r["x"] for r in files.benchmark_rows(spark, str(tmp_path)).collect()) == [1, 2, 3]
    (tmp_path / "manifest.json").write_text('{"files": ["c.csv"]}')
    with pytest.raises(FileNotFoundError):
        files.benchmark_rows(spark, str(tmp_path))
    (tmp_path / "c.csv").write_text("x\n")
    with pytest.raises(ValueError, match="unknown kind"):
        files.benchmark_rows(spark, str(tmp_path))


def test_hub_urls(spark):
    df = spark.createDataFrame([("hf://datasets/org/name@main/data/x.parquet",), ("hf://datasets/org/name/y",), ("https://x",)], "u string")
    got = [tuple(r) for r in df.select(*(c.alias(n) for n, c in files.hub_url_parts(F.col("u")).items())).collect()]
    assert got == [("org/name", "main", "data/x.parquet"), ("org/name", "", "y"), ("", "", "")]


def test_run_logs(spark, tmp_path):
    import os

    for name, at in (("old", 100), ("new", 200)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "run.jsonl").write_text("{}\n")
        os.utime(tmp_path / name / "run.jsonl", (at, at))
    (tmp_path / "other.jsonl").write_text("{}\n")
    assert [r["path"].split("/")[-2] for r in files.run_logs(spark, str(tmp_path)).collect()] == ["new", "old"]
    assert files.run_log_path(str(tmp_path), "old/run.jsonl").is_file()
    for bad in ("../x/run.jsonl", "other.jsonl", "gone/run.jsonl"):
        with pytest.raises(FileNotFoundError):
            files.run_log_path(str(tmp_path), bad)
    assert files.optional_rows(spark, str(tmp_path / "gone.jsonl")).count() == 0


def test_corpus_and_manifests(spark, tmp_path):
    docs = spark.createDataFrame([("train", "a", "x", 30), ("val", "a", "y\nz", 40)], "split string, domain string, text string, n_bytes bigint")
    sinks.write_corpus(docs, str(tmp_path / "corpus"))
    assert {(r["split"], r["domain"], r["text"]) for r in spark.read.json(str(tmp_path / "corpus")).collect()} == {("train", "a", "x"), ("val", "a", "y\nz")}
    per = spark.createDataFrame([("train", "a", 1.0, 1, 31, 7), ("train", "b", 0.0, 0, 3, 0)], "split string, domain string, fraction double, doc_count bigint, byte_count bigint, estimated_tokens bigint")
    m = sinks.corpus_manifests(per, sinks.fingerprint({"b": 1, "a": 2}), str(tmp_path))["train"]
    assert m["estimated_token_count"] == 8 and len(m["files"]) == 2
    assert json.loads((tmp_path / "train.manifest.json").read_text()) == m
    assert sinks.fingerprint({"a": 2, "b": 1}) == m["fingerprint"]


def test_rows_keep_nulls(spark, tmp_path):
    sinks.write_rows(spark.createDataFrame([("é", None)], "a string, b string"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).first()["value"] == '{"a":"é","b":null}'


def test_manifest_upsert_and_publish(tmp_path):
    at = tmp_path / "m.json"
    sinks.upsert_manifest(at, "a", {"n": 1})
    assert sinks.upsert_manifest(at, "b", {"n": 2}) == {"a": {"n": 1}, "b": {"n": 2}}
    for name in ("draft", "final"):
        (tmp_path / name).mkdir()
        (tmp_path / name / name).write_text("")
    sinks.publish(str(tmp_path / "draft"), str(tmp_path / "final"))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["final", "m.json"] and (tmp_path / "final" / "draft").is_file()


def test_retention():
    names = [("step_1", 5.0), ("step_2", 4.0), ("step_3", 4.0), ("best", 0.0), ("final", 0.0), ("step_x", 0.0)]
    assert sinks.expired(names, 1) == ["step_2", "step_3"]
    assert sinks.expired(names, 9) == []


def test_content_hash_follows_order_and_content(spark):
    df = spark.range(10).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    one = sinks.content_hash(df, "v", "k").first()[0]
    assert one == sinks.content_hash(df.repartition(4), "v", "k").first()[0]
    assert one != sinks.content_hash(df.withColumn("k", 9 - F.col("k")), "v", "k").first()[0]


def test_scorecard(spark, tmp_path):
    card = sinks.scorecard(spark.createDataFrame([("x", 0.5)], "name string, acc double"), "name", str(tmp_path / "s.json"))
    assert card == {"x": {"acc": 0.5}} == json.loads((tmp_path / "s.json").read_text())


def test_tokenizer(spark, tmp_path):
    df = spark.createDataFrame([(1, "Hello é im_end"), (2, None), (3, "")], "k bigint, t string")
    got = {r["k"]: r for r in tokenizer.encoded(df, ["k"], "t").collect()}
    assert got[1]["round_trip"] and got[2]["token_ids"] is None and got[3]["token_ids"] == []
    own = tokenizer.train(["the cat sat on the mat"] * 50, 300)
    assert tokenizer.missing_bytes(own) == tokenizer.missing_bytes(tokenizer.load(tokenizer.TOKENIZER)) == []
    assert own.encode("a tool_calling im_end").ids.count(own.token_to_id("im_end")) == 1
    assert own.decode(own.encode("é😀").ids) == "é😀"
    own.save(str(tmp_path / "t.json"))
    rows = spark.createDataFrame([(1, [("user", "hi", None), ("assistant", "cat", None)], None), (2, [("assistant", None, [("function", ("f", '{"a":1}'))])], "tools")], "k bigint, messages array<struct<role string, content string, tool_calls array<struct<type string, function struct<name string, arguments string>>>>>, tools_text string")
    out = {r["k"]: r for r in tokenizer.rendered_ids(rows, "k", str(tmp_path / "t.json")).collect()}
    for r in out.values():
        assert len(r["token_ids"]) == len(r["loss_mask"])
    text = own.decode([i for i, m in zip(out[1]["token_ids"], out[1]["loss_mask"], strict=True) if m], skip_special_tokens=False)
    assert text.replace(" ", "") == "catim_end"
    assert sum(out[2]["loss_mask"]) > 3


def test_reports():
    assert sinks.report_lines([{"name": "x", "acc": 0.51239, "n": 3}, {"name": "y", "acc": None, "n": 4}]) == ["name\tacc\tn", "x\t0.5124\t3", "y\t-\t4"]
    assert sinks.report_lines([]) == []


def test_padded(spark):
    df = spark.createDataFrame([([5, 6, 7], [0, 1, 1])], "ids array<int>, m array<int>")
    assert [list(x) for x in df.select(*tokenizer.padded("ids", "m", 5)).first()] == [[5, 6, 7, 0, 0], [6, 7, 0, 0, 0], [1, 1, 0, 0, 0]]


def test_stream_equals_batch(spark, tmp_path):
    lines = [[(1, 2.0), (2, 1.9)], [(2, 1.8), (3, 1.7)], [(3, None)]]
    for i, part in enumerate(lines):
        (tmp_path / f"{i}.jsonl").write_text("".join(json.dumps({"step": s, "train_loss": x}) + "\n" for s, x in part) + '{"step": 9, "tr')
    read = lambda r: r.format("text").load(str(tmp_path)).select(F.lit("r").alias("run"), F.regexp_extract(F.col("_metadata.file_name"), r"\d+", 0).cast("bigint").alias("line_no"), "value")
    batch = runlog.last_wins(runlog.parsed_lines(read(spark.read)))
    stream = runlog_stream.run_available(runlog.parsed_lines(read(spark.readStream)), "test")
    assert sorted(map(tuple, stream.collect()), key=lambda r: r[1]) == sorted(map(tuple, batch.select(*stream.columns).collect()), key=lambda r: r[1])
