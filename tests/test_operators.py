"""Operators of the core: invariants, odd rows, and the same result in any partitioning."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import benchmarks, chat, corpus, dedup, generate, metrics, runlog, sampling, toolrows, windows
from tidemill.operators.prefix import id_slot, positions, running_total


def test_running_total_equals_a_loop(spark):
    rng = random.Random(1)
    rows = [(i * 7, rng.choice("ab"), rng.randint(0, 9)) for i in range(300)] + [(5000, None, 3), (5001, None, 4)]
    df = spark.createDataFrame(rows, "k bigint, g string, v bigint").repartition(5)
    got = {r["k"]: r["before"] for r in running_total(df, id_slot("k", 64), ["k"], {"before": F.col("v")}, ["g"]).collect()}
    sums: dict = {}
    for k, g, v in rows:
        assert got[k] == sums.get(g, 0)
        sums[g] = sums.get(g, 0) + v
    assert len(got) == len(rows)


def test_budget_keeps_the_crossing_document_and_at_least_one(spark):
    docs = spark.createDataFrame([(1, "a", "x", 10), (2, "a", "x", 10), (3, "a", "x", 10), (4, "b", "y", 5), (5, "c", "z", 9)], "pos bigint, domain string, text string, n_bytes bigint")
    targets = spark.createDataFrame([("a", 11), ("b", 0)], "domain string, target bigint")
    assert sorted(r["pos"] for r in corpus.budget_cut(docs, targets).collect()) == [1, 2, 4]


def test_manifest_names_empty_components(spark):
    docs = spark.createDataFrame([("train", "a", 10)], "split string, domain string, n_bytes bigint")
    m = corpus.manifest(docs, spark.createDataFrame([("a", 0.5), ("b", 0.5)], "domain string, fraction double"))
    assert m.count() == 6 and m.where("doc_count = 0").count() == 5


def test_fractions_fall_back(spark):
    given = lambda rows: {r["domain"]: r["share"] for r in corpus.normalized_fractions(spark.createDataFrame(rows, "domain string, fraction double, tokens bigint")).collect()}
    assert given([("a", 1.0, 0), ("b", 3.0, 0)]) == {"a": 0.25, "b": 0.75}
    assert given([("a", 0.0, 1), ("b", 0.0, 1)]) == {"a": 0.5, "b": 0.5}
    assert given([("a", 0.0, 0), ("b", 0.0, 0)]) == {"a": 0.5, "b": 0.5}


def _pack(docs, context):
    stream = []
    for no, ids in enumerate(d for d in docs if d):
        stream += [(x, no) for x in [0, *ids, 1]]
    out = []
    for at in range(0, len(stream) - context + 1, context):
        w = stream[at : at + context]
        out.append(([x for x, _ in w], [x for x, _ in w][1:] + [w[-1][0]], [n for _, n in w]))
    return out


def test_windows_equal_a_sequential_packer(spark):
    rng = random.Random(2)
    docs = [[rng.randint(2, 99) for _ in range(rng.choice((0, 1, 5, 40)))] for _ in range(60)]
    df = spark.createDataFrame([(i, ids, len(ids)) for i, ids in enumerate(docs)], "doc_id bigint, ids array<int>, n int").repartition(4)
    cut = windows.window_segments(windows.stream_offsets(df, "n", "doc_id"), 16)
    got = windows.window_tokens(cut, "ids", 0, 1, 16).orderBy("window_id").collect()
    assert [(r["input"], r["target"], r["doc_ids"]) for r in got] == _pack(docs, 16)


def test_deficit_picks_keep_the_shares():
    rng = random.Random(3)
    lengths = [[100] * 4000, [1] * 400_000]
    picks = windows.deficit_picks([lengths[0][:500], lengths[1][:50_000]], [0.5, 0.5], rng)
    half = picks[: len(picks) // 2]
    tokens = [sum(100 if s == 0 else 1 for s, _ in half if s == k) for k in (0, 1)]
    assert abs(tokens[0] / sum(tokens) - 0.5) < 0.05
    assert sorted(d for s, d in picks if s == 0) == list(range(500))


def test_deficit_order_draws_every_document_once(spark):
    rows = [("ab"[i % 2], 0.5, i, 10 + i % 7) for i in range(400)]
    got = windows.deficit_order(spark.createDataFrame(rows, "domain string, share double, pos bigint, n_stream bigint"), block=500).collect()
    assert sorted(r["pos"] for r in got) == list(range(400))


def test_greedy_keys_are_those_of_accepted_rows(spark):
    rows = [(1, 1, "x"), (2, 2, "x"), (3, 2, "z"), (4, None, None), (5, None, None)]
    got = dedup.greedy_first_wins(spark.createDataFrame(rows, "o bigint, id bigint, q string"), ["id", "q"], "o")
    assert sorted(r["o"] for r in got.collect()) == [1, 3, 4, 5]


def test_greedy_equals_a_loop(spark):
    rng = random.Random(4)
    for _ in range(4):
        rows = [(i, rng.choice([None, *range(8)]), rng.choice([None, *"abcdefgh"])) for i in range(60)]
        seen: list[set] = [set(), set()]
        want = []
        for o, *keys in rows:
            if all(k is None or k not in s for k, s in zip(keys, seen, strict=True)):
                want.append(o)
                for k, s in zip(keys, seen, strict=True):
                    s.add(k)
        got = dedup.greedy_first_wins(spark.createDataFrame(rows, "o bigint, a int, b string"), ["a", "b"], "o")
        assert sorted(r["o"] for r in got.collect()) == want


@pytest.mark.parametrize("few", [100_000, 0])
def test_greedy_of_a_chain_longer_than_the_rounds(spark, monkeypatch, few):
    monkeypatch.setattr(dedup, "FEW", few)
    monkeypatch.setattr(dedup, "ROUNDS", 3)
    rows = [(i, (i + 1) // 2, str(i // 2)) for i in range(450)]
    got = dedup.greedy_first_wins(spark.createDataFrame(rows, "o bigint, a int, b string"), ["a", "b"], "o")
    assert sorted(r["o"] for r in got.collect()) == list(range(0, 450, 2))


def test_greedy_of_nothing(spark):
    assert dedup.greedy_first_wins(spark.createDataFrame([], "o bigint, a int"), ["a"], "o").count() == 0


def test_first_wins_takes_nulls_as_a_key(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, "a")], "o bigint, k string")
    assert sorted(r["o"] for r in dedup.first_wins(df, ["k"], "o").collect()) == [1, 3]


def test_largest_remainder(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "source string, n bigint")
    assert {r["source"]: r["allocated"] for r in sampling.largest_remainder(sizes, 2).collect()} == {"a": 1, "b": 1, "c": 0}
    assert {r["source"]: r["allocated"] for r in sampling.largest_remainder(sizes, 9).collect()} == {"a": 1, "b": 1, "c": 1}


def test_mixture_policies(spark):
    available = spark.createDataFrame([("a", 5), ("b", 1), ("c", 9)], "source string, available bigint")
    plan = lambda policy, recipe: {r["source"]: r["selected"] for r in sampling.mixture_plan(available, recipe, ["a", "b", "c", "d"], policy).collect()}
    assert plan("shrink", {"a": 2, "b": 3}) == {"a": 2, "b": 1, "c": 0, "d": 0}
    assert plan("redistribute", {"a": 2, "b": 3}) == {"a": 4, "b": 1, "c": 0, "d": 0}
    with pytest.raises(Exception, match="short"):
        plan("fail", {"a": 2, "b": 3})
    short = sampling.mixture_plan(available, {"b": 4}, ["a", "b"], "redistribute")
    with pytest.raises(Exception, match="3 rows short"):
        sampling.check_total(short).collect()


def test_samples_do_not_depend_on_partitioning(spark):
    df = spark.range(500).withColumn("source", F.concat(F.lit("s"), F.col("id") % 3))
    once, again = (sorted(r["id"] for r in sampling.ratio_subset(d, "id", "source", 50, 1).collect()) for d in (df.repartition(1), df.repartition(6)))
    assert once == again and len(once) == 50


def test_positions(spark):
    df = spark.range(100).withColumn("h", F.sha2(F.col("id").cast("string"), 256)).repartition(3)
    from tidemill.operators.prefix import hash_slot

    got = [r["id"] for r in positions(df, hash_slot("h"), ["h"]).orderBy("pos").collect()]
    assert got == [r["id"] for r in df.orderBy("h").collect()]


def test_rule_breaks(spark):
    schema = "messages array<struct<role string, content string, name string, tool_calls array<struct<type string, function struct<name string, arguments string>>>>>, tools array<struct<type string, function struct<name string, description string, parameters string>>>"
    tool = [("function", ("f", "", "{}"))]
    call = [("function", ("f", "{}"))]
    u, a, c, t = ("user", "hi", None, None), ("assistant", "yes", None, None), ("assistant", None, None, call), ("tool", "{}", "f", None)
    cases = [
        ([u, a], None, []), ([u, c, t, a], tool, []), (None, None, ["no_messages"]), ([a], None, ["first_role"]), ([u, ("assistant", None, None, None)], None, ["empty_turn"]), ([u, ("assistant", "x", None, call)], tool, ["content_and_call"]),
        ([u, ("assistant", None, None, call * 2)], tool, ["call_count"]), ([u, t], tool, ["tool_follows"]), ([u, c], None, ["undeclared_call"]), ([u, c, ("tool", "{}", "g", None)], tool, ["tool_follows"]), ([u, a], tool * 2, ["tool_names"]),
        ([("robot", "x", None, None)], None, ["first_role", "unknown_role"]), ([("user", None, None, None)], None, ["no_content"]), ([u, c, ("tool", "{}", "", None)], tool, ["tool_follows", "tool_name"]),
    ]
    df = spark.createDataFrame([(m, t) for m, t, _ in cases], schema)
    assert [r[0] for r in df.select(chat.rule_breaks(F.col("messages"), F.col("tools"))).collect()] == [w for *_, w in cases]


def test_responses(spark):
    texts = ['```json\n{"prompt": "p", "response": "r"}\n```', 'Sure: {"prompt": "p", "response": "im_end"} ok', '{"prompt": "p"}', "no", '{"prompt": "%s", "response": "r"}' % ("p" * 99), "{broken"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(chat.response_row(F.col("t"), "prompt", "response", (50, 50)).alias("x")).select("x.*").collect()
    assert [r["reason"] for r in got] == [None, "reserved_token", "missing_fields", "invalid_json", "prompt_too_long", "invalid_json"]
    assert got[0]["messages"][1]["content"] == "r"


def test_choice_accuracy(spark):
    rows = [("b", 1, 0, -1.0, 1, 0), ("b", 1, 1, -1.0, 2, 0), ("b", 2, 0, None, 1, 1), ("b", 2, 1, -9.0, 1, 1), ("b", 3, 0, None, 1, 0), ("b", 3, 1, None, 1, 0), ("b", 4, 0, -1.0, 1, -1), ("b", 4, 1, -2.0, 1, -1)]
    got = metrics.choice_accuracy(spark.createDataFrame(rows, "bench string, case bigint, choice int, logprob double, tokens bigint, label int"), ["case"], "bench").first()
    assert got["examples"] == 3
    assert got["acc"] == pytest.approx(200 / 3) and got["acc_norm"] == pytest.approx(100 / 3)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "c string, attempted boolean")
    got = metrics.assistant_metrics(empty, "c", "attempted").first()
    assert got["rows"] == 0 and got["non_empty_rate"] == 0.0


def test_pairs_must_be_complete(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, e string"), spark.createDataFrame([(2, "y")], "k int, o string")
    with pytest.raises(Exception, match="no output"):
        metrics.paired(a, b, ["k"]).collect()


def test_run_log_lines(spark):
    lines = [(1, '{"step": 1, "train_loss": 2.0}'), (2, '{"step": 1, "train_loss": 1.5, "val_loss": 1.0}'), (3, "broken"), (4, '{"step": 2, "tra')]
    df = spark.createDataFrame([("r", n, v) for n, v in lines], "run string, line_no bigint, value string")
    got = runlog.last_wins(runlog.parsed_lines(df)).collect()
    assert [(r["step"], r["train_loss"], r["val_loss"]) for r in got] == [(1, 1.5, 1.0)]


def test_mappings(spark):
    def cases(name, rows, schema):
        return [tuple(r) for r in benchmarks.mcq_cases(name, spark.createDataFrame(rows, schema)).collect()]

    assert cases("winogrande", [("The _ is big.", "cat", "dog", "2"), ("No gap", "a", "b", "1"), (None, "a", "b", "1")], "sentence string, option1 string, option2 string, answer string") == [("The ", ["cat is big.", "dog is big."], 1), ("No gap ", ["a", "b"], 0)]
    assert cases("piqa", [("g", "a", "b", 1), ("g", "a", None, 1), ("g", "a", "b", 2)], "goal string, sol1 string, sol2 string, label int") == [("g", ["a", "b"], 1)]
    assert cases("boolq", [("p", "q", True, 1)], "passage string, question string, answer boolean, label int") == [("p\nQuestion: q ", ["no", "yes"], 1)]
    assert cases("arc_easy", [("q", (["x", "y"], ["1", "2"]), "2"), ("q", (["x", "y"], ["A", "B"]), "b"), ("q", (["x"], ["A"]), "D")], "question string, choices struct<text array<string>, label array<string>>, answerKey string") == [("q", ["x", "y"], 1), ("q", ["x", "y"], 1)]
    (context, choices, label), = cases("sciq", [("q", "a", "b", "c", "right")], "question string, distractor1 string, distractor2 string, distractor3 string, correct_answer string")
    assert choices[label] == "right" and sorted(choices) == ["a", "b", "c", "right"]
    with pytest.raises(ValueError, match="no multiple-choice"):
        benchmarks.mcq_cases("lambada", spark.range(1))
    with pytest.raises(ValueError, match="unknown benchmarks: nope"):
        benchmarks.selected(benchmarks.catalogue(spark), ["nope"])


def test_generated_rows_are_valid_and_repeatable(spark):
    rows = generate.training_rows(spark, 5, 0.01).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, generate.training_rows(spark, 5, 0.01).repartition(3).collect()))
    held = {r["name"] for r in generate.held_out_names(spark).collect()}
    for r in rows:
        names = [t["function"]["name"] for t in json.loads(r["tools"])]
        assert len(set(names)) == len(names) and not held & set(names)
        calls = [m for m in json.loads(r["messages"]) if m.get("tool_calls")]
        assert bool(calls) == (r["kind"] not in ("no_tool", "missing_info"))
    assert {r["kind"] for r in generate.evaluation_rows(spark, 5, 0.01).collect()} == set(generate.EVAL_KINDS)


def test_completion_failures_are_null(spark):
    class Client:
        def complete(self, prompt):
            if "2" in prompt:
                raise RuntimeError
            return prompt.upper()

    got = toolrows.complete(spark.createDataFrame([("a1",), ("a2",)], "prompt string"), Client).collect()
    assert sorted((r["prompt"], r["response"]) for r in got) == [("a1", "A1"), ("a2", None)]
