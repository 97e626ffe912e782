"""Mixing: sums kept, copies capped, shares met; odd rows."""

import random

import pytest

from tidemill.llm.mixing import mix, mix_plan, pivotal, shares, source_sizes

SIZED = "doc_id bigint, source string, n_tokens bigint"
TARGETS = "mix_name string, source string, weight double, max_repeats int, n_tokens string"


def test_pivotal_keeps_the_weighted_sum():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.randint(1, 500) for _ in range(200)]
        p = rng.random()
        out, at, left = pivotal(list(map(float, sizes)), [p] * 200, rng)
        got = sum(s * x for s, x in zip(sizes, out, strict=True)) + (sizes[at] * left if at >= 0 else 0)
        assert got == pytest.approx(p * sum(sizes), rel=1e-9)
        assert at < 0 or out[at] == 0


def test_pivotal_is_unbiased():
    n = [0, 0, 0]
    for seed in range(4000):
        out, at, left = pivotal([3.0, 5.0, 9.0], [0.4] * 3, random.Random(seed))
        for i in range(3):
            n[i] += left if i == at else out[i]
    assert all(abs(x / 4000 - 0.4) < 0.03 for x in n)


def _mixed(spark, docs, targets, **more):
    sized = spark.createDataFrame(docs, SIZED)
    plan = mix_plan(sized, spark.createDataFrame(targets, TARGETS))
    return mix(sized, plan, **more), plan


def test_shares_through_the_reduction_tree(spark):
    rng = random.Random(8)
    docs = [(i, "ab"[i % 3 == 0], rng.randint(1, 300)) for i in range(3000)]
    mixed, plan = _mixed(spark, docs, [("m", "a", 0.5, 2, ""), ("m", "b", 0.5, 9, "")], chunk_docs=50, fan_in=4)
    assert mixed.count() == 3000
    for r in shares(mixed, plan).collect():
        assert not r["short"]
        assert abs(r["actual_tokens"] - r["target_tokens"]) <= 300
    assert mixed.agg({"copies": "max"}).first()[0] <= 2


def test_the_same_seed_gives_the_same_copies(spark):
    docs = [(i, "a", i % 50 + 1) for i in range(500)]
    runs = [sorted(map(tuple, _mixed(spark, docs, [("m", "a", 0.3, 2, "")], chunk_docs=60)[0].collect())) for _ in range(2)]
    assert runs[0] == runs[1]


def test_short_sources(spark):
    docs = [(1, "a", 100), (2, "b", 100), (3, None, 800), (4, "zero", 0)]
    targets = [("m", "a", 0.2, 2, ""), ("m", "b", 0.3, 2, ""), ("m", "gone", 0.1, 5, ""), ("m", "zero", 0.1, 3, ""), ("m", "none", 0.0, 1, ""), ("n", "a", None, None, ""), ("m", None, 0.3, 2, "")]
    mixed, plan = _mixed(spark, docs, targets)
    short = {(r["mix_name"], r["source"]) for r in shares(mixed, plan).where("short and source is not null").collect()}
    assert short == {("m", "b"), ("m", "gone"), ("m", "zero")}


def test_empty(spark):
    mixed, plan = _mixed(spark, [], [("m", "a", 1.0, 1, "")])
    assert mixed.count() == 0
    assert shares(mixed, plan).count() == 1
    mixed, plan = _mixed(spark, [(1, "a", 5)], [])
    assert mixed.count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Hello world", "a", 0), (2, None, "a", 0), (3, "", None, 0), (3, "x" * 20_000, None, 0)], "doc_id bigint, text string, source string, n_tokens int")
    got = sorted((r["doc_id"], r["n_tokens"]) for r in source_sizes(df).collect())
    assert got[:3] == [(1, 2), (2, 0), (3, 0)] and got[3][1] > 0


def test_the_size_of_a_mixture_can_be_set(spark):
    from tidemill.llm.mixing import mix, mix_plan, shares

    sized = spark.createDataFrame([(i if i % 3 else None, "ab"[i % 2], 10) for i in range(300)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("m", "a", 0.25, 2), ("m", "b", 0.75, 2)], "mix_name string, source string, weight double, max_repeats int")
    plan = mix_plan(sized, targets, size=1000)
    got = {r["source"]: r["actual_tokens"] for r in shares(mix(sized, plan, chunk_docs=20), plan).collect()}
    assert abs(got["a"] - 250) <= 10 and abs(got["b"] - 750) <= 10
