"""Packing: nothing lost, nothing too large, nearly nothing unused; odd items."""

import random

from tidemill.llm.packing import best_fit, containers, fill_report, pack, spec_items, split_items

ITEMS = "spec_name string, item_key bigint, length int, sizes array<int>, shard string"


def test_best_fit_keeps_sizes_and_fills_well():
    rng = random.Random(3)
    for sizes in ([64], [32, 64, 128], [100, 37]):
        lengths = sorted((rng.randint(1, max(sizes)) for _ in range(3000)), reverse=True)
        where, size = best_fit(lengths, sizes)
        held = [0] * len(size)
        for b, n in zip(where, lengths, strict=True):
            held[b] += n
        assert all(0 < h <= s and s in sizes for h, s in zip(held, size, strict=True))
        assert all(s == min(x for x in sizes if x >= h) for h, s in zip(held, size, strict=True))
        assert sum(held) >= 0.97 * sum(size)


def test_small_optimum():
    where, size = best_fit([6, 4, 4, 3, 3], [10])
    assert len(size) == 2
    assert best_fit([], [10]) == ([], [])
    assert best_fit([3], [4, 8])[1] == [4]


def test_every_piece_once(spark):
    rng = random.Random(4)
    rows = [("s", i, rng.randint(0, 300), [64, 128], "x") for i in range(500)] + [("s", 7, None, [64, 128], "x"), ("s", None, 5, [64, 128], "x"), ("s", 1000, 100_000, [64, 128], "x")]
    packed = pack(spark.createDataFrame(rows, ITEMS), shard_items=100)
    got = packed.groupBy("item_key").sum("piece_length").collect()
    want = {}
    for _, k, n, *_ in rows:
        if n:
            want[k] = want.get(k, 0) + n
    assert {r[0]: r[1] for r in got} == want
    assert containers(packed).where("used > bin_size").count() == 0
    assert {r["item_key"] for r in split_items(packed).collect()} == {k for _, k, n, *_ in rows if n and n > 128}


def test_repeated_and_equal_items(spark):
    packed = pack(spark.createDataFrame([("s", 1, 10, [30], "")] * 9, ITEMS))
    assert packed.count() == 9
    assert fill_report(packed).first()["fill"] == 1.0


def test_empty(spark):
    assert pack(spark.createDataFrame([], ITEMS)).count() == 0
    assert pack(spark.createDataFrame([("s", 1, 0, [8], ""), ("s", 2, None, [8], "")], ITEMS)).count() == 0


def test_specs_of_the_tables(spark, sf):
    packed = pack(spec_items(spark, sf))
    total = sum(r["used"] for r in fill_report(packed).collect())
    assert total == spec_items(spark, sf).agg({"length": "sum"}).first()[0]
    joint = fill_report(pack(spec_items(spark, sf, joint=True))).collect()
    assert {r["spec_name"] for r in joint} == {"rendered_sft", "documents"}


def test_several_sizes_are_never_worse_than_one_of_them():
    rng = random.Random(6)
    for _ in range(40):
        sizes = sorted(rng.sample(range(20, 400), 3))
        lengths = sorted((rng.randint(1, sizes[-1]) for _ in range(rng.randrange(1, 120))), reverse=True)
        space = lambda s: sum(best_fit(lengths, s, 0.0)[1])
        assert space(sizes) <= space([sizes[-1]])


def test_mixed_sizes_fill_what_one_size_cannot():
    lengths = sorted([70] * 60 + [45] * 60, reverse=True)
    assert sum(best_fit(lengths, [100])[1]) > sum(best_fit(lengths, [45, 70, 100])[1]) == sum(lengths)


def test_a_huge_capacity_takes_no_memory_of_its_own():
    where, size = best_fit([10**9, 5, 4], [10**3, 10**9])
    assert size[where[0]] == 10**9 and size[where[1]] == 10**3


def test_shards_count_pieces_and_deal_equal_keys(spark):
    rows = [("s", None, 5, [8], "")] * 900 + [("s", 1, 8 * 700, [8], "")]
    packed = pack(spark.createDataFrame(rows, ITEMS), shard_items=100)
    sizes = {r[0]: r[1] for r in packed.groupBy("shard").count().collect()}
    assert len(sizes) == 16 and max(sizes.values()) < 200 and sum(sizes.values()) == 1600
