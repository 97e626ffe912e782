"""Overlaps across splits: against brute force, and on odd rows."""

import random

from tidemill.functions.normalize import words
from tidemill.llm import overlap

SCHEMA = "table_name string, row_key bigint, split string, text string, train_key string"


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _brute(rows, share=0.85):
    out = set()
    coded = [(t, k, s, words(x)) for t, k, s, x, *_ in rows if x and k is not None and words(x)]
    for t, k, s, w in coded:
        if s == "train":
            for t2, k2, s2, w2 in coded:
                if s2 in ("val", "test") and t == t2:
                    n = max(len(w), len(w2))
                    if min(len(w), len(w2)) >= share * n and _lcs(w, w2) >= share * n:
                        out.add((t, k, k2))
    return out


def _found(spark, rows, **more):
    df = overlap.cross_split_pairs(spark.createDataFrame(rows, SCHEMA), **more)
    return {(r["table_name"], r["train_key"], r["held_key"]) for r in df.collect()}


def test_common_words_equals_dynamic_programme():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(30))] for _ in range(2))
        assert overlap.common_words(a, b) == _lcs(a, b)


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, key = [], 0
    for _ in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(15, 60))]
        for split in ("train", rng.choice(("val", "test"))):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(("t", key, split, " ".join(copy), "x"))
            key += 1
    want, got = _brute(rows), _found(spark, rows)
    assert got <= want
    assert len(got) >= 0.98 * len(want)


def _rarest_changed(n, seed=3):
    """Texts of 20 words of which the three rarest, names and numbers, differ in the held-out copy; and unrelated ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        base = [rng.choice(vocabulary) for _ in range(17)]
        at = sorted(rng.sample(range(18), 3))
        for side, split in enumerate(("train", "test")):
            copy = list(base)
            for j in at:
                copy.insert(j, f"name{i}x{j}x{side}")
            rows.append(("t", 2 * i + side, split, " ".join(copy), ""))
    return rows


def test_pairs_with_their_rarest_words_changed(spark):
    rows = _rarest_changed(150)
    assert _found(spark, rows) == _brute(rows) >= {("t", 2 * i, 2 * i + 1) for i in range(150)}


def test_split_postings_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(overlap, "HOT_PAIRS", 1)
    rng = random.Random(4)
    rows = _rarest_changed(60) + [("t", 1000 + i, rng.choice(("train", "val")), " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))), "") for i in range(120)]
    assert _found(spark, rows) == _brute(rows)
    rows = [r for r in rows if r[1] >= 1000]
    got = {(t, k, k2) for t, k, k2 in _brute(rows, 0.5)}
    assert _found(spark, rows, share=0.5) == got


def test_real_rows_against_brute_force(spark, sf):
    from tidemill.llm.queries import _texts

    df = _texts(spark, sf)
    rows = [tuple(r) + ("",) for r in df.collect()]
    got = {(r["table_name"], r["train_key"], r["held_key"]) for r in overlap.cross_split_pairs(df).collect()}
    assert got == _brute(rows)


def test_odd_rows(spark):
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [
        ("t", 1, "train", None, "a"), ("t", 2, "test", None, "a"), ("t", 3, "train", "", "a"), ("t", 4, "test", " \u200b ", "a"),
        ("t", 5, "train", "One two THREE, four five", None), ("t", 6, "test", "one two three four five", None), ("t", 7, "val", "one\ufeff two three four five!", None),
        ("u", 6, "test", "one two three four five", None), ("t", None, "train", "one two three four five", None), ("t", 8, None, "one two three four five", None),
        ("t", 9, "train", long, "b"), ("t", 10, "test", long + " more", "b"), ("t", 5, "train", "One two THREE, four five", None), ("t", 11, "other", "one two three four five", None),
    ]
    assert _found(spark, rows) == {("t", 5, 6), ("t", 5, 7), ("t", 9, 10)}


def test_hot_group_of_copies(spark):
    rows = [("t", i, "train", "the same request over and over again", "") for i in range(200)] + [("t", 1000 + i, "test", "The same request, over and over again.", "") for i in range(20)]
    assert len(_found(spark, rows)) == 200 * 20


def test_empty_table(spark):
    assert overlap.cross_split_pairs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_result_does_not_depend_on_partitioning(spark, sf):
    from tidemill.llm.queries import _texts

    one, many = (sorted(map(tuple, overlap.cross_split_pairs(_texts(spark, sf).repartition(n)).collect())) for n in (1, 7))
    assert one == many


def test_fingerprints_differ_no_more_than_texts():
    import numpy as np

    rng = random.Random(11)
    for _ in range(100):
        a = [rng.randrange(1 << 20) for _ in range(rng.randrange(1, 400))]
        b = [x for x in a if rng.random() < 0.9] + [rng.randrange(1 << 20) for _ in range(rng.randrange(20))]
        b = b or [1]
        apart = len(set(a) ^ set(b))
        a, b = sorted(set(a)), sorted(set(b))
        wide, narrow = (overlap.fingerprints(np.array([0, len(x)]), np.array(x, np.int64), bits).tobytes() for x, bits in ((a, 2048), (b, 512)))
        assert overlap.within_radius(wide, narrow, apart)
        assert overlap.within_radius(narrow, overlap.fingerprints(np.array([0, len(b)]), np.array(b, np.int64), 2048).tobytes(), 0)


def test_report_counts_are_those_of_the_pairs(spark, sf):
    from pyspark.sql import functions as F

    from tidemill.llm.queries import _texts

    found = overlap.cross_split_overlap(_texts(spark, sf))
    by_pairs = found.pairs().groupBy("table_name", "held_key").agg(F.count(F.lit(1)).alias("n"), F.max("similarity").alias("best"))
    assert sorted(map(tuple, found.held_rows().collect())) == sorted(map(tuple, by_pairs.collect()))


def _classes(spark, rows):
    from pyspark.sql import functions as F

    return overlap.prepare(spark.createDataFrame(rows, SCHEMA)).groupBy("table_name", "held_out", "text_id").agg(F.first("words").alias("words"))


def test_texts_of_sizes_that_cannot_pair_are_not_posted(spark):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [("t", i, "test" if i % 2 else "train", " ".join(rng.sample(vocabulary, 30 if i % 2 else 12)), "") for i in range(60)]
    classes = _classes(spark, rows)
    sent = spark.sparkContext.broadcast(overlap.frequent_words(classes))
    both, hot = overlap.shared_keys(classes, sent, overlap.SHARE)
    assert overlap.postings(classes, sent, overlap.SHARE, hot, both).count() == 0


def test_all_sizes_that_can_pair_meet():
    import numpy as np

    n = np.arange(1, 400)
    for share in (0.0, 0.3, 0.5, 0.85, 0.97, 1.0):
        train, held = ({(int(n[r]), int(s)): int(d) for r, s, d in zip(*overlap._entries(n, np.full(len(n), side), share), strict=True)} for side in (False, True))
        span = {a: s for a, s in train}
        for a in n.tolist():
            for b in n.tolist():
                need = max(int(overlap.least_common(np.array([max(a, b)]), share)[0]), 1) if a in (1, 7, 23, 130, 399) else None
                if need is not None and need <= min(a, b):
                    assert max(held[b, span[a]], train[a, span[a]]) <= need


def test_long_and_short_texts_with_changed_words(spark):
    rng = random.Random(13)
    vocabulary, rows = [f"w{i}" for i in range(900)], []
    for i, n in enumerate((1, 2, 6, 7, 20, 40, 41, 125, 130, 255, 260, 300, 600, 1200) * 4):
        base = [rng.choice(vocabulary) for _ in range(n)]
        copy = list(base)
        for _ in range(n * rng.randrange(8) // 50):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        copy = copy[rng.randrange(max(n // 12, 1)) :]
        rows += [("t", 2 * i, "train", " ".join(base), ""), ("t", 2 * i + 1, "val", " ".join(copy), "")]
    assert _found(spark, rows) == _brute(rows)


def test_the_draft_of_all_texts_is_removed(spark):
    from pyspark.sql import functions as F

    from tidemill import runtime

    rows = [("t", i, "train" if i % 3 else "test", f"text number {i // 2} of many that stand twice or once", "") for i in range(40)]
    before = {n for n, *_ in runtime.listing(spark, runtime.shared_dir(spark))} if runtime.exists(spark, runtime.shared_dir(spark)) else set()
    found = overlap.cross_split_overlap(spark.createDataFrame(rows, SCHEMA))
    names = {n for n, *_ in runtime.listing(spark, runtime.shared_dir(spark))} - before
    assert not any(n.startswith("tidemill-prepared") for n in names)
    assert any(n.startswith("tidemill-classes") for n in names)
    assert {(r["train_key"], r["held_key"]) for r in found.pairs().collect()} == {(k, k2) for _, k, k2 in _brute(rows)}
    assert found.members.agg(F.count(F.lit(1))).first()[0] == 40
