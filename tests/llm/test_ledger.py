"""Copies in other formatting: keys, batches in any order, odd rows."""

import random

from tidemill.llm.ledger import Ledger, canonical_json, canonical_key, canonical_keys, collapse, copies

ROWS = "row_no bigint, query string, answers string, tools string, hash_id string, key_hi string, copies string"
FIELDS = ("row_no", ["query", "hash_id"], ["answers", "tools"])


def _row(no, query, answers=None, tools=None, hash_id=None):
    return (no, query, answers, tools, hash_id, "x", "y")


def _pairs(spark, *batches):
    frames = [spark.createDataFrame(b, ROWS) for b in batches]
    return {(r[0], r[1]) for r in copies(*collapse(frames, *FIELDS)).collect()}


def test_what_counts_as_equal():
    key = lambda q, a=None: canonical_key([q], [a])
    assert key("Hello,  World!") == key("hello\u200b world") == key("> HELLO\u2003world…")
    assert key("café") == key("cafe\u0301")
    assert key(None) != key("") == key(" - ")
    assert canonical_json('{"b": 1, "a": [1, {"d": 2, "c": "x"}]}') == canonical_json('{"a":[1,{"c":"x","d":2}],"b":1}')
    assert canonical_json('{"a": [1, 2]}') != canonical_json('{"a": [2, 1]}')
    assert canonical_json('{"a": 1.50}') != canonical_json('{"a": 1.5}')
    assert canonical_json('"{\\"a\\": 1, \\"b\\": 2}"') == canonical_json('{"b": 2, "a": 1}')
    assert canonical_json("[broken") == "broken"
    assert canonical_json("[" * 50_000) == ""
    assert canonical_json('{"É": "ß"}') == canonical_json('{"e\u0301": "SS"}')


def test_batches_give_what_one_batch_gives(spark):
    rng = random.Random(5)
    rows = [_row(i, rng.choice(["a b", "A, B", "c", "C!", None, "", "d e f"]), rng.choice(['{"x":1,"y":2}', '{ "y": 2, "x": 1 }', None])) for i in range(200)]
    rng.shuffle(rows)
    assert _pairs(spark, rows) == _pairs(spark, rows[:50], rows[50:120], [], rows[120:]) == _pairs(spark, rows[120:], rows[:120])
    ledger, _ = collapse([spark.createDataFrame(rows[:50], ROWS), spark.createDataFrame(rows[50:], ROWS)], *FIELDS)
    want = {}
    for r in rows:
        k = canonical_key([r[1], r[4]], [r[2], r[3]])
        n, least = want.get(k, (0, 10**9))
        want[k] = (n + 1, min(least, r[0]))
    assert sorted((r["copies"], r["first_id"]) for r in ledger.collect()) == sorted(want.values())


def test_nulls_and_repeats(spark):
    rows = [_row(3, None), _row(1, None), _row(2, ""), _row(None, "a"), _row(9, "A"), _row(9, "a")]
    assert _pairs(spark, rows) == {(1, 3)}


def test_hot_key(spark):
    rows = [_row(i, "same" if i % 3 else f"other {i}") for i in range(3000)]
    assert len(_pairs(spark, rows)) == 1999


def test_very_long_and_empty(spark):
    text = "word " * 200_000
    assert _pairs(spark, [_row(1, text), _row(2, text.upper())]) == {(1, 2)}
    assert _pairs(spark, []) == set()


def test_ledger_grows_without_old_rows(spark):
    first = Ledger(spark, buckets=4).add(canonical_keys(spark.createDataFrame([_row(5, "a"), _row(6, "b")], ROWS), *FIELDS))
    second = first.add(canonical_keys(spark.createDataFrame([_row(2, "A"), _row(7, "c")], ROWS), *FIELDS))
    assert sorted((r["copies"], r["first_id"]) for r in second.table().collect()) == [(1, 6), (1, 7), (2, 2)]
    assert sorted((r["copies"], r["first_id"]) for r in first.table().collect()) == [(1, 5), (1, 6)]


def test_structure_is_part_of_the_key():
    for a, b in (('{"a":"b","c":"d"}', '{"a":"bc","d":""}'), ('["ab","c"]', '["a","bc"]'), ("[[1,2],[3]]", "[[1],[2,3]]"), ('{"a":{"b":1}}', '{"a":1,"b":1}'), ("[1, 23]", "[12, 3]")):
        assert canonical_json(a) != canonical_json(b)
    assert canonical_json('{"x": 1.5}') == canonical_json('{"x": "15"}')  # signs are left aside
    assert canonical_json('{"x": [true, null, "A b!"]}') == canonical_json('{"X":[true,null,"ab"]}')


def _bucket_files(spark, ledger):
    from tidemill import runtime

    return {b: [(n, t) for n, _, _, t in runtime.listing(spark, ledger._files(b))] for b in ledger.versions}


def test_only_touched_buckets_are_written_and_old_ones_removed(spark):
    from tidemill import runtime

    keyed = lambda rows: spark.createDataFrame(rows, "id bigint, key_hi bigint, key_lo bigint")
    first = Ledger(spark, buckets=4).add(keyed([(i, i, 0) for i in range(8)]))
    before = _bucket_files(spark, first)
    second = first.add(keyed([(100, 1, 0), (101, 5, 7)]))
    after = _bucket_files(spark, second)
    assert {b for b in after if after[b] != before[b]} == {1} and second.versions == {0: 1, 1: 2, 2: 1, 3: 1}
    assert second.keys == 9 and sorted((r["key_hi"], r["copies"], r["first_id"]) for r in second.table([1]).collect()) == [(1, 2, 1), (5, 1, 5), (5, 1, 101)]
    second.forget_old()
    assert not runtime.exists(spark, first._files(1)) and _bucket_files(spark, second) == after
    again = Ledger.opened(spark, second.path)
    assert again.versions == second.versions and again.table().count() == 9


def test_buckets_split_when_they_are_full(spark, monkeypatch):
    from tidemill.llm import ledger as module

    monkeypatch.setattr(module, "KEYS_A_BUCKET", 10)
    monkeypatch.setattr(module, "LEAST_BUCKETS", 1)
    keyed = lambda ids: spark.createDataFrame([(i, i, 0) for i in ids], "id bigint, key_hi bigint, key_lo bigint")
    now = Ledger(spark).add(keyed(range(5)))
    assert now.buckets == 1
    now = now.add(keyed(range(30)))
    now = now.add(keyed([1]))
    assert now.buckets == 2 and now.keys == 30 and len(now.versions) == 2
    assert {r["key_hi"]: r["copies"] for r in now.table().collect()} == {i: 3 if i == 1 else 2 if i < 5 else 1 for i in range(30)}
