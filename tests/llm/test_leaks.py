"""Leaked passages: against a plain search, under noise, on odd rows."""

import random

from tidemill.llm import leaks

DOCS = "doc_id bigint, text string, item_id bigint"
ITEMS = "item_id bigint, context string, doc_id string"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "tu", "re", "sho", "vel", "dra") for b in ("ven", "tor", "gla", "hu", "zel", "pa", "bri", "qui")]


def _passage(rng, n):
    return [rng.choice(VOCABULARY) for _ in range(n)]


def _run(spark, docs, items, **more):
    found = leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_planted_passages_are_found_and_short_quotes_are_not(spark):
    rng = random.Random(6)
    items = [(i, " ".join(_passage(rng, rng.randrange(30, 80))), "x") for i in range(40)]
    docs, want = [], set()
    for d in range(200):
        words = _passage(rng, rng.randrange(40, 200))
        item, context, _ = rng.choice(items)
        passage = context.split()
        share = rng.choice((0.0, 0.2, 0.6, 0.8, 1.0))
        n = round(share * len(passage))
        start = rng.randrange(len(passage) - n + 1)
        piece = passage[start : start + n]
        if n > 20 and rng.random() < 0.5:
            piece[rng.randrange(n)] = "quickly"
        text = " ".join(words[:30]) + ".\n<p>" + "\n".join(" ".join(piece[i : i + 9]).upper() if d % 2 else ", ".join(piece[i : i + 9]) for i in range(0, n, 9)) + "</p> **" + " ".join(words[30:])
        docs.append((d, text, 0))
        if share >= 0.6:
            want.add((d, item))
    assert _run(spark, docs, items) == want
    assert _run(spark, docs, items, broadcast_chars=3000) == want


def test_alignment_stays_in_the_band():
    index = leaks.ItemIndex([(1, leaks.normalized("alpha beta gamma delta epsilon zeta eta theta iota kappa"))])
    import numpy as np

    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    at = np.array([sum(len(w) + 1 for w in words[:i]) for i in range(len(words))])
    assert index.aligned(0, words, at, 0, leaks.BAND - 1) == 10
    assert index.aligned(0, words, at + 10_000, 0, leaks.BAND - 1) == 0


def test_odd_rows(spark):
    context = "one two three four five six seven eight nine ten eleven twelve thirteen"
    items = [(1, context, "a"), (2, None, "a"), (3, "", "a"), (4, "!!", "a"), (None, context, "a"), (5, context, "a"), (6, "word", "a")]
    docs = [(1, None, 0), (2, "", 0), (3, " \u200b", 0), (4, context, 0), (4, context, 0), (5, "x " * 300_000 + context.upper() + " y" * 10, 0), (None, context, 0), (6, "word", 0)]
    found = leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found) == sorted([(4, 1), (4, 5), (4, 1), (4, 5), (5, 1), (5, 5), (0, 1), (0, 5)])


def test_empty_tables(spark):
    assert _run(spark, [], [(1, "a b c d e f g h i j k", "")]) == set()
    assert _run(spark, [(1, "a b c d e f g h i j k", 0)], []) == set()


def test_short_items_and_scripts_without_spaces(spark):
    chinese = "春天的花园里有许多红色的小花开了"
    items = [(1, "red apple", ""), (2, "who won it", ""), (3, chinese, ""), (4, "สวัสดีครับ", ""), (5, "one of the seven short stories", "")]
    docs = [
        (1, "She ate a red, apple and left.", 0), (2, "Nobody knows Who won it!", 0), (3, "书上说，" + chinese + "。", 0), (4, chinese[:9] + "别的", 0), (5, chinese[:5] + "别的", 0), (6, "red green apple", 0), (7, "สวัสดีครับ", 0),
        (8, "there are the seven short stories here", 0), (9, "the seven", 0), (10, "the wordred apple", 0),
    ]
    assert _run(spark, docs, items) == {(1, 1), (2, 2), (3, 3), (4, 3), (7, 4), (8, 5)}
    assert _run(spark, docs, items, broadcast_chars=20) == {(1, 1), (2, 2), (3, 3), (4, 3), (7, 4), (8, 5)}


def test_many_items_with_one_stem():
    import time

    rng = random.Random(7)
    stem = "which of the following statements about the matter in hand is the right one"
    for tail, most in ((20, 0.3), (10, 3.0)):  # a stem of less and of more than half of the words
        index = leaks.ItemIndex([(i, f"{stem} {' '.join(_passage(rng, tail))}".split()) for i in range(6000)])
        text = ((stem + " ") * 32).split()
        start = time.perf_counter()
        found = list(index.found([text]))
        assert time.perf_counter() - start < most
        assert len(found) == (6000 if tail == 10 else 0)
        assert 17 in {i for _, i, _ in index.found([text + index.words[17]])}


def test_hot_grams_lose_nothing(monkeypatch):
    rng = random.Random(8)
    stem = "consider the long passage that follows and choose what fits it best"
    items = [(i, f"{stem} {' '.join(_passage(rng, 12))}".split()) for i in range(40)]
    docs = []
    for _ in range(60):
        w = list(rng.choice(items)[1])
        cut = rng.randrange(len(w) // 2)
        docs.append(_passage(rng, 20) + w[cut:] + _passage(rng, 20))
    got = []
    for hot in (2, 10**9):
        monkeypatch.setattr(leaks, "HOT_ITEMS", hot)
        got.append(sorted(leaks.ItemIndex(items).found(docs)))
    assert got[0] == got[1] and got[0]


def _rows(spark, docs, items, **more):
    return sorted(tuple(r) for r in leaks.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more).collect())


def test_both_plans_give_the_same_rows(spark):
    rng = random.Random(9)
    stem = "consider the long passage that follows and choose what fits it best"
    texts = [_passage(rng, rng.randrange(9, 14)) for _ in range(150)] + [stem.split() + _passage(rng, rng.randrange(4, 16)) for _ in range(80)] + [["kaven", "lotor", "migla"] * 5]
    docs = []
    for d in range(450):
        w = list(rng.choice(texts))
        kept = set(range(at := rng.randrange(len(w) - 1), at + 2)) | set(rng.sample(range(len(w)), (len(w) + 1) // 2))
        docs.append((d, " ".join(_passage(rng, 6) + [x if i in kept else "u" * rng.randrange(5, 8) for i, x in enumerate(w)] + _passage(rng, 6)), 0))
    docs.append((999, "kaven lotor " * 40, 0))
    items = [(i, " ".join(w), "") for i, w in enumerate(texts)]
    sent, met = _rows(spark, docs, items), _rows(spark, docs, items, broadcast_chars=1_000)
    assert len(sent) > 100 and met == sent


def test_rows_of_an_item_do_not_depend_on_other_items(monkeypatch):
    monkeypatch.setattr(leaks, "HOT_ITEMS", 2)
    item = "kaven lotor migla tuhu rezel shopa velbri draqui mihu katotor retor logla".split()
    docs = [("kaven lotor " * n + "x tuhu yy shopa zz draqui xx katotor y logla").split() for n in range(1, 9)]
    others = [(i, f"{x} velbri draqui {x}".split()) for i, x in enumerate(VOCABULARY[:9], 1)]
    alone, among = (sorted(f for f in leaks.ItemIndex(items).found(docs) if f[1] == 0) for items in ([(0, item)], [(0, item), *others]))
    assert alone == among
    assert [(0, 0, len(item))] == [f for f in leaks.ItemIndex([(0, item), *others]).found([item]) if f[1] == 0]
