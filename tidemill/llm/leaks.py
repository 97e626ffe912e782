"""Evaluation passages in corpus documents: q-gram lemma filter over diagonal bands, then banded alignment.

An item that stands in a document with few edits shares many of its character q-grams with it, all near one diagonal
(document position minus item position): a region of length m with e edits keeps at least m + 1 - q - q*e of them (q-gram
lemma). Documents are read in Arrow batches and all q-grams of a slice hashed at once. Distinct shared q-grams are counted per
document and item first; a q-gram of very many items (a common stem) is counted for those items only that could reach their
bound by such q-grams alone. Pairs that may reach the bound, and whose document has enough of the item's words at all, get
their hits counted in overlapping diagonal bands; bands that meet the bound are aligned word by word, within the band, and
that decides. In scripts without spaces every character is a word.

Items too short for the lemma (their bound is below two q-grams) are looked for as runs of words: one that stands in the
document word for word. The rest of their search is the same.

Equal items are one class. Classes whose texts hold BROADCAST_CHARS or less go to every task and the corpus is read once, in
its place, without a shuffle. More of them stay a table: documents are read once with a Bloom filter of fixed size over the
items' q-grams, and documents and classes meet in a shuffle by q-gram; each pair that shares as many distinct ones as the
first plan asks for then passes the same filter and alignment. What is asked of a pair depends on its item and document alone,
so both plans give the same rows.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.normalize import words
from tidemill.llm import bloom
from tidemill.runtime import spread, written

Q = 10
BAND = 96
#: An edit (a changed word) is allowed for so many characters of a passage.
CHARS_PER_EDIT = 22
#: The share of an item's words that must stand in a document.
SHARE = 0.5
#: Short items must stand with so many words in a row, or wholly; one word alone is no passage.
SHORT_RUN, SHORTEST = 4, 2
#: Item texts up to so many characters in all go to every task; more are joined by a shuffle.
BROADCAST_CHARS = 16_000_000
SLICE_CHARS = 1_000_000
#: A q-gram of more items than this is counted last; and so many counts are held at once.
HOT_ITEMS, HELD = 64, 4_000_000
_TAG = re.compile(r"<[^<>\n]{1,200}>")
_ENTITY = re.compile(r"&(?:#\d{1,6}|[a-z]{2,8});")
#: Scripts that write no spaces between words, as fixed values: Thai, Lao, Myanmar, Khmer, Japanese and Chinese.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿々-〇぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
_TABLE_BITS = 26
_NONE = np.zeros(0, np.int64)


def normalized(text: str | None) -> list[str]:
    """A text's words without markup, folded; in scripts without spaces its characters."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if not text.isascii():
        text = _UNSPACED.sub(r" \g<0> ", text)
    return words(text)


def _grams(text: str) -> np.ndarray:
    """Hash of the q-gram at each position."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(codes) < Q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(codes) - Q + 1, np.uint64)
    for i in range(Q):
        h = (h ^ codes[i : len(h) + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def lemma_bound(chars: int) -> int:
    """q-grams that half an item of so many characters keeps under the edit budget, by the lemma; none or less tell nothing."""
    m = SHARE * chars
    edits = max(1.0, m / CHARS_PER_EDIT)
    return int(m + 1 - Q - Q * edits - edits)


def least_grams(chars: int) -> int:
    return max(2, lemma_bound(chars))


def least_distinct(chars: int, repeats: int) -> int:
    """Distinct q-grams that must be shared with an item of so many characters, so many of whose q-grams repeat others."""
    return max(least_grams(chars) - repeats, 1)


def short_run(n_words: int) -> int:
    """Words in a row of a short item that are enough."""
    return max(math.ceil(SHARE * n_words), min(n_words, SHORT_RUN))


def _word_starts(split: list[str]) -> np.ndarray:
    return np.array([0, *accumulate(len(x) + 1 for x in split)][:-1], np.int64)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n times for each."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else _NONE


class ItemIndex:
    """The q-grams of items, sorted by hash, with the items each is in."""

    def __init__(self, items: list[tuple[object, list[str]]]) -> None:
        self.ids = [k for k, _ in items]
        self.words = [w for _, w in items]
        texts = [" ".join(w) for w in self.words]
        self.least = np.array([least_grams(len(t)) for t in texts], np.int64)
        self.enough = np.array([SHARE * len(w) for w in self.words])
        self.grams = [_grams(t) for t in texts]
        flat = np.concatenate(self.grams) if items else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(g) for g in self.grams])
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]) if len(flat) else np.zeros(0, bool)
        once, self.owner = flat[new], owner[new].astype(np.int32)
        self.unique, self.first, self.count = np.unique(once, return_index=True, return_counts=True)
        self.low_bits = np.uint64((1 << min(max(len(flat).bit_length() + 4, 10), _TABLE_BITS)) - 1)
        self.seen = np.zeros(int(self.low_bits) + 1, bool)
        self.seen[self.unique & self.low_bits] = True
        # distinct q-grams an item must share: a q-gram that stands in it twice may be one of those counted
        distinct = np.bincount(self.owner, minlength=len(items))
        need = np.array([least_distinct(len(t), len(g) - d) for t, g, d in zip(texts, self.grams, distinct.tolist(), strict=True)], np.int64)
        self.hot = self.count > HOT_ITEMS
        hot_in = np.bincount(self.owner[np.repeat(self.hot, self.count)], minlength=len(items))
        self.need, self.need_rare = need, need - hot_in
        self.lenient = (self.need_rare > 0) & (hot_in > 0)
        # hot q-grams are counted for items only that could reach their bound by them
        by_hot = np.flatnonzero(np.repeat(self.hot, self.count) & (self.need_rare <= 0)[self.owner])
        self.hot_owner = self.owner[by_hot]
        self.hot_first = np.searchsorted(by_hot, self.first)
        self.hot_count = np.searchsorted(by_hot, self.first + self.count) - self.hot_first
        self.code: dict[str, int] = {}
        self.coded = [np.array([self.code.setdefault(x, len(self.code)) for x in w], np.int64) for w in self.words]
        self.present = np.zeros(len(self.code), bool)
        self._masks: dict[int, tuple[np.ndarray, dict[str, int]]] = {}
        self.runs = self._automaton([i for i, t in enumerate(texts) if t and lemma_bound(len(t)) < 2])

    def _automaton(self, short: list[int]):
        """Finds the runs of short items in a text; None without short items."""
        if not short:
            return None
        import ahocorasick

        found: dict[str, set[int]] = {}
        for i in short:
            w = self.words[i]
            n = short_run(len(w))
            for at in range(len(w) - n + 1):
                found.setdefault(" " + " ".join(w[at : at + n]) + " ", set()).add(i)
        runs = ahocorasick.Automaton()
        for run, owners in found.items():
            runs.add_word(run, sorted(owners))
        runs.make_automaton()
        return runs

    def _counted(self, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Pairs, as document * items + item, that share enough distinct q-grams; doc and gram are sorted and distinct."""
        counts = [np.where(self.hot[gram], 0, self.count[gram]), self.hot_count[gram]]
        pairs = [np.repeat(doc, n) * len(self.ids) + owner[_ranges(first[gram], n)] for n, owner, first in zip(counts, (self.owner, self.hot_owner), (self.first, self.hot_first), strict=True)]
        every, n = np.unique(np.concatenate(pairs), return_counts=True)
        item = every % len(self.ids)
        return every[n >= np.where(self.need_rare[item] > 0, self.need_rare[item], self.need[item])]

    def candidates(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (document, item) of joined documents with hashes h that may reach the item's bound."""
        if not len(h) or not len(self.unique):
            return _NONE, _NONE
        at = np.flatnonzero(self.seen[h & self.low_bits])
        where = np.minimum(np.searchsorted(self.unique, h[at]), len(self.unique) - 1)
        true = self.unique[where] == h[at]
        doc = np.searchsorted(starts, at[true], side="right") - 1
        key = np.unique(doc * len(self.unique) + where[true])
        doc, gram = key // len(self.unique), key % len(self.unique)
        # in parts of whole documents, so that few counts are held at a time
        size = np.cumsum(np.where(self.hot[gram], self.hot_count[gram], self.count[gram]))
        found, start = [], 0
        while start < len(doc):
            stop = int(np.searchsorted(size, (size[start - 1] if start else 0) + HELD, side="right"))
            stop = int(np.searchsorted(doc, doc[min(stop, len(doc) - 1)])) if stop < len(doc) else stop
            if stop <= start:
                stop = int(np.searchsorted(doc, doc[start], side="right"))
            found.append(self._counted(doc[start:stop], gram[start:stop]))
            start = stop
        pairs = np.concatenate(found) if found else _NONE
        return pairs // len(self.ids), pairs % len(self.ids)

    def with_words(self, doc_words: list[str], items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the items those of which a document has enough words at all, in whatever place; and how many."""
        codes = [c for w in set(doc_words) if (c := self.code.get(w)) is not None]
        self.present[codes] = True
        sizes = np.array([len(self.coded[i]) for i in items])
        has = np.add.reduceat(self.present[np.concatenate([self.coded[i] for i in items])], np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
        self.present[codes] = False
        enough = has >= self.enough[items]
        return items[enough], has[enough]

    def bands(self, item: int, h: np.ndarray) -> list[int]:
        """First diagonals of the bands of a document, with hashes h, in which the item reaches its bound; none if it shares too few
        distinct q-grams, whatever the count by rare ones let through."""
        own = self.grams[item]
        order = np.argsort(own, kind="stable")
        low, high = (np.searchsorted(own[order], h, side=side) for side in ("left", "right"))
        n = high - low
        if self.lenient[item] and len(np.unique(h[n > 0])) < self.need[item]:
            return []
        hit = np.repeat(np.arange(len(h)), n)
        diagonal = hit - order[_ranges(low, n)]
        out = set()
        for shift in (0, BAND // 2):  # bands overlap by half; a place counts once a band
            band = (diagonal + shift + BAND * (len(own) // BAND + 1)) // BAND
            each, shared = np.unique(np.unique(band * len(h) + hit) // len(h), return_counts=True)
            out.update(((each[shared >= self.least[item]] - len(own) // BAND - 1) * BAND - shift).tolist())
        return sorted(out)

    def aligned(self, item: int, doc_words: list[str], doc_at: np.ndarray, low: int, high: int) -> int:
        """Words of the item that stand in the document in order, with word starts on diagonals low-BAND to high+BAND.

        A longest common subsequence by bit operations: a document word may only match item words inside the band.
        """
        if item not in self._masks:
            if len(self._masks) > 20_000:
                self._masks.clear()
            mask: dict[str, int] = {}
            for i, x in enumerate(self.words[item]):
                mask[x] = mask.get(x, 0) | 1 << i
            self._masks[item] = _word_starts(self.words[item]), mask
        at, masks = self._masks[item]
        lowest, highest = low - BAND, high + BAND
        start, stop = np.searchsorted(doc_at, [lowest, highest + int(at[-1]) + 1])
        from_ = np.searchsorted(at, doc_at[start:stop] - highest, side="left").tolist()
        to = np.searchsorted(at, doc_at[start:stop] - lowest, side="right").tolist()
        full = (1 << len(at)) - 1
        v = full
        for w, a, b in zip(doc_words[start:stop], from_, to, strict=True):
            mask = masks.get(w, 0)
            if mask:
                u = v & mask & ((1 << b) - (1 << a))
                if u:
                    v = ((v + u) | (v - u)) & full
        return len(at) - v.bit_count()

    def found(self, split: list[list[str]]) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared words) for documents given as their words."""
        joined = [" ".join(w) for w in split]
        starts = np.array([0, *accumulate(len(t) + Q for t in joined)][:-1], np.int64)
        h = _grams(("\n" * Q).join(joined))
        best: dict[tuple[int, int], int] = {}
        docs, items = self.candidates(h, starts)
        edges = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else _NONE
        for first, last in zip(edges, np.append(edges, len(docs))[1:], strict=True):
            doc = int(docs[first])
            likely, most = self.with_words(split[doc], items[first:last])
            if not len(likely):
                continue
            own, doc_at = h[starts[doc] : starts[doc] + max(len(joined[doc]) - Q + 1, 0)], _word_starts(split[doc])
            for item, bound in zip(likely.tolist(), most.tolist(), strict=True):
                n = 0
                for low in self.bands(item, own):
                    n = max(n, self.aligned(item, split[doc], doc_at, low, low + BAND - 1))
                    if n == bound:  # no band can have more
                        break
                if n >= self.enough[item]:
                    best[doc, item] = n
        if self.runs is not None:
            for doc, text in enumerate(joined):
                if not text:
                    continue
                for _, owners in self.runs.iter(f" {text} "):
                    for item in owners:
                        n = self._run_words(item, f" {text} ")
                        best[doc, item] = max(n, best.get((doc, item), 0))
        yield from ((doc, item, n) for (doc, item), n in best.items())

    def _run_words(self, item: int, text: str) -> int:
        """The longest run of a short item's words in a text."""
        w = self.words[item]
        return next(n for n in range(len(w), 0, -1) if any(f" {' '.join(w[at : at + n])} " in text for at in range(len(w) - n + 1)))


LEAKS = "doc_id bigint, item_id bigint, shared_words int, item_words int"
CLASSES = "class_id binary, item_id bigint, words array<string>, n_chars bigint, short boolean"


def _digest(split: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(split).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def item_classes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items with the class of those of equal words, the words, and whether they are too short for the lemma."""

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = list(map(normalized, b.column(1).to_pylist()))
            chars = [sum(map(len, w)) + max(len(w) - 1, 0) for w in split]
            columns = [pa.array(map(_digest, split), pa.binary()), b.column(0), pa.array(split, pa.list_(pa.string())), pa.array(chars, pa.int64()), pa.array([lemma_bound(c) < 2 for c in chars], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["class_id", "item_id", "words", "n_chars", "short"])

    given = items.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(classed, CLASSES).where(F.size("words") >= SHORTEST)


def _slices(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[list[str]]]]:
    start = 0
    while start < len(ids):
        split, size, stop = [], 0, start
        while stop < len(ids) and (stop == start or size < SLICE_CHARS):
            split.append(normalized(texts[stop]))
            size += len(texts[stop] or "")
            stop += 1
        yield ids[start:stop], split
        start = stop


_INDEX: dict[str, ItemIndex] = {}


def _index(key: str, classes: list[tuple[object, list[str]]]) -> ItemIndex:
    """The index of sent classes, built once in a worker."""
    if key not in _INDEX:
        _INDEX.clear()
        _INDEX[key] = ItemIndex(classes)
    return _INDEX[key]


@functools.lru_cache(maxsize=500)
def _single(item: tuple[str, ...]) -> ItemIndex:
    return ItemIndex([(b"", list(item))])


MATCHES = "doc_id bigint, class_id binary, shared_words int, item_words int"


def _batch(rows: list[tuple], id_type: pa.DataType, name: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    types = (id_type, pa.binary(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[name, "class_id", "shared_words", "item_words"])


def _sent(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Matches with few classes, which go to every task."""
    block = [(bytes(r[0]), list(r[1])) for r in classes.select("class_id", "words").collect()]
    key, sent = uuid.uuid4().hex, documents.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, sent.value)
        for b in batches:
            rows = [(ids[d], index.ids[i], n, len(index.words[i])) for ids, split in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()) for d, i, n in index.found(split)]
            yield _batch(rows, pa.int64(), "doc_id")

    return documents.mapInArrow(scan, MATCHES)


def _without_hot(seeds: DataFrame) -> DataFrame:
    """Seeds (gram, class_id, need) in which a q-gram of very many classes stands only for those that could reach their bound by such
    q-grams; the others need as many less. As in ItemIndex, no pair that reaches its bound fails by that."""
    hot = written(seeds.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ITEMS).select("gram", F.lit(True).alias("hot")), "hot")
    if hot.isEmpty():
        return seeds
    rare = F.col("need") - F.count("hot").over(Window.partitionBy("class_id"))
    told = seeds.join(hot, "gram", "left").withColumn("rare", rare).where("hot is null or rare <= 0")
    return written(told.select("gram", "class_id", F.when(F.col("rare") > 0, F.col("rare")).otherwise(F.col("need")).cast("int").alias("need")), "seeds")


def _met(documents: DataFrame, classes: DataFrame) -> DataFrame:
    """Matches with any number of classes: documents and classes meet by q-grams, then each pair is looked at."""

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [" ".join(w) for w in b.column(1).to_pylist()]
            every = list(map(_grams, texts))
            grams = list(map(np.unique, every))
            at = np.repeat(np.arange(len(grams)), list(map(len, grams)))
            need = np.array([least_distinct(len(t), len(e) - len(g)) for t, e, g in zip(texts, every, grams, strict=True)], np.int32)
            flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), b.column(0).take(pa.array(at, pa.int64())), pa.array(need[at])], names=["gram", "class_id", "need"])

    seeds = _without_hot(written(classes.select("class_id", "words").mapInArrow(seeded, "gram bigint, class_id binary, need int"), "seeds"))
    sent = documents.sparkSession.sparkContext.broadcast(bloom.build(seeds.select("gram"), seeds.count()))

    def known(g: np.ndarray) -> np.ndarray:
        return g[sent.value.known(g)]

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, split in _slices(b.column(0).to_pylist(), b.column(1).to_pylist()):
                grams = [known(np.unique(_grams(" ".join(w)))).view(np.int64).tolist() for w in split]
                rows = [(k, _digest(w), g) for k, w, g in zip(ids, split, grams, strict=True) if g]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "text_id", "grams"])

    probes = written(documents.mapInArrow(probed, "doc_id bigint, text_id binary, grams array<bigint>"), "probes")
    of_text = probes.select("text_id", "grams").dropDuplicates(["text_id"]).select("text_id", F.explode("grams").alias("gram"))
    shared = of_text.join(seeds, "gram").groupBy("text_id", "class_id").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need"))
    pairs = written(shared.where("n >= need").select("text_id", "class_id"), "pairs")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            split = list(map(normalized, b.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, split), pa.binary()), b.column(0)], names=["text_id", "text"])

    texts = documents.select("text").mapInArrow(told, "text_id binary, text string").join(pairs.select("text_id").distinct(), "text_id", "left_semi").dropDuplicates(["text_id"])
    both = pairs.join(texts, "text_id").join(classes.select("class_id", "words"), "class_id")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text_id, text, class_id, w in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                rows += [(text_id, class_id, n, len(w)) for _, _, n in _single(tuple(w)).found([normalized(text)])]
            yield _batch(rows, pa.binary(), "text_id")

    matched = both.select("text_id", "text", "class_id", "words").mapInArrow(checked, "text_id binary, class_id binary, shared_words int, item_words int")
    return probes.select("doc_id", "text_id").join(matched, "text_id").select("doc_id", "class_id", "shared_words", "item_words")


def leaks(documents: DataFrame, items: DataFrame, item_id: str = "item_id", item_text: str = "context", broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """(doc_id, item_id, shared_words, item_words): documents that hold half an item's words or more, in one place, in order.

    Items under the lemma's bound count where a run of half their words, of SHORT_RUN at least, or the whole item stands in
    the document. Null, empty and wordless documents hold nothing; items of fewer than SHORTEST words are in nothing; equal items are
    each reported; a repeated document id is reported for each of its rows that holds an item. Columns of other names are
    left out. Empty tables give an empty result. broadcast_chars changes the plan only: more item text than that is joined by
    a shuffle, and its short items are searched in further passes of so many characters each.
    """
    narrow = spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")))
    every = written(item_classes(items, item_id, item_text), "items")
    classes = every.dropDuplicates(["class_id"])
    size = classes.agg(F.sum("n_chars"), F.sum(F.when(F.col("short"), F.col("n_chars")))).first()
    if (size[0] or 0) <= broadcast_chars:
        matches = _sent(narrow, classes)
    else:
        passes = -(-(size[1] or 0) // broadcast_chars)
        part = F.pmod(F.xxhash64("class_id"), F.lit(max(passes, 1)))
        matches = _met(narrow, classes.where(~F.col("short")))
        for i in range(passes):
            matches = matches.unionByName(_sent(narrow, classes.where(F.col("short") & (part == i))))
    return matches.join(every.select("class_id", "item_id"), "class_id").select("doc_id", "item_id", "shared_words", "item_words")
