"""Same or nearly the same texts across splits: prefix filter on rare words, exact bounds, verification.

Texts are sets of words, a word's n-th occurrence being a word of its own. Words are ordered from rare to frequent. Two texts
with so many words in common that they can be a pair share one among their first few, the prefix; so each text is posted under
the words of its prefix, and texts of different splits under the same word are candidates. A key is such a word and a range of
sizes: a train text is posted under the range its own size is in, a held-out one under each that a partner's size can be in. A
Bloom filter of the keys that both sides post keeps back all other postings before they are shuffled. A key with very many
candidates is split by the next word both must share, as often as needed. Size, position in the order and a fingerprint bound
what candidates can have in common: bits that are each the parity of the words that fall on them, so that two texts'
fingerprints differ in no more bits than the texts do in words, and the Hamming radius follows from the sizes; as many as the
sizes of the key call for, PRINT_BITS at most, are checked where postings meet, and for longer texts as many as they are long
before words are compared. A longest common subsequence of their words decides.
Each bound is one that no pair fails, so all pairs are found. Exact copies are one class from the start: only one of each
class and side is posted. The result is links between classes, with the number of rows of each, and the classes' members; it
is expanded to pairs of rows only where pairs are asked for, so a text that holds a third of all rows fills no posting.
"""

from __future__ import annotations

import functools
import hashlib
import math
import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.normalize import words
from tidemill.llm import bloom
from tidemill.llm.bloom import Bloom
from tidemill.runtime import new_path, remove, spread, written

SHARE = 0.85
#: The order of words by frequency has those that hold 1/MAX_FREQUENT of all words; rarer ones come before, in any order.
MAX_FREQUENT = 200_000
#: A key of more possible pairs is split, but at most MAX_HOT at a time and MAX_SPLITS times; the others are joined as they are.
HOT_PAIRS, MAX_HOT, MAX_SPLITS = 10_000, 50_000, 2
#: Nor is a key split of HOT_PAIRS / this many pairs a posting or less: posting them all under further words costs more than comparing them.
HOT_POSTINGS = 40
_CACHE: dict[str, int] = {}

PREPARED = "table_name string, row_key bigint, held_out boolean, text_id bigint, words array<int>"
#: Bits of the fingerprint that postings carry, at least and at most, and bits a word; and bits a word of own fingerprints.
LEAST_BITS, PRINT_BITS, BITS_A_WORD, OWN_BITS_A_WORD = 64, 512, 4, 2
_PARITIES = [f"parity_{i}" for i in range(PRINT_BITS // 64)]
POSTED = f"text_id bigint, held_out boolean, n_words int, rest int, {', '.join(f'{p} bigint' for p in _PARITIES)}, key bigint"


def _hash64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def word_code(word: str) -> int:
    """A word as 32 bits, the same in every process."""
    code = _CACHE.get(word)
    if code is None:
        if len(_CACHE) > 300_000:
            _CACHE.clear()
        code = _CACHE[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little", signed=True)
    return code


def prepare(texts: DataFrame) -> DataFrame:
    """Rows (table_name, row_key, split, text) as word codes; text_id is the same for equal texts of a table.

    Rows without words or with a null key or split are in no pair.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [np.fromiter(map(word_code, words(t)), np.int32) for t in b.column(3).to_pylist()]
            ids = [_hash64(c.tobytes() + (name or "").encode()) for c, name in zip(codes, b.column(0).to_pylist(), strict=True)]
            offsets = np.cumsum([0, *map(len, codes)], dtype=np.int32)
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(ids, pa.int64()), arrays], names=["table_name", "row_key", "held_out", "text_id", "words"])

    narrow = texts.where(F.col("row_key").isNotNull() & F.col("split").isin("train", "val", "test") & F.col("text").isNotNull())
    narrow = narrow.select("table_name", F.col("row_key").cast("bigint").alias("row_key"), (F.col("split") != "train").alias("held_out"), "text")
    return spread(narrow).mapInArrow(coded, PREPARED).where(F.size("words") > 0)


def _flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and values of a list column."""
    offsets = array.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], array.values.to_numpy()[offsets[0] : offsets[-1]]


def features(offsets: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Each word with the number of times it came before in its text, as 32 bits: so repeated words count like distinct ones."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    key = rows << 32 | codes.view(np.uint32).astype(np.int64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.empty(len(key), np.int64)
    times[order] = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key))))
    return (codes.view(np.uint32) + times.astype(np.uint32) * np.uint32(0x9E3779B1)).astype(np.uint32)


def frequent_words(prepared: DataFrame) -> np.ndarray:
    """The frequent words, from the rarest on, by the number of texts each is in."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for b in batches:
            offsets, codes = _flat(b.column(0))
            for code, count in zip(*(x.tolist() for x in np.unique(features(offsets, codes), return_counts=True)), strict=True):
                total[code] = total.get(code, 0) + count
            if len(total) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(total.values(), pa.int64())], names=["code", "n"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(total.values(), pa.int64())], names=["code", "n"])

    counts = written(prepared.select("words").mapInArrow(counted, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")), "words")
    bar = max((counts.agg(F.sum("n")).first()[0] or 0) / MAX_FREQUENT, 2)
    found = counts.where(F.col("n") >= bar).collect()
    return np.array([code for _, code in sorted((r["n"], r["code"]) for r in found)], np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 pseudo-random bits for each value."""
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def ordered_words(offsets: np.ndarray, codes: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Each text's words from rare to frequent: rare ones as pseudo-random numbers below 2**32, frequent ones as 2**32 and their place."""
    plain = features(offsets, codes).astype(np.int64)
    place = plain * 0x9E3779B1 & 0xFFFFFFFF
    if len(frequent):
        by_code = np.argsort(frequent)
        at = np.minimum(np.searchsorted(frequent[by_code], plain), len(frequent) - 1)
        place = np.where(frequent[by_code][at] == plain, by_code[at] + (1 << 32), place)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    return np.sort(rows << 34 | place) & (1 << 34) - 1


def least_common(n: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(share * n - 1e-9).astype(np.int64)


@functools.cache
def size_ranges(share: float) -> np.ndarray:
    """The least size of each range of sizes, the same for all texts; a range spans about as much as partners' sizes may differ."""
    least, factor = [1], 1 / min(max(share, 0.1), 0.9)
    while least[-1] < 1 << 31:
        least.append(max(least[-1] + 1, math.ceil(least[-1] * factor)))
    return np.array(least, np.int64)


def _entries(n: np.ndarray, held: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, range of sizes, and words a pair must have in common, for each range a text of n words is posted under.

    A train text has its own size's; a held-out one all that partners' sizes can be in, and a partner of at least a range's least
    size may ask for more words than the text itself does."""
    least = size_ranges(share)
    own = np.searchsorted(least, n, side="right") - 1
    need = np.maximum(least_common(n, share), 1)
    first = np.where(held, np.searchsorted(least, need, side="right") - 1, own)
    last = np.where(held, np.searchsorted(np.maximum(least_common(least, share), 1), n, side="right") - 1, own)
    more = last - first + 1
    row = np.repeat(np.arange(len(n)), more)
    span = np.repeat(first, more) + np.arange(len(row)) - np.repeat(np.cumsum(more) - more, more)
    return row, span, np.maximum(need[row], np.where(held[row], least_common(least[span], share), 0))


def _postings(offsets: np.ndarray, ordered: np.ndarray, tables: np.ndarray, held: np.ndarray, share: float, hot: list[np.ndarray], both: Bloom | None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, ranges of sizes, words left from the last shared one on, and keys, for each number of words in a key. hot has the keys to
    split, sorted.

    A text of n words that needs t in common with another has the d-th word they share among its first n - t + d. Keys of one
    word that both doesn't know are left out.
    """
    row, span, need = _entries(np.diff(offsets), held, share)
    n = np.diff(offsets)[row]
    out = []
    # at: which of the entries
    at, last, key = np.arange(len(row)), np.full(len(row), -1, np.int64), _mixed(_mixed(tables)[row] ^ span.astype(np.uint64))
    for depth in range(1, len(hot) + 2):
        more = np.maximum(np.minimum(n, n - need + depth)[at] - last - 1, 0)
        at, first, key = np.repeat(at, more), np.repeat(last + 1, more), np.repeat(key, more)
        last = first + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
        key = _mixed(key ^ ordered[offsets[row[at]] + last].astype(np.uint64))
        if both is not None and depth == 1:
            known = both.known(key)
            at, last, key = at[known], last[known], key[known]
        split = np.zeros(len(key), bool)
        if depth <= len(hot) and len(hot[depth - 1]):
            signed = key.view(np.int64)
            place = np.minimum(np.searchsorted(hot[depth - 1], signed), len(hot[depth - 1]) - 1)
            split = hot[depth - 1][place] == signed
        stay = ~split | (need[at] <= depth)  # no further word may be shared
        out.append((row[at[stay]], span[at[stay]], (n[at] - last + depth - 1)[stay], key[stay].view(np.int64)))
        at, last, key = at[split], last[split], key[split]
    return out


def fingerprints(offsets: np.ndarray, ordered: np.ndarray, bits: int) -> np.ndarray:
    """For each text a row of 64-bit words, each bit the parity of the number of words that fall on it: as many bits differ as words do, at most.

    bits is a power of two; half the fingerprint is both halves of the whole, one upon the other."""
    n = len(offsets) - 1
    at = (_mixed(ordered) & np.uint64(bits - 1)).astype(np.int64) + np.repeat(np.arange(n, dtype=np.int64) * bits, np.diff(offsets))
    odd = np.bincount(at, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.uint64).reshape(n, bits // 64)


def posted_prints(prints: np.ndarray, row: np.ndarray, span: np.ndarray, share: float) -> np.ndarray:
    """For each posting its row's fingerprint, folded to as many bits as its range of sizes calls for; then zeros."""
    wide = np.log2(BITS_A_WORD * size_ranges(share)[span])
    bits = np.clip(1 << np.ceil(wide).astype(np.int64), LEAST_BITS, PRINT_BITS)
    out = np.zeros((len(row), PRINT_BITS // 64), np.uint64)
    while True:
        at = np.flatnonzero(bits == prints.shape[1] * 64)
        out[at, : prints.shape[1]] = prints[row[at]]
        if prints.shape[1] * 64 <= LEAST_BITS:
            return out
        prints = prints[:, : prints.shape[1] // 2] ^ prints[:, prints.shape[1] // 2 :]


def _keyed(b: pa.RecordBatch, frequent: np.ndarray, share: float, hot: list[np.ndarray], both: Bloom | None, from_depth: int) -> tuple[np.ndarray, ...]:
    """Offsets, words in order, and rows, ranges, words left and keys of the postings of classes (table_name, text_id, held_out, words)."""
    offsets, codes = _flat(b.column(3))
    ordered = ordered_words(offsets, codes, frequent)
    tables = np.array([_hash64((x or "").encode()) for x in b.column(0).to_pylist()], np.int64)
    held = b.column(2).to_numpy(zero_copy_only=False)
    return offsets, ordered, *(np.concatenate(x) for x in zip(*_postings(offsets, ordered, tables, held, share, hot, both)[from_depth:], strict=True))


def postings(classes: DataFrame, frequent, share: float, hot: list[np.ndarray], both) -> DataFrame:
    """Every key a class (table_name, text_id, held_out, words) is posted under, if both sides may have it."""

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                b = whole.slice(start, 2000)
                offsets, ordered, row, span, rest, key = _keyed(b, frequent.value, share, hot, both.value, 0)
                at = pa.array(row)
                prints = posted_prints(fingerprints(offsets, ordered, PRINT_BITS), row, span, share)
                yield pa.RecordBatch.from_arrays([b.column(1).take(at), b.column(2).take(at), pa.array(np.diff(offsets)[row], pa.int32()), pa.array(rest, pa.int32()), *map(pa.array, prints.view(np.int64).T), pa.array(key)], names=["text_id", "held_out", "n_words", "rest", *_PARITIES, "key"])

    return classes.select("table_name", "text_id", "held_out", "words").mapInArrow(posted, POSTED)


def posted_keys(classes: DataFrame, frequent, share: float, hot: list[np.ndarray], both=None) -> DataFrame:
    """(key, held, train): how many classes of each side are posted under the keys of most words."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 8000):
                b = whole.slice(start, 8000)
                row, key = (_keyed(b, frequent.value, share, hot, both.value if both else None, len(hot))[i] for i in (2, 5))
                held = b.column(2).to_numpy(zero_copy_only=False)[row]
                every, at = np.unique(key, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(every, pa.int64()), pa.array(np.bincount(at, held, len(every)).astype(np.int64)), pa.array(np.bincount(at, ~held, len(every)).astype(np.int64))], names=["key", "held", "train"])

    own = classes.select("table_name", "text_id", "held_out", "words").mapInArrow(counted, "key bigint, held bigint, train bigint")
    return own.groupBy("key").agg(F.sum("held").alias("held"), F.sum("train").alias("train"))


def _hottest(keys: DataFrame) -> np.ndarray | None:
    many = (F.col("pairs") > HOT_PAIRS) & (F.col("pairs") > HOT_PAIRS / HOT_POSTINGS * (F.col("held") + F.col("train")))
    most = keys.withColumn("pairs", F.col("held") * F.col("train")).where(many).select("key", "pairs").orderBy(F.desc("pairs"), "key").limit(MAX_HOT).collect()
    return np.array(sorted(r["key"] for r in most), np.int64) if most else None


def shared_keys(classes: DataFrame, frequent, share: float):
    """A filter, sent to the tasks, of the one-word keys that both sides post, and the keys to split for each number of words.

    The held-out side's keys are a filter for the train side's, so that keys of one side only are hardly ever shuffled."""
    context = classes.sparkSession.sparkContext
    held = written(posted_keys(classes.where("held_out"), frequent, share, []).select("key"), "held-keys")
    asked = context.broadcast(bloom.build(held, held.count()))
    keys = written(posted_keys(classes, frequent, share, [], asked).where("held > 0 and train > 0"), "keys")
    both = context.broadcast(bloom.build(keys.select("key"), keys.count()))
    asked.unpersist()
    hot: list[np.ndarray] = []
    while len(hot) < MAX_SPLITS and (most := _hottest(keys)) is not None:
        hot.append(most)
        if len(hot) < MAX_SPLITS:
            keys = posted_keys(classes, frequent, share, hot, both)
    return both, hot


def own_prints(classes: DataFrame) -> DataFrame:
    """(text_id, held_out, n_words, print): each class's fingerprint of about OWN_BITS_A_WORD bits a word, PRINT_BITS at least."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, codes = _flat(b.column(2))
            plain, n = features(offsets, codes).astype(np.int64), np.diff(offsets)
            bits = np.maximum(PRINT_BITS, 1 << np.ceil(np.log2(OWN_BITS_A_WORD * np.maximum(n, 1))).astype(np.int64))
            prints: list[bytes] = [b""] * len(n)
            for width in np.unique(bits).tolist():  # texts of one width at a time
                rows = np.flatnonzero(bits == width)
                own = plain[np.repeat(bits == width, n)]
                for i, row in zip(rows.tolist(), fingerprints(np.concatenate([[0], np.cumsum(n[rows])]), own, width), strict=True):
                    prints[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(prints, pa.binary())], names=["text_id", "held_out", "n_words", "print"])

    return classes.select("text_id", "held_out", "words").mapInArrow(printed, "text_id bigint, held_out boolean, n_words int, print binary")


def within_radius(a: bytes, b: bytes, radius: int) -> bool:
    """Whether two fingerprints differ in at most so many bits; the longer one is folded to the length of the other."""
    x, y = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= radius


def _near_prints(pairs: DataFrame, share: float) -> DataFrame:
    """Pairs (train_id, held_id) with sizes and fingerprints: those that differ no more than the sizes allow."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = np.stack([b.column(i).to_numpy().astype(np.int64) for i in (2, 3)])
            radius = (n.sum(axis=0) - 2 * least_common(n.max(axis=0, initial=0), share)).tolist()
            keep = [i for i, (x, y, r) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), radius, strict=True)) if within_radius(x, y, r)]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["train_id", "held_id"])

    return pairs.select("train_id", "held_id", "train_n_words", "held_n_words", "train_print", "held_print").mapInArrow(near, "train_id bigint, held_id bigint")


def _sent(ids: DataFrame):
    """A filter of the only column of ids, sent to the tasks."""
    return ids.sparkSession.sparkContext.broadcast(bloom.build(ids, ids.count()))


def _known(classes: DataFrame, sent, known: bool = True) -> DataFrame:
    """The classes whose text_id the filter knows, so that no others are shuffled; or those it doesn't know."""
    place = classes.columns.index("text_id")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.known(b.column(place).to_numpy()) == known))

    return classes.mapInArrow(kept, classes.schema)


def candidate_pairs(classes: DataFrame, frequent: np.ndarray, share: float) -> DataFrame:
    """Different texts (train_id, held_id) that can have enough words in common."""
    sent = classes.sparkSession.sparkContext.broadcast(frequent)
    both, hot = shared_keys(classes, sent, share)
    posted = postings(classes, sent, share, hot, both)
    side = lambda held_out, name: posted.where(F.col("held_out") == held_out).select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("text_id", "n_words", "rest", *_PARITIES)))
    need = F.ceil(F.greatest("train_n_words", "held_n_words") * F.lit(share) - F.lit(1e-9))
    apart = functools.reduce(operator.add, (F.bit_count(F.col(f"train_{p}").bitwiseXOR(F.col(f"held_{p}"))) for p in _PARITIES))
    met = side(False, "train").join(side(True, "held"), "key").where("train_text_id <> held_text_id")
    met = met.where((F.least("train_rest", "held_rest") >= need) & (apart <= F.col("train_n_words") + F.col("held_n_words") - 2 * need))
    # the fingerprints of postings are as wide as own ones where both texts are short
    wide = F.greatest("train_n_words", "held_n_words") * OWN_BITS_A_WORD > PRINT_BITS
    pairs = written(met.select(F.col("train_text_id").alias("train_id"), F.col("held_text_id").alias("held_id"), wide.alias("wide")).distinct(), "pairs")
    far = pairs.where("wide")
    ids = far.select(F.explode(F.array("train_id", "held_id")).alias("id")).distinct()
    prints = written(own_prints(_known(classes, _sent(written(ids, "ids")))), "prints")
    of = lambda held_out, name: prints.where(F.col("held_out") == held_out).select(*(F.col(c).alias(f"{name}_{d}") for c, d in (("text_id", "id"), ("n_words", "n_words"), ("print", "print"))))
    near = _near_prints(far.join(of(False, "train"), "train_id").join(of(True, "held"), "held_id"), share)
    return pairs.where("not wide").select("train_id", "held_id").unionByName(near)


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit operations."""
    mask: dict[int, int] = {}
    for i, w in enumerate(a):
        mask[w] = mask.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & mask.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _shared(sides: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair the words both have, in whatever order: no common subsequence is longer."""
    n = len(sides[0][0]) - 1
    if not n:
        return np.zeros(0, np.int64)
    keys = [np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets)) << 33 | codes.view(np.uint32).astype(np.int64) << 1 | side for side, (offsets, codes) in enumerate(sides)]
    both = np.sort(np.concatenate(keys))
    word = both >> 1
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    ones = np.add.reduceat(both & 1, heads)
    return np.bincount(both[heads] >> 33, np.minimum(ones, np.diff(np.append(heads, len(both))) - ones), n)


def verified(pairs: DataFrame, share: float) -> DataFrame:
    """Candidate pairs with their words: those that agree, with their similarity."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [_flat(b.column(i)) for i in (2, 3)]
            sizes = np.stack([np.diff(offsets) for offsets, _ in sides])
            longer = sizes.max(axis=0, initial=0)
            keep, sims = [], []
            for i in np.flatnonzero(_shared(sides) >= share * longer - 1e-9).tolist():
                x, y = (codes[offsets[i] : offsets[i + 1]] for offsets, codes in sides)
                sim = 1.0 if len(x) == len(y) and (x == y).all() else common_words(x.tolist(), y.tolist()) / int(longer[i])
                if sim >= share - 1e-12:
                    keep.append(i)
                    sims.append(sim)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(sims, pa.float64())], names=["train_id", "held_id", "similarity"])

    return pairs.select("train_id", "held_id", "train_words", "held_words").mapInArrow(checked, "train_id bigint, held_id bigint, similarity double")


@dataclass(frozen=True)
class Overlap:
    """links (train_id, held_id, similarity): pairs of classes of equal texts. members (table_name, row_key, held_out, text_id): the
    rows of each class, a key once for each class and side. sizes (text_id, held_out, n): how many rows each class has there."""

    links: DataFrame
    members: DataFrame
    sizes: DataFrame

    def pairs(self) -> DataFrame:
        """(table_name, train_key, held_key, similarity): all pairs of rows that the links stand for."""
        of = lambda held_out, name: self.members.where(F.col("held_out") == held_out).select("table_name", F.col("text_id").alias(f"{name}_id"), F.col("row_key").alias(f"{name}_key"))
        rows = self.links.join(of(False, "train"), "train_id").join(of(True, "held").withColumnRenamed("table_name", "_table"), "held_id")
        return rows.where("table_name = _table").select("table_name", "train_key", "held_key", "similarity")

    def held_rows(self) -> DataFrame:
        """(table_name, held_key, n, best): held-out rows with an overlap, the number of train rows and the greatest similarity."""
        train = self.sizes.where("not held_out").select(F.col("text_id").alias("train_id"), "n")
        of_class = self.links.join(train, "train_id").groupBy("held_id").agg(F.sum("n").alias("n"), F.max("similarity").alias("best"))
        held = self.members.where("held_out").select("table_name", F.col("row_key").alias("held_key"), F.col("text_id").alias("held_id"))
        return held.join(of_class, "held_id").groupBy("table_name", "held_key").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def cross_split_overlap(texts: DataFrame, share: float = SHARE) -> Overlap:
    """Which classes of equal texts in val or test are nearly the same as ones in train, of the same table.

    texts has table_name, row_key, split and text; other columns are left out. Null or wordless texts, null keys and other
    splits are in no pair; repeated keys within a table count as one row of each side; equal texts always pair. Empty tables
    give no links.
    """
    spark = texts.sparkSession
    prepared = written(prepare(texts), "prepared", path=(draft := new_path(spark, "prepared")))
    members = written(prepared.select("table_name", "row_key", "held_out", "text_id").distinct(), "members")
    # only the words of texts that stand in several rows are shuffled
    of_classes = prepared.select("table_name", "held_out", "text_id", "words")
    repeated = written(prepared.groupBy("text_id", "held_out").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("text_id").distinct(), "repeated")
    sent = _sent(repeated)
    once = _known(of_classes, sent).groupBy("table_name", "held_out", "text_id").agg(F.first("words").alias("words"))
    classes = written(_known(of_classes, sent, False).unionByName(once), "classes")
    remove(spark, draft)
    candidates = written(candidate_pairs(classes, frequent_words(classes), share), "candidates")
    ids = candidates.select(F.explode(F.array("train_id", "held_id")).alias("id")).distinct()
    named = _known(classes.select("text_id", "held_out", "words"), _sent(written(ids, "ids")))
    text = lambda held_out, name: named.where(F.col("held_out") == held_out).select(F.col("text_id").alias(f"{name}_id"), F.col("words").alias(f"{name}_words"))
    near = verified(candidates.join(text(False, "train"), "train_id").join(text(True, "held"), "held_id"), share)
    side = lambda held_out, name: classes.where(F.col("held_out") == held_out).select(F.col("text_id").alias(f"{name}_id"))
    equal = side(False, "train").join(side(True, "held"), F.col("train_id") == F.col("held_id")).select("train_id", "held_id", F.lit(1.0).alias("similarity"))
    return Overlap(written(near.unionByName(equal), "links"), members, members.groupBy("text_id", "held_out").agg(F.count(F.lit(1)).alias("n")))


def cross_split_pairs(texts: DataFrame, share: float = SHARE) -> DataFrame:
    """(table_name, train_key, held_key, similarity): every train row and val or test row of a table with nearly the same text; see
    cross_split_overlap."""
    return cross_split_overlap(texts, share).pairs()


def dialogue_text(messages: str = "messages"):
    """The contents of all user and assistant messages in order."""
    spoken = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    return F.array_join(F.transform(spoken, lambda m: m["content"]), "\n")
