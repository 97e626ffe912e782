"""Bloom filters of 64-bit keys: built by tasks, of bounded size however many keys there are, and sent to every task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: At most so many bits, as a power of two: 128 MB. More keys make the filter let more through, never less.
MOST_BITS, BITS_A_KEY = 30, 16
_PART = 16  # bits of one part, as a power of two
#: So many bits are held at once before they are sent to their parts.
_HELD = 4_000_000


def _bits(keys: np.ndarray, log_bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << log_bits) - 1)
    return keys & mask, (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(20)) & mask


class Bloom:
    """Keys that are in the set are always known; others rarely."""

    def __init__(self, bits: np.ndarray, log_bits: int) -> None:
        self.bits, self.log_bits = bits, log_bits

    def known(self, keys: np.ndarray) -> np.ndarray:
        """For each key (64 bits, well mixed) whether it may be in the set."""
        first, second = ((self.bits[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1 for bit in _bits(keys.view(np.uint64), self.log_bits))
        return (first & second) == 1


def build(keys: DataFrame, n: int) -> Bloom:
    """The filter of a table's only column, a bigint, of about n rows."""
    log_bits = int(min(max(math.ceil(math.log2(BITS_A_KEY * max(n, 1))), _PART + 1), MOST_BITS))

    def spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held += _bits(b.column(0).to_numpy().view(np.uint64), log_bits)
            if sum(map(len, held)) > _HELD:
                yield from packed(held)
                held = []
        yield from packed(held)

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """A row for each part, its bits 16 bits each."""
        if not held:
            return
        bit = np.unique(np.concatenate(held).astype(np.int64))
        part, low = bit >> _PART, (bit & ((1 << _PART) - 1)).astype("<u2")
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(bit) else np.zeros(0, np.int64)
        bits = [low[i:j].tobytes() for i, j in zip(heads, np.append(heads, len(bit))[1:], strict=True)]
        for i in range(0, len(bits), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(part[heads[i : i + 10_000]].astype(np.int32)), pa.array(bits[i : i + 10_000], pa.binary())], names=["part", "bits"])

    def marked(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(1 << _PART, bool)
        out[np.frombuffer(b"".join(part["bits"]), "<u2")] = True
        return pd.DataFrame({"part": part["part"].iloc[:1], "bits": [np.packbits(out).tobytes()]})

    out = np.zeros(1 << (log_bits - 3), np.uint8)
    size = 1 << (_PART - 3)
    for r in keys.mapInArrow(spotted, "part int, bits binary").groupBy("part").applyInPandas(marked, "part int, bits binary").toLocalIterator():
        out[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return Bloom(out, log_bits)
