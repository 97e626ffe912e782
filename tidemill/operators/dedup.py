"""First-wins removal of duplicates, by one key or greedily by several."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import written


def key_digest(*keys: str) -> Column:
    """128 bits that stand for the values of keys, nulls included, so that long texts are never shuffled as keys."""
    return F.md5(F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys))), {"ignoreNullFields": "false"}))


def first_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key, nulls being a value of their own. order must be unique.

    Digests of the keys are aggregated, partly before the shuffle; the rows follow in one semi-join on order."""
    first = rows.select(key_digest(*keys).alias("_key"), order).groupBy("_key").agg(F.min(order).alias(order))
    return rows.join(first.select(order), order, "left_semi")


#: The rest is decided row by row once it has so few rows; after so many rounds it is split into groups that don't touch.
FEW, ROUNDS = 100_000, 30


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the connected component of each node of edges (u, v).

    Alternating stars: every node links its larger neighbours to its least one, then its smaller neighbours and itself; the
    number of rounds grows with the logarithm of the number of nodes, whatever the shape."""
    both = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    seen = None
    while True:
        sym = both(now)
        least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark


def _in_order(open_: DataFrame, keys: Sequence[str], order: str, group: str) -> DataFrame:
    """The accepted rows of open_, decided in order group by group, by tasks that hold the keys of a group's accepted rows."""

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: list[set[str]] = [set() for _ in keys]
        last = None
        for b in batches:
            kept = []
            for i, (at, *values) in enumerate(zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)):
                if at != last:
                    taken, last = [set() for _ in keys], at
                if not any(v in t for v, t in zip(values, taken, strict=True)):
                    kept.append(i)
                    for v, t in zip(values, taken, strict=True):
                        if v is not None:
                            t.add(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept, pa.int64()))], names=[order])

    narrow = open_.select(order, F.col(group).alias("_g"), *keys).repartition("_g").sortWithinPartitions("_g", order)
    return narrow.mapInArrow(decided, narrow.select(order).schema)


def _in_groups(open_: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """open_ with the first row of its group: of the rows that share keys with one another, directly or by others."""
    number = open_.select(order, *keys)
    edges = None
    for k in keys:
        first = number.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias("v"))
        linked = number.join(first, k).select(F.col(order).alias("u"), "v")
        edges = linked if edges is None else edges.unionByName(linked)
    roots = components(edges).select(F.col("node").alias(order), "root")
    return number.join(roots, order, "left").withColumn("_root", F.coalesce("root", order)).drop("root")


def greedy_first_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows accepted one after the other: one that shares a key with a row accepted before is dropped.

    Keys are those of accepted rows only, so this isn't a chain of distinct. In rounds: the rows that are first in all their
    groups are accepted, rows that share a key with an accepted one are dropped, and the rest goes on. What is still open after
    ROUNDS, long chains of rows that share one key here and another there, falls into groups that share nothing with each
    other, and each group is decided in order by one task; FEW rows or fewer are one group from the start.
    Null keys group with nothing. Only order and digests of the keys take part; the last join brings the rows back. order must
    be unique.
    """
    open_ = written(rows.select(order, *(F.md5(F.col(k).cast("string")).alias(k) for k in keys)), "open")
    accepted = None
    rounds = 0
    while left := open_.count():
        if rounds and left <= FEW or rounds >= ROUNDS:
            grouped = open_.withColumn("_root", F.lit(0)) if left <= FEW else _in_groups(open_, keys, order)
            last = written(_in_order(grouped, keys, order, "_root"), "won")
            accepted = last if accepted is None else accepted.unionByName(last)
            break
        rounds += 1
        ok = F.lit(True)
        tried = open_
        for k in keys:
            first = open_.where(F.col(k).isNotNull()).groupBy(k).agg(F.min(order).alias(f"_first_{k}"))
            tried = tried.join(first, k, "left")
            ok = ok & (F.col(k).isNull() | (F.col(order) == F.col(f"_first_{k}")))
        won = written(tried.where(ok).select(order, *keys), "won")
        accepted = won.select(order) if accepted is None else accepted.unionByName(won.select(order))
        rest = open_.join(won.select(order), order, "left_anti")
        for k in keys:
            taken = won.where(F.col(k).isNotNull()).select(F.col(k).alias("_taken")).distinct()
            rest = rest.join(taken, F.col(k) == F.col("_taken"), "left_anti")
        open_ = written(rest.select(order, *keys), "open")
    return rows.join(accepted, order, "left_semi") if accepted is not None else rows.limit(0)
