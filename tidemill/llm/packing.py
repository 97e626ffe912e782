"""Filling containers: variable-capacity best-fit over several permitted lengths.

Pieces of items are sharded by a hash so that a shard holds about SHARD_ITEMS of them at any scale; each shard is packed on
its own from (key, length) alone, so texts and token arrays never move. Within a shard items go by falling length, each into
the open container with the least room that still holds it. If none does, a container is opened: by one plan the length whose
cost for what it can be expected to hold is least, which weighs all permitted lengths against those still to come, by others
always one of the permitted lengths, or the next that holds the item. At the end each container is downsized to the shortest
permitted length that holds its contents. Of all plans a shard takes the one of least cost, space and containers together. A
shard leaves at most a few containers badly filled, which at SHARD_ITEMS pieces is under 0.1 % of the space.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.runtime import written

SHARD_ITEMS = 20_000
#: Specs are settings that tasks get whole; more are an error.
MAX_SPECS = 10_000
#: Cost of a container besides its length, in the same unit: what each further container costs to handle.
CONTAINER_COST = 1.0
PACKED = "spec_name string, shard int, bin_no int, bin_size bigint, item_key bigint, piece_no int, pieces int, piece_length bigint"


def _planned(lengths: Sequence[int], sizes: Sequence[int], container_cost: float, opened: int | None) -> tuple[list[int], list[int]]:
    """One plan of best_fit: containers are opened at the length opened where it holds the item, or, if None, at that of least expected cost."""
    largest = sizes[-1]
    n = len(lengths)
    room: list[int] = []
    held: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms of open containers, each once, in order
    volume = [*np.cumsum(np.asarray(lengths, dtype=np.float64)[::-1])[::-1].tolist(), 0.0]
    falling = [-x for x in lengths]
    where: list[int] = []
    for at, length in enumerate(lengths):
        fit = bisect.bisect_left(rooms, length)
        if fit < len(rooms):
            r = rooms[fit]
            stack = by_room[r]
            bin_no = stack.pop()
            if not stack:
                del rooms[fit]
        else:
            best, size = float("inf"), largest
            for s in sizes:
                if s < length:
                    continue
                if opened is not None:
                    size = s
                    if s >= opened:
                        break
                    continue
                to_come = volume[max(at + 1, bisect.bisect_left(falling, length - s))] if s > length else 0.0
                cost = (s + container_cost) / max(1, length + min(s - length, to_come))
                if cost <= best:
                    best, size = cost, s
            bin_no, r = len(room), size
            room.append(0)
            held.append(0)
        left = r - length
        room[bin_no] = left
        held[bin_no] += length
        where.append(bin_no)
        if left:
            stack = by_room.setdefault(left, [])
            if not stack:
                bisect.insort(rooms, left)
            stack.append(bin_no)
    fitted = np.searchsorted(sizes, held) if n else []
    return where, [sizes[i] for i in fitted]


def best_fit(lengths: Sequence[int], sizes: Sequence[int], container_cost: float = CONTAINER_COST) -> tuple[list[int], list[int]]:
    """For items by falling length, none over the largest size: each one's container, and each container's size."""
    sizes = sorted(set(sizes))
    plans = [None, *sizes] if len(sizes) > 1 else [None]
    tried = (_planned(lengths, sizes, container_cost, opened) for opened in plans)
    return min(tried, key=lambda plan: sum(plan[1]) + container_cost * len(plan[1]))


def _pack_shard(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
    items = items.sort_values(["length", "item_key", "piece_no"], ascending=[False, True, True], kind="stable")
    sizes = [int(x) for x in items["sizes"].iloc[0]]
    where, size = best_fit(items["length"].tolist(), sizes)
    bins = np.asarray(where, dtype=np.int32)
    return pd.DataFrame(
        {
            "spec_name": key[0], "shard": np.int32(key[1]), "bin_no": bins, "bin_size": np.asarray(size, dtype=np.int64)[bins],
            "item_key": items["item_key"].to_numpy(), "piece_no": items["piece_no"].to_numpy(), "pieces": items["pieces"].to_numpy(), "piece_length": items["length"].to_numpy(),
        }
    )


def pack(items: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """Containers for items (spec_name, item_key, length, sizes), sizes being the permitted container lengths.

    An item is split only if it is longer than the longest permitted length, into full pieces and a rest. Items without
    length (null or 0) take no space and get no container; they are left out. Null keys are packed like others; repeated keys
    are packed once for each row; neither fills one shard, as rows are dealt by their number too. An empty table gives no
    containers.
    """
    cap = F.array_max("sizes")
    n = F.ceil(F.col("length") / cap).cast("int")
    pieces = (
        items.select("spec_name", F.col("item_key").cast("bigint").alias("item_key"), F.col("length").cast("bigint").alias("length"), "sizes")
        .where("length > 0 and size(sizes) > 0")
        .withColumn("pieces", n)
        .withColumn("_row", F.monotonically_increasing_id())
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("length", F.least(cap.cast("bigint"), F.col("length") - F.col("piece_no") * cap))
    )
    counts = items.where("length > 0 and size(sizes) > 0").groupBy("spec_name").agg(F.sum(n).alias("n")).withColumn("shards", F.ceil(F.col("n") / F.lit(shard_items)).cast("int"))
    counts = written(counts, "counts")
    if counts.limit(MAX_SPECS + 1).count() > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    sharded = pieces.join(F.broadcast(counts.select("spec_name", "shards")), "spec_name").withColumn("shard", F.pmod(F.xxhash64("item_key", "piece_no", "_row"), F.col("shards")).cast("int"))
    return sharded.select("spec_name", "shard", "item_key", "piece_no", "pieces", "length", "sizes").groupBy("spec_name", "shard").applyInPandas(_pack_shard, PACKED)


def containers(packed: DataFrame) -> DataFrame:
    """One row per container."""
    return packed.groupBy("spec_name", "shard", "bin_no").agg(
        F.first("bin_size").alias("bin_size"), F.sum("piece_length").alias("used"), F.count(F.lit(1)).alias("n_pieces")
    )


def fill_report(packed: DataFrame) -> DataFrame:
    """Containers and unused space by spec and container size."""
    return (
        containers(packed)
        .groupBy("spec_name", "bin_size")
        .agg(F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("used"), F.sum(F.col("bin_size") - F.col("used")).alias("unused"), F.sum("n_pieces").alias("n_pieces"))
        .withColumn("fill", F.round(F.col("used") / (F.col("used") + F.col("unused")), 6))
    )


def space_report(packed: DataFrame) -> DataFrame:
    """Per spec the items, their units, the space of all containers, and the share of it that no packing could do without."""
    whole = containers(packed).groupBy("spec_name").agg(F.sum("used").alias("units"), F.sum("bin_size").alias("space"), F.count(F.lit(1)).alias("n_bins"))
    items = packed.where("piece_no = 0").groupBy("spec_name").agg(F.count(F.lit(1)).alias("items"))
    return whole.join(items, "spec_name").select("spec_name", "items", "units", "space", "n_bins", F.round(F.col("units") / F.col("space"), 6).alias("least_share"))


def split_items(packed: DataFrame) -> DataFrame:
    """Items that had to be split, once each."""
    return packed.where("piece_no = 1").select("spec_name", "item_key").distinct()


#: Key columns of tables that can be packed; fixed values.
KEY_OF = {"rendered_sft": "row_id", "documents": "doc_id"}


def spec_items(spark: SparkSession, sf: str, joint: bool = False) -> DataFrame:
    """Items for every row of pack_spec.

    A spec's permitted lengths are its capacity and the halves and quarters of it; jointly, all specs of a table, field and unit share the
    union of their capacities, and the spec's name is the table's, with field and unit where the table has several. Specs are settings, a handful of rows; more than MAX_SPECS is an error.
    """
    specs = spark.read.parquet(f"{sf}/pack_spec.parquet").limit(MAX_SPECS + 1).collect()
    if len(specs) > MAX_SPECS:
        raise ValueError(f"more than {MAX_SPECS} specs")
    tables: dict[tuple[str, str, str], list[tuple[str, list[int]]]] = {}
    for s in specs:
        if s["capacity"] and s["capacity"] > 0:
            sizes = sorted({s["capacity"], max(1, s["capacity"] // 2), max(1, s["capacity"] // 4)})
            tables.setdefault((s["table_name"], s["field_name"], s["unit"]), []).append((s["spec_name"], sizes))
    out = None
    for (table, field, unit), wanted in tables.items():
        if joint:
            alone = sum(t == table for t, _, _ in tables) == 1
            wanted = [(table if alone else f"{table}.{field}.{unit}", sorted({max(sizes) for _, sizes in wanted}))]
        rows = spark.read.parquet(f"{sf}/{table}.parquet")
        length = F.size(field) if unit == "token" else F.octet_length(field)
        narrow = rows.select(F.col(KEY_OF[table]).alias("item_key"), F.greatest(length, F.lit(0)).alias("length"))
        each = F.explode(F.array(*(F.struct(F.lit(name).alias("spec_name"), F.array(*map(F.lit, sizes)).alias("sizes")) for name, sizes in wanted)))
        part = narrow.withColumn("spec", each).select("spec.spec_name", "item_key", "length", "spec.sizes")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "spec_name string, item_key bigint, length int, sizes array<int>")
    return out


def token_windows(packed: DataFrame, tokens: DataFrame, key: str, field: str, capacity_of: DataFrame) -> DataFrame:
    """The pieces' contents: packed pieces joined to their item's array and cut to the piece."""
    cut = packed.join(capacity_of, "spec_name").join(tokens.select(F.col(key).alias("item_key"), F.col(field).alias("_content")), "item_key")
    return cut.select("spec_name", "shard", "bin_no", "bin_size", "item_key", "piece_no", F.slice("_content", F.col("piece_no") * F.col("capacity") + 1, F.col("piece_length").cast("int")).alias("content"))


