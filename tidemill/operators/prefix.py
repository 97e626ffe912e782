"""Running totals over an order that no single task has to see.

Rows are put into slots that follow the order; slots are summed, the slot sums are run up (a window over slots, which are
few), and each slot then runs up its own rows. Both shuffles are on (group, slot).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ids per slot where the order is that of an integer.
SLOT_IDS = 65_536


def id_slot(c: str, ids: int = SLOT_IDS) -> Column:
    return F.floor(F.col(c) / ids).cast("bigint")


def slot_digits(rows: int) -> int:
    """Hexadecimal digits of a hash that make slots of about SLOT_IDS rows, or fewer."""
    digits = 1
    while rows > SLOT_IDS * 16**digits and digits < 12:
        digits += 1
    return digits


def hash_slot(order: str, digits: int = 3) -> Column:
    """Slots of an order by hexadecimal hash: 16**digits of them, see slot_digits."""
    return F.conv(F.substring(order, 1, digits), 16, 10).cast("bigint")


def running_total(df: DataFrame, slot: Column, order: Sequence[Column | str], values: dict[str, Column], group: Sequence[str] = ()) -> DataFrame:
    """df with, for each named value, its total over the rows that come before in the group's order.

    slot must not fall along the order. Null groups are a group of their own; ties in the order must be broken by the caller.
    """
    keys = [*group, "_slot"]
    rows = df.withColumn("_slot", slot).withColumns({f"_v_{n}": v for n, v in values.items()})
    sums = rows.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values))
    earlier = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*(F.col(k).alias(f"_k_{k}") for k in keys), *(F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_b_{n}") for n in values))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = None
    for k in keys:
        eq = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = eq if same is None else same & eq
    out = rows.withColumns({f"_w_{n}": F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) for n in values}).join(base, same)
    return out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_w_{n}") for n in values}).select(*df.columns, *values)


def positions(df: DataFrame, slot: Column, order: Sequence[Column | str], group: Sequence[str] = (), name: str = "pos") -> DataFrame:
    """df with each row's 0-based place in its group's order."""
    return running_total(df, slot, order, {name: F.lit(1).cast("bigint")}, group)
