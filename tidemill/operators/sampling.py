"""Sampling, allocation and mixtures. Seeded orders are hash orders: the same in any partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.expr import hash_order
from tidemill.operators.prefix import hash_slot, id_slot, positions, running_total, slot_digits


def take_until_valid(rows: DataFrame, order: str, valid: str, target: int, most_candidates: int | None = None) -> DataFrame:
    """The rows read until target of them are valid or most_candidates are read: a prefix, found on (order, valid) alone.

    order must be unique. A null valid counts as not valid."""
    narrow = rows.select(order, F.coalesce(F.col(valid), F.lit(False)).cast("bigint").alias("_ok"))
    run = running_total(narrow, id_slot(order), [order], {"_read": F.lit(1).cast("bigint"), "_found": F.col("_ok")})
    kept = run.where(F.col("_found") < target)
    if most_candidates is not None:
        kept = kept.where(F.col("_read") < most_candidates)
    last = kept.agg(F.max(order).alias("_last"))
    return rows.join(F.broadcast(last)).where(F.col(order) <= F.col("_last")).drop("_last")


def source_manifest(read: DataFrame, valid: str, requested: int, group: str) -> DataFrame:
    """What became of the rows read: candidates, written and filtered."""
    ok = F.col(valid).cast("bigint")
    return read.groupBy(group).agg(F.lit(requested).cast("bigint").alias("requested_rows"), F.count(F.lit(1)).alias("candidate_rows"), F.sum(ok).alias("written_rows"), F.sum(1 - ok).alias("filtered_rows"))


def hash_sample(rows: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """k rows by hash order: a sample of fixed size that a top-k per partition and a merge find."""
    return rows.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(k).drop("_h")


def preferred_sample(rows: DataFrame, key: str, preferred: str, k: int, seed: int) -> DataFrame:
    """Up to k rows in hash order, those preferred first; the other pool fills up."""
    ranked = rows.withColumn("_h", hash_order(key, seed)).withColumn("_p", F.coalesce(F.col(preferred), F.lit(False)))
    return ranked.orderBy(F.desc("_p"), "_h", key).limit(k).drop("_h", "_p")


def largest_remainder(sizes: DataFrame, total: int, group: str = "source", size: str = "n") -> DataFrame:
    """Shares of total in proportion to the sizes, rounded so that they add up; ties go by name. sizes is one row a source."""
    sums = sizes.agg(F.sum(size).alias("_all"))
    quota = F.col(size) * total / F.col("_all")
    q = sizes.join(F.broadcast(sums)).withColumn("_low", F.when(F.lit(total) >= F.col("_all"), F.col(size)).otherwise(F.floor(quota)).cast("bigint")).withColumn("_frac", quota - F.floor(quota))
    left = q.agg((F.least(F.lit(total), F.max("_all")) - F.sum("_low")).alias("_left"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("_frac", 9)), group))
    out = q.withColumn("_rank", rank).join(F.broadcast(left))
    return out.withColumn("allocated", F.col("_low") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).select(group, size, "allocated")


def _ranked(rows: DataFrame, key: str, source: str, seed: int) -> DataFrame:
    """(key, source, _pos): each row's place in its source's hash order, without the row's other columns."""
    narrow = rows.select(key, source).withColumn("_h", hash_order(key, seed))
    return positions(narrow, hash_slot("_h", slot_digits(narrow.count())), ["_h", key], [source], "_pos").select(key, source, "_pos")


def ratio_subset(rows: DataFrame, key: str, source: str, total: int, seed: int) -> DataFrame:
    """total rows that keep the sources' ratios, by hash order in each source. key must be unique."""
    share = largest_remainder(rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")), total, source)
    chosen = _ranked(rows, key, source, seed).join(share.select(source, "allocated"), source).where(F.col("_pos") < F.col("allocated"))
    return rows.join(chosen.select(key), key, "left_semi")


def mixture_plan(available: DataFrame, recipe: Mapping[str, int], order: Sequence[str], policy: str = "redistribute") -> DataFrame:
    """Per source the rows asked for, there, selected, missing and extra.

    redistribute gives what some sources lack to those that have more than asked, in the fixed order, and only to sources that
    were asked for; fail makes any lack an error; shrink leaves it.
    """
    spark = available.sparkSession
    asked = spark.createDataFrame([(s, recipe.get(s, 0), i) for i, s in enumerate(order)], "source string, requested bigint, place int")
    base = asked.join(available, "source", "left").fillna(0, ["available"]).withColumn("first", F.least("requested", "available"))
    lack = base.agg(F.sum(F.col("requested") - F.col("first")).alias("lack"))
    spare = F.when(F.col("requested") > 0, F.greatest(F.col("available") - F.col("requested"), F.lit(0))).otherwise(0)
    before = F.coalesce(F.sum(spare).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    plan = base.withColumn("_spare", spare).withColumn("_before", before).join(F.broadcast(lack))
    more = F.least("_spare", F.greatest(F.col("lack") - F.col("_before"), F.lit(0))) if policy == "redistribute" else F.lit(0)
    plan = plan.withColumn("selected", F.col("first") + more)
    if policy == "fail":
        plan = plan.withColumn("selected", F.when(F.col("lack") > 0, F.raise_error(F.lit("a source of the mixture is short")).cast("bigint")).otherwise(F.col("selected")))
    return plan.select("source", "requested", "available", "selected", F.greatest(F.col("requested") - F.col("selected"), F.lit(0)).alias("deficit"), F.greatest(F.col("selected") - F.col("requested"), F.lit(0)).alias("extra"))


def check_total(plan: DataFrame) -> DataFrame:
    """The plan, or an error if redistribution left rows missing."""
    short = plan.agg((F.sum("requested") - F.sum("selected")).alias("_short"))
    ok = F.when(F.col("_short") > 0, F.raise_error(F.format_string("redistribution left %d rows short", "_short")).cast("boolean")).otherwise(True)
    return plan.join(F.broadcast(short)).where(ok).drop("_short")


def mixture(rows: DataFrame, plan: DataFrame, key: str, source: str, seed: int) -> DataFrame:
    """The selected rows of every source, with their place in the shuffled mixture. key must be unique."""
    asked = plan.select(F.col("source").alias(source), "selected")
    chosen = _ranked(rows, key, source, seed).join(asked, source).where(F.col("_pos") < F.col("selected")).select(key)
    size = plan.agg(F.sum("selected")).first()[0] or 0
    placed = positions(chosen.withColumn("_m", hash_order(key, seed + 10_000)), hash_slot("_m", slot_digits(size)), ["_m", key], [], "place").select(key, "place")
    return rows.join(placed, key)
