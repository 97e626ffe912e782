"""Training run logs: points (run, step, line_no, train_loss, lr, val_loss)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.prefix import id_slot, positions

POINT = "step bigint, train_loss double, lr double, val_loss double"


def parsed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines as points; lines that aren't complete JSON objects with a step are left out."""
    return lines.withColumn("_p", F.from_json(value, POINT)).where("_p.step is not null").select(*[c for c in lines.columns if c != value], "_p.*")


def last_wins(points: DataFrame) -> DataFrame:
    """One point for each run and step: the one logged last."""
    rest = [c for c in points.columns if c not in ("run", "step")]
    last = points.groupBy("run", "step").agg(F.max_by(F.struct(*rest), "line_no").alias("_p"))
    return last.select("run", "step", *(F.col(f"_p.{c}").alias(c) for c in rest))


def latest(points: DataFrame) -> DataFrame:
    """Each run's last logged point."""
    rest = [c for c in points.columns if c != "run"]
    last = points.groupBy("run").agg(F.max_by(F.struct(*rest), "line_no").alias("_p"))
    return last.select("run", *(F.col(f"_p.{c}").alias(c) for c in rest))


def downsampled(points: DataFrame, most: int) -> DataFrame:
    """At most about most points a run: every so-manieth by step, and the last. A long run is no single task's work."""
    sizes = points.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    ranked = positions(points, id_slot("step"), ["step"], ["run"], "_at").join(sizes, "run")
    stride = F.greatest(F.ceil(F.col("_n") / most), F.lit(1))
    return ranked.where((F.col("_at") % stride == 0) | (F.col("_at") == F.col("_n") - 1)).drop("_at", "_n")


def running_best(points: DataFrame, value: str = "val_loss") -> DataFrame:
    """Points that are strictly better than all before: least values of earlier slots of steps, then inside the slot."""
    rows = points.where(F.col(value).isNotNull()).withColumn("_slot", id_slot("step"))
    least = rows.groupBy("run", "_slot").agg(F.min(value).alias("_least"))
    earlier = Window.partitionBy("run").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    base = least.select("run", "_slot", F.min("_least").over(earlier).alias("_base"))
    within = Window.partitionBy("run", "_slot").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    best = F.least(F.min(value).over(within), F.col("_base"))
    return rows.join(base, ["run", "_slot"]).withColumn("_best", best).where(F.col("_best").isNull() | (F.col(value) < F.col("_best"))).select(*points.columns)
