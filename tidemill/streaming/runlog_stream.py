"""Run logs as a stream: complete lines only, the last point of a step wins, and runs can be taken up where they stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import runtime
from tidemill.operators import runlog
from tidemill.runtime import new_path
from tidemill.streaming.tail import RunLogTail

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def log_lines(spark: SparkSession, path: str, name: str = "run.jsonl") -> DataFrame:
    """(run, line_no, restarted, value): the lines of the logs under a path, and what is appended to them; see RunLogTail."""
    spark.dataSource.register(RunLogTail)
    return spark.readStream.format("run_log_tail").option("name", name).load(path)


def last_points(points: DataFrame) -> DataFrame:
    """The same aggregate as for batches; on a stream its state is one struct for each run and step, kept in update mode."""
    return runlog.last_wins(points)


def run_available(points: DataFrame, name: str, out: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and gives its result table.

    Each micro-batch's last points are written as a table of their own, keyed by batch id, so a batch that is run again
    after a failure overwrites itself; the last version of each step is the result, and of a run whose log was begun again
    (a column restarted) only what came since then. Nothing is held in state: what a batch doesn't touch isn't looked at.
    With out and checkpoint given, a later call takes up where this one stopped; without, folders of their own are used.
    """
    spark = points.sparkSession
    out, checkpoint = out or new_path(spark, name), checkpoint or new_path(spark, f"{name}-state")

    def save(batch: DataFrame, batch_id: int) -> None:
        runlog.last_wins(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = points.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if not runtime.exists(spark, out):
        return spark.createDataFrame([], last_points(points).schema).drop("restarted")
    versions = spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")
    if "restarted" in versions.columns:
        begun = versions.where("restarted").groupBy("run").agg(F.max("batch_id").alias("_since"))
        versions = versions.join(begun, "run", "left").where(F.col("batch_id") >= F.coalesce("_since", F.lit(0))).drop("_since", "restarted")
    rest = [c for c in versions.columns if c not in ("run", "step", "batch_id")]
    last = versions.groupBy("run", "step").agg(F.max_by(F.struct(*rest), F.struct("batch_id", "line_no")).alias("_p"))
    return last.select("run", "step", *(F.col(f"_p.{c}").alias(c) for c in rest))
