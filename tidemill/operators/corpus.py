"""Corpora: encoding, splits, byte budgets, manifests, and checks of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.expr import encoded_bytes, nonblank, split_label
from tidemill.operators.prefix import id_slot, running_total
from tidemill.runtime import bounded

BYTES_PER_TOKEN = 4


def encoded(documents: DataFrame, domain: str, text: str = "text", pos: str = "doc_id") -> DataFrame:
    """(pos, domain, text, n_bytes) of all documents that aren't blank; a null domain is named none."""
    d = documents.where(nonblank(text)).select(F.col(pos).alias("pos"), F.coalesce(domain, F.lit("none")).alias("domain"), F.col(text).alias("text"))
    return d.withColumn("n_bytes", encoded_bytes("domain", "text").cast("bigint"))


def budget_cut(docs: DataFrame, targets: DataFrame, size: str = "n_bytes") -> DataFrame:
    """Each domain's documents in order until their sizes reach the domain's target; the one that crosses it is kept.

    targets has domain and target, one row a configured component; a domain keeps at least one document, even for a target
    of 0. What is kept is a prefix, so only (domain, pos, size) is shuffled to find each domain's last position, and the
    documents themselves are filtered where they lie. pos must be unique in its domain.
    """
    narrow = docs.select("domain", "pos", F.col(size).alias("_size"))
    run = running_total(narrow, id_slot("pos"), ["pos"], {"before": F.col("_size"), "rank": F.lit(1).cast("bigint")}, ["domain"])
    kept = run.join(bounded(targets.select("domain", "target"), "components"), "domain").where((F.col("before") < F.col("target")) | (F.col("rank") == 0))
    last = kept.groupBy("domain").agg(F.max("pos").alias("_last"))
    return docs.join(F.broadcast(last), "domain").where(F.col("pos") <= F.col("_last")).drop("_last")


def domain_targets(fractions: DataFrame, total_bytes: int) -> DataFrame:
    """(domain, fraction, target): each domain's share of the budget, cut to whole bytes."""
    return fractions.select("domain", "fraction", F.floor(F.lit(total_bytes) * F.col("fraction")).cast("bigint").alias("target"))


def with_split(docs: DataFrame, seed: int, val: float, test: float) -> DataFrame:
    """A text's split depends on nothing but the text and the seed, so equal texts share one."""
    return docs.withColumn("split", split_label("text", seed, val, test))


def manifest(docs: DataFrame, fractions: DataFrame) -> DataFrame:
    """Counts per split and domain, with rows of zeros for those without documents, and estimated tokens."""
    counts = docs.groupBy("split", "domain").agg(F.count(F.lit(1)).alias("doc_count"), F.sum("n_bytes").alias("byte_count"))
    splits = docs.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    every = splits.join(bounded(fractions.select("domain", "fraction"), "components"))
    full = every.join(counts, ["split", "domain"], "left").fillna(0, ["doc_count", "byte_count"])
    return full.withColumn("estimated_tokens", F.floor(F.col("byte_count") / BYTES_PER_TOKEN).cast("bigint"))


def split_totals(per_domain: DataFrame) -> DataFrame:
    """Totals per split; their tokens are estimated from the total, not added up."""
    t = per_domain.groupBy("split").agg(F.sum("doc_count").alias("doc_count"), F.sum("byte_count").alias("byte_count"))
    return t.withColumn("estimated_tokens", F.floor(F.col("byte_count") / BYTES_PER_TOKEN).cast("bigint"))


def component_fill(docs: DataFrame, targets: DataFrame, least: float) -> DataFrame:
    """Bytes each domain got, and whether that is enough of its target."""
    got = docs.groupBy("domain").agg(F.sum("n_bytes").alias("byte_count"))
    return targets.join(got, "domain", "left").fillna(0, ["byte_count"]).withColumn("filled", F.col("byte_count") >= F.col("target") * least)


def split_leakage(docs: DataFrame) -> DataFrame:
    """Texts, by their digest, that stand in more than one split; none, if splits are by text. Only digests are shuffled."""
    return docs.select(F.md5("text").alias("text_md5"), "split").distinct().groupBy("text_md5").agg(F.count(F.lit(1)).alias("splits")).where("splits > 1")


def existing_check(per_domain: DataFrame, listing: DataFrame) -> DataFrame:
    """A manifest's entries against the files there are: missing, of another size, or right."""
    there = listing.select("split", "domain", F.col("file_bytes"))
    joined = per_domain.join(there, ["split", "domain"], "left")
    status = F.when(F.col("file_bytes").isNull(), "missing").when(F.col("file_bytes") != F.col("byte_count"), "changed").otherwise("ok")
    return joined.withColumn("status", status)


def normalized_fractions(sources: DataFrame) -> DataFrame:
    """Fractions that add up to 1: as given, else by estimated tokens, else equal. sources is a handful of settings."""
    sums = sources.agg(F.sum("fraction").alias("_f"), F.sum("tokens").alias("_t"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_f") > 0, F.col("fraction") / F.col("_f")).when(F.col("_t") > 0, F.col("tokens") / F.col("_t")).otherwise(1 / F.col("_n"))
    return sources.join(F.broadcast(sums)).select("domain", share.alias("share"))


def estimated_steps(per_domain: DataFrame, batch: int, length: int, cap: int | None = None) -> DataFrame:
    """Batches that a split's tokens fill, two boundary tokens for each document."""
    n = per_domain.groupBy("split").agg((F.sum("estimated_tokens") + 2 * F.sum("doc_count")).alias("tokens"))
    tokens = F.least("tokens", F.lit(cap)) if cap is not None else F.col("tokens")
    return n.select("split", F.col("tokens"), F.floor(tokens / (batch * length)).cast("bigint").alias("steps"))
