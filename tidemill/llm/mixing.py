"""Mixing sources to target weights by pivotal dependent rounding.

A source that shall give T tokens and has S of them is needed T/S times, at most max_repeats times. All its documents get
the whole part of that number as copies; the fractional part is a probability that dependent rounding makes 0 or 1: two
documents' open probabilities are paired, and mass weighted by their sizes moves at random from one to the other until one
of them is integral, so that each document keeps its expected copies while the sum of tokens never changes. Chunks of a
source are rounded at the same time, each leaving at most one open document; these go up a reduction tree of fan-in FAN_IN
until one is left, which a single draw closes. So a source misses its target by less than one document.
"""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.tokens import VOCABULARY, count_tokens
from tidemill.runtime import bounded, written

CHUNK_DOCS = 20_000
FAN_IN = 256
MAX_TARGETS = 100_000
_ROUNDED = "mix_name string, source string, chunk bigint, doc_id bigint, n_tokens bigint, base int, open double, extra int"
_EPS = 1e-9


def pivotal(sizes: list[float], chances: list[float], rng: random.Random) -> tuple[list[int], int, float]:
    """Rounds chances to 0 or 1 keeping the size-weighted sum; gives the results, the one left open (-1: none) and its chance."""
    out = [0] * len(sizes)
    at, p = -1, 0.0
    for i, (size, q) in enumerate(zip(sizes, chances, strict=True)):
        if q <= _EPS or q >= 1 - _EPS:
            out[i] = int(q > 0.5)
            continue
        if at < 0:
            at, p = i, q
            continue
        a, b = sizes[at], size
        up, down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)  # mass that can move to the open one, and from it
        if rng.random() * (up + down) < down:
            p, q = p + up / a, q - up / b
        else:
            p, q = p - down / a, q + down / b
        if _EPS < p < 1 - _EPS:  # then q is integral
            out[i] = int(q > 0.5)
        else:
            out[at] = int(p > 0.5)
            if _EPS < q < 1 - _EPS:
                at, p = i, q
            else:
                out[i] = int(q > 0.5)
                at = -1
    return out, at, p


def _round_group(seed: str):
    def rounded(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values(["doc_id", "n_tokens"], kind="stable", ignore_index=True)
        rng = random.Random(hashlib.sha256(f"{seed}:{key}".encode()).digest())
        out, at, p = pivotal(docs["n_tokens"].astype(float).tolist(), docs["open"].tolist(), rng)
        still = np.full(len(docs), np.nan)
        if at >= 0:
            still[at] = p
        return docs.assign(extra=np.asarray(out, dtype=np.int32), open=still)[["mix_name", "source", "chunk", "doc_id", "n_tokens", "base", "open", "extra"]]

    return rounded


def source_sizes(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents, counted once and written."""
    return written(count_tokens(documents, ["doc_id", "source"], "text", vocabulary), "tokens")


def mix_plan(sized: DataFrame, targets: DataFrame, size: int | None = None) -> DataFrame:
    """For each target: tokens wanted and there, and how often each document is needed, capped.

    The mixture has size tokens, or as many as all documents together, those without source included. Sources without documents have none.
    Null weights count as 0 and null or negative repeats as 0.
    """
    have = sized.groupBy("source").agg(F.sum("n_tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    total = sized.agg((F.coalesce(F.sum("n_tokens"), F.lit(0)) if size is None else F.max(F.lit(size))).cast("bigint").alias("total_tokens"))
    wanted = targets.select("mix_name", "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    plan = wanted.join(F.broadcast(total)).join(have, "source", "left").fillna(0, ["source_tokens", "source_docs"])
    plan = plan.withColumn("target_tokens", F.col("weight") * F.col("total_tokens"))
    capped = F.col("target_tokens") > F.col("max_repeats") * F.col("source_tokens")
    need = F.when(capped, F.col("max_repeats").cast("double")).otherwise(F.try_divide("target_tokens", "source_tokens"))
    return plan.withColumn("capped", capped).withColumn("need", F.coalesce(need, F.lit(0.0)))


def mix(sized: DataFrame, plan: DataFrame, seed: str = "mix", chunk_docs: int = CHUNK_DOCS, fan_in: int = FAN_IN) -> DataFrame:
    """(mix_name, source, doc_id, n_tokens, copies) for every document and mix that names its source.

    Documents without tokens get the whole part of their source's need, at no cost; documents without source are in no mix.
    Repeated ids are rounded each on its own; null ids are dealt to chunks by their rows' numbers. The plan is a handful of settings; more than MAX_TARGETS rows is an error.
    """
    if plan.limit(MAX_TARGETS + 1).count() > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    need = plan.select("mix_name", "source", "need", F.ceil(F.col("source_docs") / chunk_docs).alias("chunks"))
    docs = (
        sized.join(F.broadcast(need), "source")
        .withColumn("base", F.floor(F.col("need") + F.lit(_EPS)).cast("int"))
        .withColumn("open", F.when(F.col("n_tokens") > 0, F.greatest(F.col("need") - F.col("base"), F.lit(0.0))).otherwise(0.0))
        .withColumn("chunk", F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), F.lit(seed)), F.greatest("chunks", F.lit(1))).cast("bigint"))
        .select("mix_name", "source", "chunk", "doc_id", "n_tokens", "base", "open")
    )
    settled = docs.where(F.col("open") <= _EPS).withColumn("extra", F.lit(0))
    rounded = written(docs.where(F.col("open") > _EPS).groupBy("mix_name", "source", "chunk").applyInPandas(_round_group(f"{seed}:0"), _ROUNDED), "rounded")
    done = [settled, rounded.where("open is null or isnan(open)")]
    left = rounded.where("open is not null and not isnan(open)")
    chunks, level = need.agg(F.max("chunks")).first()[0] or 0, 1
    while chunks > 1:
        chunks = -(-chunks // fan_in)
        up = left.drop("extra").withColumn("chunk", F.floor(F.col("chunk") / fan_in))
        level_rows = written(up.groupBy("mix_name", "source", "chunk").applyInPandas(_round_group(f"{seed}:{level}"), _ROUNDED), "rounded")
        done.append(level_rows.where("open is null or isnan(open)"))
        left = level_rows.where("open is not null and not isnan(open)")
        level += 1
    draw = F.pmod(F.xxhash64("mix_name", "source", "doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    done.append(left.withColumn("extra", (draw < F.col("open")).cast("int")))
    out = None
    for part in done:
        part = part.select("mix_name", "source", "doc_id", "n_tokens", (F.col("base") + F.col("extra")).alias("copies"))
        out = part if out is None else out.unionByName(part)
    return out


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual tokens and shares of every source of every mix, and whether it falls short of its weight."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("actual_tokens"), F.sum("copies").alias("copies"), F.min("copies").alias("least_copies"))
    all_of = plan.join(got, ["mix_name", "source"], "left").fillna(0, ["actual_tokens", "copies"])
    mixes = all_of.groupBy("mix_name").agg(F.sum("actual_tokens").alias("mix_tokens"))
    spent = (F.col("least_copies") >= F.col("max_repeats")) | F.col("least_copies").isNull()
    return all_of.join(bounded(mixes, "mixes", MAX_TARGETS), "mix_name").select(
        "mix_name", "source", "weight", "max_repeats", "source_docs", "source_tokens", "target_tokens", "actual_tokens", "copies",
        F.round(F.coalesce(F.try_divide("actual_tokens", "mix_tokens"), F.lit(0.0)), 6).alias("actual_share"),
        (spent & (F.col("actual_tokens") < F.col("target_tokens"))).alias("short"),
    )
