"""Metrics over scored rows. All are sums and counts that add up partly before any shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.expr import close, final_number, nonblank, rate, repeats_itself

LN2 = math.log(2)


def share(condition: Column) -> Column:
    return rate(F.count_if(condition), F.count(F.lit(1)))


def loss_metrics(scored: DataFrame, group: str, by: Sequence[str] = ()) -> DataFrame:
    """Token-weighted loss, perplexity and bits per token, per group and over all, in one pass; by adds keys that are never summed over.

    scored has loss_sum, tokens and batches. A null group is named none."""
    named = scored.withColumn(group, F.coalesce(F.col(group).cast("string"), F.lit("none")))
    keys = [F.col(c) for c in by]
    sums = named.groupingSets([[*keys, F.col(group)], keys], *keys, F.col(group)).agg(F.sum("loss_sum").alias("s"), F.sum("tokens").alias("tokens"), F.sum("batches").alias("batches"))
    loss = rate(F.col("s"), F.col("tokens"))
    return sums.select(*by, F.coalesce(group, F.lit("mixed")).alias(group), "tokens", "batches", loss.alias("loss"), F.exp(loss).alias("perplexity"), (loss / LN2).alias("bits_per_token"))


def bits_per_byte(scored: DataFrame, group: str) -> DataFrame:
    sums = scored.groupBy(group).agg(F.sum("nats").alias("nats"), F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("examples"))
    return sums.select(group, "tokens", "bytes", "examples", rate(F.col("nats"), F.lit(LN2) * F.col("bytes")).alias("bpb"))


def choice_accuracy(scores: DataFrame, case: Sequence[str], group: str) -> DataFrame:
    """Accuracy of the best choice by score and by score per token, in percent.

    scores has one row for each case and choice: choice (0-based), logprob (null if it can't be scored), tokens, label. The
    first of equal scores wins; a case without any score is left out.
    """
    worst = F.lit(float("-inf"))
    raw, norm = F.coalesce("logprob", worst), F.coalesce(F.col("logprob") / F.col("tokens"), worst)
    best = scores.groupBy(group, *case, "label").agg(
        F.max_by("choice", F.struct(raw, -F.col("choice"))).alias("pick"),
        F.max_by("choice", F.struct(norm, -F.col("choice"))).alias("pick_norm"),
        F.count("logprob").alias("scored"),
        F.sum(F.when(F.col("logprob").isNotNull(), F.col("tokens"))).alias("tokens"),
    )
    done = best.where("scored > 0")
    return done.groupBy(group).agg((100 * share(F.col("pick") == F.col("label"))).alias("acc"), (100 * share(F.col("pick_norm") == F.col("label"))).alias("acc_norm"), F.count(F.lit(1)).alias("examples"), F.sum("tokens").alias("tokens"))


def assistant_metrics(outputs: DataFrame, content: str, attempted: str, group: Sequence[str] = ()) -> DataFrame:
    return outputs.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), share(nonblank(content)).alias("non_empty_rate"), share(~F.col(attempted)).alias("no_tool_call_rate"), share(~repeats_itself(content)).alias("no_repetition_rate"))


def math_metrics(pairs: DataFrame, expected: str, actual: str, group: Sequence[str] = ()) -> DataFrame:
    """Exact matches of final numbers, within a hair; cases without an expected number don't count."""
    want, got = final_number(expected), final_number(actual)
    known = pairs.select(*group, want.alias("_w"), got.alias("_g")).where("_w is not null")
    return known.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), share(F.coalesce(close("_g", "_w"), F.lit(False))).alias("exact_match_rate"))


def tool_set_metrics(calls: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """calls has valid_json, schema_valid, selected, exact and partial."""
    picked = F.col("valid_json") & F.col("selected")
    return calls.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), share(F.col("valid_json")).alias("valid_json_rate"), share(F.col("schema_valid")).alias("schema_valid_rate"), share(picked).alias("tool_selection_rate"),
        share(picked & F.col("exact")).alias("argument_exact_rate"), rate(F.sum(F.when(picked, F.col("partial")).otherwise(0.0)), F.count(F.lit(1))).alias("argument_partial_accuracy"),
    )


def no_call_metrics(outputs: DataFrame, content: str, attempted: str, group: Sequence[str] = ()) -> DataFrame:
    quiet, said = ~F.col(attempted), nonblank(content)
    return outputs.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), share(quiet).alias("no_tool_call_rate"), share(said).alias("non_empty_rate"), share(quiet & said).alias("correct_rate"))


def masked_loss(tokens: DataFrame, loss: str, mask: str, group: Sequence[str] = ()) -> DataFrame:
    return tokens.groupBy(*group).agg((F.sum(F.col(loss) * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1))).alias("masked_loss"))


def validation_estimate(batches: DataFrame, loss: str, batch: str, most: int, group: Sequence[str] = ()) -> DataFrame:
    """Mean of the first batches' mean losses."""
    return batches.where(F.col(batch) < most).groupBy(*group).agg(F.avg(loss).alias("val_loss"))


def paired(cases: DataFrame, outputs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases with their outputs; an error if one has no partner."""
    both = cases.join(outputs.withColumn("_there", F.lit(True)), [*keys], "full_outer").withColumn("_case", F.lit(True))
    alone = F.when(F.col("_there").isNull(), F.raise_error(F.lit("a case has no output")).cast("boolean")).otherwise(True)
    return both.where(alone).drop("_there", "_case")
