"""Packing token streams into fixed windows, and the order in which sources are drawn."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.prefix import id_slot, running_total


def stream_offsets(docs: DataFrame, length: str, order: str) -> DataFrame:
    """Each non-empty document's place in the stream: first token, length with its two boundary tokens, and 0-based number."""
    kept = docs.where(F.col(length) > 0).withColumn("n_stream", (F.col(length) + 2).cast("bigint"))
    return running_total(kept, id_slot(order), [order], {"offset": F.col("n_stream"), "doc_no": F.lit(1).cast("bigint")})


def window_segments(docs: DataFrame, context: int) -> DataFrame:
    """Documents cut at window bounds: at most length/context + 2 rows each, never one per token."""
    first, last = F.floor(F.col("offset") / context), F.floor((F.col("offset") + F.col("n_stream") - 1) / context)
    cut = docs.withColumn("window_id", F.explode(F.sequence(first, last)))
    start = F.greatest(F.col("offset"), F.col("window_id") * context)
    end = F.least(F.col("offset") + F.col("n_stream"), (F.col("window_id") + 1) * context)
    return cut.withColumn("seg_start", start - F.col("window_id") * context).withColumn("seg_len", end - start).withColumn("doc_from", start - F.col("offset"))


def full_windows(segments: DataFrame, context: int) -> DataFrame:
    """One row for each full window; a partial last one is left out."""
    w = segments.groupBy("window_id").agg(F.sum("seg_len").alias("tokens"), F.count(F.lit(1)).alias("docs"), F.min("doc_no").alias("first_doc"), F.max("doc_no").alias("last_doc"))
    return w.where(F.col("tokens") == context)


def window_tokens(segments: DataFrame, tokens: str, start_id: int, end_id: int, context: int) -> DataFrame:
    """Full windows as arrays: input ids, targets (the input moved by one, the last repeated) and document numbers.

    tokens names a column of segments with each document's ids, without boundaries.
    """
    stream = F.concat(F.array(F.lit(start_id)), F.col(tokens), F.array(F.lit(end_id)))
    part = segments.select("window_id", "seg_start", F.slice(stream, (F.col("doc_from") + 1).cast("int"), F.col("seg_len").cast("int")).alias("ids"), F.col("doc_no"))
    grouped = part.groupBy("window_id").agg(F.sort_array(F.collect_list(F.struct("seg_start", "ids", "doc_no"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    docs = F.flatten(F.transform("parts", lambda p: F.array_repeat(p["doc_no"], F.size(p["ids"]))))
    out = grouped.select("window_id", ids.alias("input"), docs.alias("doc_ids")).where(F.size("input") == context)
    return out.withColumn("target", F.concat(F.slice("input", 2, context - 1), F.slice("input", context, 1)))


def document_positions(segments: DataFrame) -> DataFrame:
    """Per window and document the first position inside the window, from which its positions count on from 0."""
    return segments.select("window_id", "doc_no", "seg_start", F.lit(0).alias("first_position"), (F.col("seg_len") - 1).alias("last_position"))


def batches(windows: DataFrame, batch: int, cap: int | None, context: int) -> DataFrame:
    """Windows by batches; a partial last batch is left out, and with a cap no batch starts once it is reached."""
    numbered = windows.withColumn("batch_id", F.floor(F.col("window_id") / batch)).withColumn("slot", F.col("window_id") % batch)
    if cap is not None:
        numbered = numbered.where(F.col("batch_id") < -(-cap // (batch * context)))
    full = numbered.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == batch).select("batch_id")
    return numbered.join(full, "batch_id")


def repeated_batches(rows: DataFrame, position: str, batch: int, epochs: int) -> DataFrame:
    """Batches of rows by position, each epoch again; a partial last batch of an epoch is left out."""
    full = rows.agg(F.floor(F.count(F.lit(1)) / batch).alias("_full"))
    kept = rows.withColumn("batch_no", F.floor(F.col(position) / batch)).join(F.broadcast(full)).where("batch_no < _full").drop("_full")
    return kept.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def deficit_picks(lengths: Sequence[Sequence[int]], fractions: Sequence[float], rng: random.Random | None = None) -> list[tuple[int, int]]:
    """(source, document) in the order drawn: always the source furthest below its share of what was emitted so far."""
    active = [i for i, docs in enumerate(lengths) if len(docs)]
    emitted, at = [0.0] * len(lengths), [0] * len(lengths)
    picks = []
    while active:
        share = sum(fractions[i] for i in active)
        total = sum(emitted[i] for i in active)

        def lack(i: int) -> float:
            noise = rng.random() * 1e-9 if rng is not None and len(active) > 1 else 0.0  # noqa: B023
            return (fractions[i] / share if share > 0 else 1 / len(active)) * total - emitted[i] + noise  # noqa: B023

        pick = max(active, key=lack)
        picks.append((pick, at[pick]))
        emitted[pick] += lengths[pick][at[pick]]
        at[pick] += 1
        if at[pick] == len(lengths[pick]):
            active.remove(pick)
    return picks


def deficit_order(docs: DataFrame, block: int = 200_000) -> DataFrame:
    """The deficit scheduler over (domain, share, pos, n_stream), exact within blocks of the mixture.

    Each choice hangs on all before it, so the exact order is sequential. It runs on (domain, pos, length) alone, in blocks:
    stride order (tokens before / share) gives every document its place in the mixture to within one document, the stream
    is cut into blocks of about block tokens there, and each block is scheduled exactly in a task of its own. draw counts
    within the block; (block, draw) is the order.
    """
    run = running_total(docs, id_slot("pos"), ["pos"], {"before": F.col("n_stream")}, ["domain"])
    placed = run.withColumn("block", F.floor(F.col("before") / F.col("share") / block).cast("bigint"))

    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["domain", "pos"], ignore_index=True)
        starts = np.flatnonzero(np.concatenate([[True], (pdf["domain"].to_numpy()[1:] != pdf["domain"].to_numpy()[:-1])]))
        lengths = np.split(pdf["n_stream"].to_numpy(), starts[1:])
        picks = np.array(deficit_picks([x.tolist() for x in lengths], pdf["share"].to_numpy()[starts].tolist()))
        drawn = pdf.take(starts[picks[:, 0]] + picks[:, 1])
        return drawn.assign(draw=np.arange(len(drawn)))[["block", "draw", "domain", "pos", "n_stream"]]

    schema = "block bigint, draw bigint, domain string, pos bigint, n_stream bigint"
    return placed.select("block", "domain", "share", "pos", "n_stream").groupBy("block").applyInPandas(schedule, schema)


def exhaustion(docs: DataFrame) -> DataFrame:
    """Where each source runs out: the size of the mixture at which its tokens are used up."""
    sums = docs.groupBy("domain", "share").agg(F.sum("n_stream").alias("tokens"))
    return sums.withColumn("runs_out_at", F.floor(F.col("tokens") / F.col("share")).cast("bigint"))


def lm_chunks(docs: DataFrame, length: str, context: int, cap: int | None = None) -> DataFrame:
    """Scoring chunks of at most context tokens, at least two; under a cap chunks go on until so many tokens are scored."""
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.col(length) - 1, F.lit(0)).cast("int"), F.lit(context)))
    chunks = docs.where(F.col(length) >= 2).withColumn("start", starts)
    chunks = chunks.withColumn("end", F.least(F.col("start") + context, F.col(length)).cast("bigint")).where(F.col("end") - F.col("start") >= 2)
    chunks = chunks.withColumn("scored", F.col("end") - F.col("start") - 1)
    if cap is None:
        return chunks
    run = running_total(chunks, id_slot("doc_id"), ["doc_id", "start"], {"before": F.col("scored")})
    kept = run.where(F.col("before") < cap).withColumn("end", F.least(F.col("end"), F.col("start") + cap - F.col("before") + 1))
    return kept.withColumn("scored", F.col("end") - F.col("start") - 1).where("scored >= 1")
