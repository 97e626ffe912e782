"""Byte-level tokenizers of the tokenizers library: encoding, round trips, token views and training on a sample."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.expr import SPECIAL_TOKENS, call_json
from tidemill.runtime import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


@functools.lru_cache(maxsize=4)
def load(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


def train(texts: Iterable[str], vocab_size: int, least: int = 2):
    """A byte-level BPE tokenizer with the chat markers as special tokens and all 256 bytes, from a driver-sized sample."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, trainers

    tokenizer = Tokenizer(models.BPE())
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    tokenizer.decoder = decoders.ByteLevel()
    tokenizer.train_from_iterator(texts, trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=least, special_tokens=list(SPECIAL_TOKENS), initial_alphabet=pre_tokenizers.ByteLevel.alphabet(), show_progress=False))
    return tokenizer


def missing_bytes(tokenizer) -> list[int]:  # noqa: ANN001 - a Tokenizer
    """Byte values that a byte-level tokenizer has no token of its own for; a complete one has none."""
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    known = tokenizer.get_vocab()
    signs = {b: split.pre_tokenize_str(chr(b))[0][0] for b in range(128)}
    rest = sorted(set(pre_tokenizers.ByteLevel.alphabet()) - set(signs.values()))
    return [b for b, sign in signs.items() if sign not in known] + [128 + i for i, sign in enumerate(rest) if sign not in known]


def encoded(rows: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """rows' columns keep with token_ids, offset_bytes (sum of the tokens' character spans) and whether decoding gives the text back.

    Null texts have null ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            done = [None if t is None else tokenizer.encode(t, add_special_tokens=False) for t in texts]
            ids = pa.array([None if e is None else e.ids for e in done], pa.list_(pa.int32()))
            spans = pa.array([None if e is None else sum(z - a for a, z in e.offsets) for e in done], pa.int64())
            same = pa.array([None if e is None else tokenizer.decode(e.ids, skip_special_tokens=False) == t for e, t in zip(done, texts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, spans, same], names=[*keep, "token_ids", "offset_bytes", "round_trip"])

    narrow = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    return spread(narrow).mapInArrow(run, f"{schema}, token_ids array<int>, offset_bytes bigint, round_trip boolean")


def span_sums(rows: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """rows' columns keep with sums: how many characters the first 0, 1, 2, ... tokens span, so that any stretch of tokens is one
    difference. Null texts have null sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for b in batches:
            done = [None if t is None else tokenizer.encode(t, add_special_tokens=False).offsets for t in b.column(b.num_columns - 1).to_pylist()]
            sums = [None if o is None else np.concatenate([[0], np.cumsum([z - a for a, z in o], dtype=np.int64)]).astype(np.int64) for o in done]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sums, pa.list_(pa.int64()))], names=[*keep, "sums"])

    narrow = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    return spread(narrow).mapInArrow(run, f"{schema}, sums array<bigint>")


def vocabulary(spark: SparkSession, path: str = TOKENIZER, most: int | None = None) -> DataFrame:
    """(id, token) of a vocabulary, or its first entries by id. A vocabulary is a file that every node has."""
    entries = sorted((i, t) for t, i in load(path).get_vocab(with_added_tokens=True).items())
    return spark.createDataFrame(pd.DataFrame(entries[:most], columns=["id", "token"]), "id int, token string")


def compression(encoded_rows: DataFrame, n_bytes: str, vocabulary_size: int) -> DataFrame:
    """Texts, bytes, tokens, bytes a token, and the share of the vocabulary that occurs, of rows with token_ids and their bytes."""
    used = encoded_rows.select(F.explode("token_ids").alias("id")).distinct().agg((F.count(F.lit(1)) / vocabulary_size).alias("vocabulary_used"))
    sums = encoded_rows.agg(F.count(F.lit(1)).alias("texts"), F.sum(n_bytes).alias("bytes"), F.sum(F.size("token_ids")).alias("tokens"))
    return sums.withColumn("bytes_a_token", F.try_divide("bytes", "tokens")).join(F.broadcast(used))


def token_view(rows: DataFrame, keep: list[str], text: str, path: str = TOKENIZER) -> DataFrame:
    """rows' columns keep with the tokens of a text, one row each: (position, token, id, kind, bytes, start, stop).

    kind is special, merged or byte; start and stop are the token's characters. Null and empty texts have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        special = {t.content for t in tokenizer.get_added_tokens_decoder().values() if t.special}
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                done = [tokenizer.encode(t or "", add_special_tokens=False) for t in part.column(part.num_columns - 1).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(done)), [len(e.ids) for e in done]))
                tokens = [t for e in done for t in e.tokens]
                columns = {
                    "position": pa.array([i for e in done for i in range(len(e.ids))], pa.int32()), "token": pa.array(tokens, pa.string()), "id": pa.array([i for e in done for i in e.ids], pa.int32()),
                    "kind": pa.array(["special" if t in special else "merged" if len(t) > 1 else "byte" for t in tokens], pa.string()), "bytes": pa.array(list(map(len, tokens)), pa.int32()),
                    "start": pa.array([a for e in done for a, _ in e.offsets], pa.int32()), "stop": pa.array([z for e in done for _, z in e.offsets], pa.int32()),
                }
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in part.columns[:-1]), *columns.values()], names=[*keep, *columns])

    narrow = rows.select(*keep, F.col(text).cast("string").alias("_text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    return spread(narrow).mapInArrow(run, f"{schema}, position int, token string, id int, kind string, bytes int, start int, stop int")


@functools.lru_cache(maxsize=4)
def chat_tokenizer(path: str):
    """A tokenizer with the chat markers, added at the end of the vocabulary where it lacks them. Text is never read as a marker."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens(list(SPECIAL_TOKENS))
    tokenizer.encode_special_tokens = True
    return tokenizer


def decoded(tokenizer, ids: list[int]) -> str:  # noqa: ANN001 - a Tokenizer
    """The text that ids stand for, markers included."""
    markers = {tokenizer.token_to_id(t): t for t in SPECIAL_TOKENS}
    out, run = [], []
    for i in [*ids, None]:
        if i is not None and i not in markers:
            run.append(i)
            continue
        if run:
            out.append(tokenizer.decode(run, skip_special_tokens=False))
            run = []
        if i is not None:
            out.append(markers[i])
    return "".join(out)


def rendered_ids(rows: DataFrame, key: str, path: str) -> DataFrame:
    """Chat rows (key, messages, tools_text) as token ids and loss mask, piece by piece, with a tokenizer that has the chat markers.

    Assistant content and call payloads, names and arguments as expr.call_json renders them, bear loss with their markers and
    im_end; roles and newlines don't. Decoded, the ids are chat.rendered_text."""

    def pieces(messages: list[dict], tools_text: str | None) -> Iterator[tuple[str, int]]:
        if tools_text:
            yield from [("im_start", 0), ("\n", 0), ("im_system", 0), ("\n", 0), (tools_text, 0), ("\n", 0), ("im_end", 0), ("\n", 0)]
        for m in messages if messages is not None else []:
            yield from [("im_start", 0), ("\n", 0)]
            if m["role"] == "tool":
                yield from [("tool_response", 0), ("\n", 0), (m["content"] or "", 0), ("\n", 0), ("tool_response_end", 0), ("\n", 0), ("im_end", 0), ("\n", 0)]
                continue
            own = int(m["role"] == "assistant")
            yield from [(f"im_{m['role']}", 0), ("\n", 0)]
            if m["content"] is None and m["call"]:
                yield from [("tool_call", 1), ("\n", 0), (m["call"], 1), ("\n", 0), ("tool_call_end", 1), ("\n", 0)]
            else:
                yield from [(m["content"] or "", own), ("\n", 0)]
            yield from [("im_end", own), ("\n", 0)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = chat_tokenizer(path)
        for b in batches:
            out = []
            for messages, tools_text in zip(b["messages"], b["tools_text"], strict=True):
                ids: list[int] = []
                mask: list[int] = []
                for text, loss in pieces(messages, tools_text):
                    own = [tokenizer.token_to_id(text)] if text in SPECIAL_TOKENS else tokenizer.encode(text, add_special_tokens=False).ids
                    ids += own
                    mask += [loss] * len(own)
                out.append((ids, mask))
            yield pd.DataFrame({key: b[key], "token_ids": [x[0] for x in out], "loss_mask": [x[1] for x in out]})

    calls = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), call_json(m).alias("call")))
    narrow = rows.select(key, calls.alias("messages"), "tools_text")
    return narrow.mapInPandas(run, f"`{key}` {dict(rows.dtypes)[key]}, token_ids array<int>, loss_mask array<int>")


def padded(ids: str, mask: str, context: int) -> tuple[Column, Column, Column]:
    """Input, target and mask of fixed length: padded by 0, moved by one, the last real token without loss."""
    pad = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(0), context)), 1, context)
    n = F.size(ids)
    shifted = F.slice(F.col(ids), F.lit(2), F.greatest(n - 1, F.lit(0)))
    kept = F.slice(F.col(mask), F.lit(2), F.greatest(n - 1, F.lit(0)))
    return pad(F.col(ids)), pad(shifted), pad(kept)
