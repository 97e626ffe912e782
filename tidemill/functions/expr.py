"""Column expressions that several operators share. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of the chat format, in the order of their ids.
SPECIAL_TOKENS = ("im_start", "im_end", "im_system", "im_user", "im_assistant", "tool_call", "tool_call_end", "tool_response", "tool_response_end")
SPLIT_STEPS = 10_000


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nonblank(c: Column | str) -> Column:
    """Whether a text has anything but white space in the sense of Unicode; false for null."""
    return F.coalesce(col(c).rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def stripped(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def is_json_object(c: Column | str) -> Column:
    """Whether a text is one JSON object and nothing after it, which the parser alone would let pass."""
    alone = F.json_array_length(F.concat(F.lit("["), col(c), F.lit("]"))) == 1
    return F.coalesce(F.schema_of_variant(F.try_parse_json(col(c))).startswith("OBJECT") & alone, F.lit(False))


def extracted_text(row: DataFrame, field: str | None) -> Column:
    """A field's text if it isn't blank, else null; without a field the whole row as JSON with its nulls."""
    if field is None:
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in row.columns]), {"ignoreNullFields": "false"})
    return F.when(nonblank(field), F.col(field))


def encoded_bytes(domain: Column | str, text: Column | str) -> Column:
    """Bytes of a document as a JSON line with ", " and ": " between its parts, newline included."""
    return F.octet_length(F.to_json(F.struct(col(domain).alias("domain"), col(text).alias("text")))) + F.lit(4)


def hash_position(text: Column | str, seed: int | str) -> Column:
    """A text's place in [0, 1): the first four bytes of SHA-256 of "seed:text", in SPLIT_STEPS steps."""
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), col(text)), 256), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % SPLIT_STEPS / float(SPLIT_STEPS)


def split_label(text: Column | str, seed: int, val: float, test: float) -> Column:
    """test below test, val below test + val, else train."""
    at = hash_position(text, seed)
    return F.when(at < test, "test").when(at < test + val, "val").otherwise("train")


def hash_order(key: Column | str, seed: int | str) -> Column:
    """A seeded order that doesn't depend on partitioning."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), col(key).cast("string")), 256)


def normalized_key(c: Column | str) -> Column:
    """Lower case with single blanks."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"(?U)\s+", " "))


def word_list(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def spaced_words(c: Column | str) -> Column:
    """White space separated words, as a stand-in for tokens."""
    return F.filter(F.split(col(c), r"[ \t\n\r]+"), lambda w: w != "")


def has_reserved(c: Column | str) -> Column:
    return col(c).rlike("|".join(SPECIAL_TOKENS))


def before_special(c: Column | str) -> Column:
    """A text up to its first special token."""
    return F.regexp_extract(col(c), r"(?s)^(.*?)(?:" + "|".join(SPECIAL_TOKENS) + r"|\z)", 1)


def assistant_content(c: Column | str) -> Column:
    """What a generated turn says: after the assistant's role marker, up to the next special token."""
    t, marker = col(c), "im_assistant"
    after = F.when(F.instr(t, marker) > 0, F.substring(t, F.instr(t, marker) + F.lit(len(marker)), F.length(t))).otherwise(t)
    return stripped(before_special(after))


def masked_special(c: Column | str) -> Column:
    """Special tokens replaced by placeholders, one after the other in the order of their ids."""
    out = col(c)
    for i, token in enumerate(SPECIAL_TOKENS):
        out = F.replace(out, F.lit(token), F.lit(f"[SPECIAL_{i}]"))
    return out


def call_payload(c: Column | str) -> Column:
    """What stands between the tool-call markers, or all of the text."""
    t = col(c)
    start, end = F.instr(t, "tool_call"), F.instr(t, "tool_call_end")
    inner = F.substring(t, start + F.lit(len("tool_call")), end - start - F.lit(len("tool_call")))
    return stripped(F.when((start > 0) & (end > start), inner).otherwise(t))


def cleaned_reasoning(c: Column | str) -> Column:
    """Without <<...>> annotations; white space collapsed per line, blank lines dropped."""
    lines = F.split(F.regexp_replace(col(c), "<<[^>]*>>", ""), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085  ]")
    trimmed = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def final_number(c: Column | str) -> Column:
    """The last number after "final answer", or of the whole text; null without any."""
    t = col(c)
    tail = F.regexp_extract(t, r"(?is)final answer\s*[:\-]?\s*(.+)$", 1)
    numbers = F.regexp_extract_all(F.replace(F.when(tail != "", tail).otherwise(t), F.lit(","), F.lit("")), F.lit(r"[-+]?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    return F.try_element_at(numbers, F.lit(-1)).cast("double")


def close(a: Column | str, b: Column | str) -> Column:
    x, y = col(a), col(b)
    return F.abs(x - y) <= F.greatest(F.lit(1e-6) * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-9))


def repeats_itself(c: Column | str) -> Column:
    """At least 12 words, of which under a fifth are distinct or whose 5-grams mostly repeat."""

    def judged(w: Column) -> Column:
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 4, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 5), " "))
        return (n >= 12) & ((F.size(F.array_distinct(w)) < n * 0.2) | (F.size(F.array_distinct(grams)) * 2 < n - 4))

    return F.coalesce(bound(word_list(c), judged), F.lit(False))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, 0 if there is nothing."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def learning_rate(step: Column | str, lr: float, warmup: int, horizon: int) -> Column:
    """Linear warm-up, then cosine decay to 0 at the horizon."""
    s = col(step)
    decay = max(1, max(1, horizon) - warmup)
    progress = F.least(F.lit(1.0), (s - warmup) / decay)
    cosine = lr * 0.5 * (1 + F.cos(F.pi() * progress))
    return F.when(s < warmup, lr * s / warmup).otherwise(cosine) if warmup > 0 else cosine


def quoted(text: Column) -> Column:
    """A text as a JSON string; a null one as an empty string."""
    return bound(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("x"))), lambda j: F.substring(j, F.lit(6), F.length(j) - F.lit(6)))


def compact_json(text: Column) -> Column:
    """JSON text without blanks between its parts; other text and null as they are."""
    outside = r'("(?:[^"\\\\]|\\\\.)*+")|[ \t\r\n]+'.replace("\\\\", "\\")
    return F.when(text.rlike(r"[ \t\r\n]"), F.regexp_replace(text, outside, "$1")).otherwise(text)


def call_json(m: Column) -> Column:
    """The payload of a message's call: its name and arguments, as they are rendered and as token ids are made of them."""
    f = F.get(m["tool_calls"], F.lit(0))["function"]
    return F.when(f.isNotNull() & f["name"].isNotNull(), F.concat(F.lit('{"name":'), quoted(f["name"]), F.lit(',"arguments":'), F.coalesce(f["arguments"], F.lit("{}")), F.lit("}")))


def top_k(values: Column, k: int) -> Column:
    """The k largest values of an array with their 0-based places, the largest first; equal ones by place. Nulls are left out."""
    placed = F.filter(F.transform(values, lambda x, i: F.struct((-x).alias("less"), i.alias("place"))), lambda p: p["less"].isNotNull())
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda p: F.struct(p["place"].alias("place"), (-p["less"]).alias("value")))
