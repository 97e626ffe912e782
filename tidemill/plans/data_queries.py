"""Packing, text predicates, deduplication, sampling and mixtures, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import expr as E
from tidemill.operators import chat, dedup, sampling, windows
from tidemill.plans import pipelines
from tidemill.runtime import new_path, written
from tidemill.operators.prefix import id_slot, positions

SEED, CONTEXT, BATCH = 42, 256, 8
ORDER = ("web", "code", "synthetic", "papers", "faq", "wiki_dump")
RECIPE = {"web": 20, "code": 12, "synthetic": 10, "papers": 8, "faq": 9, "wiki_dump": 0}
MIX_SHARES = {"web": 0.6, "code": 0.25, "synthetic": 0.15}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def _sized(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("n_words", F.size(E.spaced_words("text")).cast("bigint"))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return windows.window_segments(windows.stream_offsets(_sized(spark, sf), "n_words", "doc_id"), CONTEXT)


def pack_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return windows.stream_offsets(_sized(spark, sf), "n_words", "doc_id").select("doc_id", "doc_no", "offset", "n_stream")


def pack_windows(spark: SparkSession, sf: str) -> DataFrame:
    return windows.full_windows(_segments(spark, sf), CONTEXT)


def pack_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Windows rebuilt as arrays, here of word hashes; sums stand for the arrays."""
    docs = _sized(spark, sf).withColumn("ids", F.transform(E.spaced_words("text"), lambda w: F.length(w)))
    cut = windows.window_segments(windows.stream_offsets(docs, "n_words", "doc_id"), CONTEXT)
    w = windows.window_tokens(cut, "ids", 0, 1, CONTEXT)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return w.select("window_id", total("input").alias("input_sum"), total("target").alias("target_sum"), total("doc_ids").alias("doc_sum"))


def doc_positions(spark: SparkSession, sf: str) -> DataFrame:
    return windows.document_positions(_segments(spark, sf)).select("window_id", "doc_no", "seg_start", "last_position")


def pack_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = windows.batches(pack_windows(spark, sf), BATCH, None, CONTEXT)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("tokens").alias("tokens"), F.min("first_doc").alias("first_doc"))


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    shares = spark.createDataFrame(list(MIX_SHARES.items()), "domain string, share double")
    d = _sized(spark, sf).where("n_words > 0").select(F.col("source").alias("domain"), F.col("doc_id").alias("pos"), (F.col("n_words") + 2).alias("n_stream"))
    return d.join(F.broadcast(shares), "domain")


def deficit_order(spark: SparkSession, sf: str) -> DataFrame:
    return windows.deficit_order(_shared(spark, sf), block=20_000)


def source_exhaustion(spark: SparkSession, sf: str) -> DataFrame:
    return windows.exhaustion(_shared(spark, sf)).select("domain", "tokens", "runs_out_at")


def lm_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks until half of all words are scored."""
    sized = _sized(spark, sf).select("doc_id", "n_words")
    half = (sized.agg(F.sum("n_words")).first()[0] or 0) // 2
    return windows.lm_chunks(sized, "n_words", 128, half).select("doc_id", F.col("start").cast("bigint").alias("start"), "end", "scored")


def gsm8k_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("source = 'math_lessons'").select("doc_id", E.cleaned_reasoning("text").alias("cleaned"))


def final_number(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", E.final_number("text").alias("number"))


def repetition_flag(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", E.repeats_itself("text").alias("repeats"))


def reserved_token_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(E.nonblank("text") & ~E.has_reserved("text")).select("doc_id")


def normalized_key(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(F.md5(E.normalized_key("text").cast("binary")).alias("key")).agg(F.count(F.lit(1)).alias("docs"))


def length_limits(spark: SparkSession, sf: str) -> DataFrame:
    over = lambda most: chat.too_long(F.col("text"), most)
    return _docs(spark, sf).groupBy("source").agg(F.count_if(~over(512)).alias("within_512"), F.count_if(~over(1024)).alias("within_1024"), F.count_if(over(2048)).alias("over_2048"))


def extract_assistant(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/rendered_sft.parquet").select("row_id", E.assistant_content("text").alias("content"))


def mask_special_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(E.has_reserved("text")).select("doc_id", E.masked_special("text").alias("masked"))


def dedup_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).withColumn("key", E.normalized_key("text"))
    return dedup.first_wins(d, ["source", "key"], "doc_id").select("doc_id", "source")


def dedup_greedy_three_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/sft_public_tool_fixture.parquet").select("row_no", "id", F.nullif("hash_id", F.lit("")).alias("hash_id"), F.nullif(E.normalized_key("query"), F.lit("")).alias("query_key"))
    return dedup.greedy_first_wins(rows, ["id", "hash_id", "query_key"], "row_no").select("row_no")


def _flagged(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).withColumn("valid", F.coalesce(F.col("lang") == "en", F.lit(False)) & (F.length("text") > 200))


def _read_until(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """Rows read until a twentieth of the table's number are valid, or a fifth of it read; and that twentieth."""
    rows = _flagged(spark, sf)
    n = rows.count()
    return sampling.take_until_valid(rows, "doc_id", "valid", n // 20, n // 5), n // 20


def take_until_valid(spark: SparkSession, sf: str) -> DataFrame:
    read = _read_until(spark, sf)[0].select("doc_id", "valid")
    return positions(read, id_slot("doc_id"), ["doc_id"], [], "candidates_before").where("valid").select("doc_id", "candidates_before")


def source_manifest(spark: SparkSession, sf: str) -> DataFrame:
    read, target = _read_until(spark, sf)
    return sampling.source_manifest(read.withColumn("set_name", F.lit("english")), "valid", target, "set_name")


def reservoir_topk(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.hash_sample(_docs(spark, sf), "doc_id", 50, SEED).select("doc_id", "source")


def preferred_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).withColumn("preferred", F.col("source") == "papers")
    return sampling.preferred_sample(d, "doc_id", "preferred", 30, SEED).select("doc_id", "source")


def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    sizes = _docs(spark, sf).where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sampling.largest_remainder(sizes, 77)


def ratio_subset(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.ratio_subset(_docs(spark, sf).where("source is not null"), "doc_id", "source", 77, SEED).select("doc_id", "source")


def _plan(spark: SparkSession, sf: str) -> DataFrame:
    available = _docs(spark, sf).where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("available"))
    return sampling.mixture_plan(available, RECIPE, ORDER)


def mixture_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf)


def mixture_select(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.mixture(_docs(spark, sf).where("source is not null"), _plan(spark, sf), "doc_id", "source", SEED).select("doc_id", "source", "place")


def sft_batches(spark: SparkSession, sf: str) -> DataFrame:
    b = windows.repeated_batches(mixture_select(spark, sf), "place", BATCH, 2)
    return b.groupBy("epoch", "batch_no").agg(F.count(F.lit(1)).alias("rows"), F.sum("doc_id").alias("doc_sum"))


def mixture_line_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of prepared sources, of which some are equal, and a mixture of all of them: every line is one row of it, once."""
    at = new_path(spark, "prepared")
    for source in MIX_SHARES:
        rows = _docs(spark, sf).where(F.col("source") == source).select(F.to_json(F.struct("source", "lang")).alias("value"))
        rows.write.text(f"{at}/{source}")
    lines = written(pipelines.mixture_lines(spark, at, list(MIX_SHARES)), "lines")
    counts = lines.groupBy("source").agg(F.count(F.lit(1)).alias("available"))
    plan = sampling.mixture_plan(counts, dict.fromkeys(MIX_SHARES, 10**9), list(MIX_SHARES), "shrink")
    mixed = sampling.mixture(lines, plan, "key", "source", SEED)
    return mixed.groupBy("source").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("key").alias("keys"), F.countDistinct("value").alias("texts"))


QUERIES = {f.__name__: f for f in (pack_offsets, pack_windows, pack_tokens, doc_positions, pack_batches, deficit_order, source_exhaustion, lm_chunks, gsm8k_clean, final_number, repetition_flag, reserved_token_filter, normalized_key, length_limits, extract_assistant, mask_special_tokens, dedup_first_wins, dedup_greedy_three_keys, take_until_valid, source_manifest, reservoir_topk, preferred_sample, largest_remainder, ratio_subset, mixture_manifest, mixture_select, sft_batches, mixture_line_keys)}

_SIZED = r"sized AS (SELECT doc_id, text, source, len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> ''))::BIGINT AS n_words FROM documents)"
_STREAM = f"{_SIZED}, st AS (SELECT *, n_words + 2 AS n_stream, coalesce(sum(n_words + 2) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", row_number() OVER (ORDER BY doc_id) - 1 AS doc_no FROM sized WHERE n_words > 0)"
_SEG = f"{_STREAM}, seg AS (SELECT *, greatest(\"offset\", w * {CONTEXT}) - w * {CONTEXT} AS seg_start, least(\"offset\" + n_stream, (w + 1) * {CONTEXT}) - greatest(\"offset\", w * {CONTEXT}) AS seg_len FROM (SELECT *, unnest(range(\"offset\" // {CONTEXT}, (\"offset\" + n_stream - 1) // {CONTEXT} + 1)) AS w FROM st))"
_WIN = f"{_SEG}, win AS (SELECT w AS window_id, sum(seg_len)::BIGINT AS tokens, count(*) AS docs, min(doc_no) AS first_doc, max(doc_no) AS last_doc FROM seg GROUP BY w HAVING sum(seg_len) = {CONTEXT})"
_WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F\x0B]"
_KEY = rf"trim(regexp_replace(lower({{c}}), '[\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}\x0B]+', ' ', 'g'), ' ')"
_NUM = r"regexp_extract_all(replace(CASE WHEN regexp_extract(text, '(?is)final answer\s*[:\-]?\s*(.+)$', 1) <> '' THEN regexp_extract(text, '(?is)final answer\s*[:\-]?\s*(.+)$', 1) ELSE text END, ',', ''), '[-+]?[0-9]+(?:\.[0-9]+)?')"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_CLEAN = r"""array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(text, '<<[^>]*>>', '', 'g'), '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(x, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10))"""
_SPECIAL = "|".join(E.SPECIAL_TOKENS)
_MASK = "text"
for _i, _t in enumerate(E.SPECIAL_TOKENS):
    _MASK = f"replace({_MASK}, '{_t}', '[SPECIAL_{_i}]')"
_AVAILABLE = "avail AS (SELECT source, count(*) AS available FROM documents WHERE source IS NOT NULL GROUP BY source)"
_ASKED = "asked(source, requested, place) AS (VALUES " + ", ".join(f"('{s}', {RECIPE[s]}::BIGINT, {i})" for i, s in enumerate(ORDER)) + ")"
_PLAN = f"""{_AVAILABLE}, {_ASKED}, base AS (SELECT asked.*, coalesce(available, 0) AS available, least(requested, coalesce(available, 0)) AS first,
    CASE WHEN requested > 0 THEN greatest(coalesce(available, 0) - requested, 0) ELSE 0 END AS spare FROM asked LEFT JOIN avail USING (source)),
  b2 AS (SELECT *, coalesce(sum(spare) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (SELECT sum(requested - first) FROM base) AS lack FROM base),
  pl AS (SELECT source, requested, available, (first + least(spare, greatest(lack - before, 0)))::BIGINT AS selected FROM b2)"""
_MIX = f"""{_PLAN}, rk AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}:' || doc_id), doc_id) - 1 AS pos FROM documents WHERE source IS NOT NULL),
  mixed AS (SELECT doc_id, source, row_number() OVER (ORDER BY sha256('{SEED + 10_000}:' || doc_id), doc_id) - 1 AS place FROM rk JOIN pl USING (source) WHERE pos < selected)"""
_VALID = "v AS (SELECT *, coalesce(lang = 'en', false) AND coalesce(length(text) > 200, false) AS valid FROM documents), r AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS candidates_before, coalesce(sum(valid::INT) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS vb FROM v), kept AS (SELECT * FROM r WHERE vb < (SELECT count(*) // 20 FROM documents) AND candidates_before < (SELECT count(*) // 5 FROM documents))"
_REMAIN = """s AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), q AS (SELECT *, n * 77 / (SELECT sum(n) FROM s) AS quota FROM s),
  a AS (SELECT source, n, (CASE WHEN (SELECT sum(n) FROM s) <= 77 THEN n ELSE floor(quota) END)::BIGINT AS low, row_number() OVER (ORDER BY round(quota - floor(quota), 9) DESC, source) AS rk FROM q),
  al AS (SELECT source, n, (low + (rk <= (SELECT least(77, sum(n)) - sum(low) FROM a))::INT)::BIGINT AS allocated FROM a)"""
ORACLES = {
    "pack_offsets": f"WITH {_STREAM} SELECT doc_id, doc_no, \"offset\", n_stream FROM st",
    "pack_windows": f"WITH {_WIN} SELECT * FROM win",
    "pack_tokens": rf"""WITH {_STREAM}, tok AS (SELECT doc_no, unnest([0::BIGINT] || list_transform(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> ''), lambda w: length(w)::BIGINT) || [1::BIGINT]) AS id, unnest(range(n_stream)) + "offset" AS spot FROM st),
        nx AS (SELECT spot // {CONTEXT} AS window_id, id, doc_no, lead(id, 1, NULL) OVER (PARTITION BY spot // {CONTEXT} ORDER BY spot) AS nxt FROM tok)
        SELECT window_id, sum(id)::BIGINT AS input_sum, sum(coalesce(nxt, id))::BIGINT AS target_sum, sum(doc_no)::BIGINT AS doc_sum FROM nx GROUP BY window_id HAVING count(*) = {CONTEXT}""",
    "doc_positions": f"WITH {_SEG} SELECT w AS window_id, doc_no, seg_start::BIGINT AS seg_start, seg_len - 1 AS last_position FROM seg",
    "pack_batches": f"WITH {_WIN}, b AS (SELECT *, window_id // {BATCH} AS batch_id FROM win) SELECT batch_id, count(*) AS windows, sum(tokens)::BIGINT AS tokens, min(first_doc) AS first_doc FROM b GROUP BY batch_id HAVING count(*) = {BATCH}",
    "source_exhaustion": f"WITH {_SIZED}, sh(source, share) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in MIX_SHARES.items()) + ") SELECT source AS domain, sum(n_words + 2)::BIGINT AS tokens, floor(sum(n_words + 2) / share)::BIGINT AS runs_out_at FROM sized JOIN sh USING (source) WHERE n_words > 0 GROUP BY source, share",
    "lm_chunks": f"""WITH {_SIZED}, h AS (SELECT sum(n_words)::BIGINT // 2 AS half FROM sized), c AS (SELECT doc_id, start, least(start + 128, n_words) AS e FROM (SELECT doc_id, n_words, unnest(range(0, n_words, 128)) AS start FROM sized WHERE n_words >= 2)),
        r AS (SELECT *, coalesce(sum(e - start - 1) OVER (ORDER BY doc_id, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE e - start >= 2)
        SELECT doc_id, start, least(e, start + half - before + 1)::BIGINT AS "end", (least(e, start + half - before + 1) - start - 1)::BIGINT AS scored FROM r, h WHERE before < half AND least(e, start + half - before + 1) - start - 1 >= 1""",
    "gsm8k_clean": f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents WHERE source = 'math_lessons'",
    "final_number": f"SELECT doc_id, ({_NUM})[-1]::DOUBLE AS number FROM documents",
    "repetition_flag": f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, w, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')) AS grams FROM w)
        SELECT doc_id, coalesce(len(w) >= 12 AND (len(list_distinct(w)) < len(w) * 0.2 OR len(list_distinct(grams)) * 2 < len(w) - 4), false) AS repeats FROM g""",
    "reserved_token_filter": f"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^{_WS[1:-1]}]') AND NOT regexp_matches(text, '{_SPECIAL}')",
    "normalized_key": f"SELECT md5({_KEY.replace('{c}', 'text')}) AS key, count(*) AS docs FROM documents GROUP BY ALL",
    "length_limits": "SELECT source, count(*) FILTER (length(text) <= 512) AS within_512, count(*) FILTER (length(text) <= 1024) AS within_1024, count(*) FILTER (length(text) > 2048) AS over_2048 FROM documents GROUP BY source",
    "extract_assistant": rf"WITH a AS (SELECT row_id, CASE WHEN instr(text, 'im_assistant') > 0 THEN substr(text, instr(text, 'im_assistant') + 12) ELSE text END AS t FROM rendered_sft) SELECT row_id, regexp_replace(regexp_extract(t, '(?s)^(.*?)(?:{_SPECIAL}|\z)', 1), '^{_WS}+|{_WS}+$', '', 'g') AS content FROM a",
    "mask_special_tokens": f"SELECT doc_id, {_MASK} AS masked FROM documents WHERE regexp_matches(text, '{_SPECIAL}')",
    "dedup_first_wins": f"SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source, {_KEY.replace('{c}', 'text')} ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1",
    "take_until_valid": f"WITH {_VALID} SELECT doc_id, candidates_before FROM kept WHERE valid",
    "source_manifest": f"WITH {_VALID} SELECT 'english' AS set_name, (SELECT count(*) // 20 FROM documents)::BIGINT AS requested_rows, count(*) AS candidate_rows, sum(valid::INT)::BIGINT AS written_rows, sum(1 - valid::INT)::BIGINT AS filtered_rows FROM kept",
    "reservoir_topk": f"SELECT doc_id, source FROM documents ORDER BY sha256('{SEED}:' || doc_id), doc_id LIMIT 50",
    "preferred_sample": f"SELECT doc_id, source FROM documents ORDER BY coalesce(source = 'papers', false) DESC, sha256('{SEED}:' || doc_id), doc_id LIMIT 30",
    "largest_remainder": f"WITH {_REMAIN} SELECT * FROM al",
    "ratio_subset": f"WITH {_REMAIN}, rk AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('{SEED}:' || doc_id), doc_id) AS rn FROM documents) SELECT doc_id, source FROM rk JOIN al USING (source) WHERE rn <= allocated",
    "mixture_manifest": f"WITH {_PLAN} SELECT *, greatest(requested - selected, 0) AS deficit, greatest(selected - requested, 0) AS extra FROM pl",
    "mixture_select": f"WITH {_MIX} SELECT * FROM mixed",
    "mixture_line_keys": "SELECT source, count(*) AS lines, count(*) AS keys, count(DISTINCT coalesce(lang, '-')) AS texts FROM documents WHERE source IN (" + ", ".join(f"'{s}'" for s in MIX_SHARES) + ") GROUP BY source",
    "sft_batches": f"WITH {_MIX} SELECT epoch, place // {BATCH} AS batch_no, count(*) AS rows, sum(doc_id)::BIGINT AS doc_sum FROM mixed, (VALUES (0), (1)) e(epoch) WHERE place // {BATCH} < (SELECT count(*) // {BATCH} FROM mixed) GROUP BY ALL",
}
