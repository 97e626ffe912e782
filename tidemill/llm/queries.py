"""Queries over the operators for training data, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import defects, ledger, leaks, mixing, overlap, packing, readability
from tidemill.runtime import bounded, written

FIXTURE = "sft_public_tool_fixture"


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# p1: the same or nearly the same texts across splits


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    dialogues = _read(spark, sf, "sft_row").select(F.lit("sft_row").alias("table_name"), F.col("row_id").alias("row_key"), "split", overlap.dialogue_text().alias("text"))
    requests = _read(spark, sf, FIXTURE).select(F.lit(FIXTURE).alias("table_name"), F.col("row_no").alias("row_key"), "split", F.col("query").alias("text"))
    return dialogues.unionByName(requests)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = overlap.cross_split_pairs(_texts(spark, sf))
    return pairs.select("table_name", F.least("train_key", "held_key").alias("key_a"), F.greatest("train_key", "held_key").alias("key_b"))


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out rows with an overlap, and pairs, per table, split and source."""
    per_row = overlap.cross_split_overlap(_texts(spark, sf)).held_rows()
    dialogues = _read(spark, sf, "sft_row").select(F.lit("sft_row").alias("table_name"), F.col("row_id").alias("held_key"), "split", "source")
    requests = _read(spark, sf, FIXTURE).select(F.lit(FIXTURE).alias("table_name"), F.col("row_no").alias("held_key"), "split", F.col("origin").alias("source"))
    rows = dialogues.unionByName(requests).join(per_row, ["table_name", "held_key"])
    return rows.groupBy("table_name", "split", "source").agg(F.count(F.lit(1)).alias("held_out_rows"), F.sum("n").alias("pairs"), F.sum((F.col("best") >= 1).cast("bigint")).alias("exact_rows"))


# p2: broken pairs


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return defects.dialogue_defects(_read(spark, sf, "sft_row")).unionByName(defects.pair_defects(_read(spark, sf, FIXTURE), "row_no", "query", "answers", FIXTURE))


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Defects per table and kind."""
    return p2_found(spark, sf).groupBy("table_name", "defect").agg(F.count(F.lit(1)).alias("replies"), F.countDistinct("row_key").alias("rows"))


# p3: filling containers


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packing.split_items(packing.pack(packing.spec_items(spark, sf)))


P3_FOUND_SQL = """
SELECT s.spec_name, r.row_id AS item_key FROM pack_spec s JOIN rendered_sft r ON s.table_name = 'rendered_sft' AND len(r.token_ids) > s.capacity
UNION ALL
SELECT s.spec_name, d.doc_id AS item_key FROM pack_spec s JOIN documents d ON s.table_name = 'documents' AND strlen(d.text) > s.capacity
"""


def p3_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, contents and unused space per spec and container size."""
    return packing.fill_report(packing.pack(packing.spec_items(spark, sf)))


def p3_joint(spark: SparkSession, sf: str) -> DataFrame:
    """The same with all capacities of a table permitted together."""
    return packing.fill_report(packing.pack(packing.spec_items(spark, sf, joint=True)))


def p3_space(spark: SparkSession, sf: str) -> DataFrame:
    """What is packed of each spec: all of it."""
    return packing.space_report(written(packing.pack(packing.spec_items(spark, sf)), "packed")).select("spec_name", "items", "units")


def p3_bound(spark: SparkSession, sf: str) -> DataFrame:
    """The containers' space against the least possible, the volume of their contents."""
    return packing.space_report(written(packing.pack(packing.spec_items(spark, sf)), "packed"))


def p3_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of the packed token arrays, cut to their pieces: per spec as many tokens, with the same sum, as the table has."""
    specs = _read(spark, sf, "pack_spec").where("table_name = 'rendered_sft'").select("spec_name", "capacity")
    packed = packing.pack(packing.spec_items(spark, sf)).join(bounded(specs.select("spec_name"), "specs"), "spec_name", "left_semi")
    pieces = packing.token_windows(packed, _read(spark, sf, "rendered_sft"), "row_id", "token_ids", bounded(specs, "specs"))
    return pieces.groupBy("spec_name").agg(F.sum(F.size("content")).alias("tokens"), F.sum(F.aggregate("content", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("id_sum"))


P3_SPACE_SQL = """
SELECT s.spec_name, count(*) AS items, sum(n)::BIGINT AS units FROM pack_spec s JOIN
  (SELECT 'rendered_sft' AS table_name, len(token_ids) AS n FROM rendered_sft UNION ALL SELECT 'documents', strlen(text) FROM documents) i USING (table_name)
WHERE n > 0 GROUP BY s.spec_name
"""
P3_TOKENS_SQL = """
SELECT s.spec_name, sum(len(token_ids))::BIGINT AS tokens, sum(list_sum(token_ids))::BIGINT AS id_sum FROM pack_spec s JOIN rendered_sft r ON s.table_name = 'rendered_sft' WHERE len(token_ids) > 0 GROUP BY s.spec_name
"""


# p5: copies in other formatting


def _batches(spark: SparkSession, sf: str) -> list[DataFrame]:
    """The rows as they came: all up to the last month of loading, then those of that month and undated ones."""
    rows = _read(spark, sf, FIXTURE)
    last = rows.agg(F.date_trunc("month", F.max("loaded_at"))).first()[0]
    if last is None:
        return [rows]
    early = F.coalesce(F.col("loaded_at") < F.lit(last), F.lit(False))
    return [rows.where(early), rows.where(~early)]


def _collapsed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return ledger.collapse(_batches(spark, sf), "row_no", ["query", "hash_id"], ["answers", "tools"])


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.copies(*_collapsed(spark, sf)).select(F.col("first_id").alias("first_no"), F.col("copy_id").alias("copy_no"))


def p5_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many records there are with each number of copies."""
    return _collapsed(spark, sf)[0].groupBy("copies").agg(F.count(F.lit(1)).alias("records"))


#: Invisible characters, as in functions.normalize.
_UNSEEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}]"
_FOLDED = lambda x: f"replace(lower(nfc_normalize(regexp_replace({x}, '{_UNSEEN}', '', 'g'))), 'ß', 'ss')"
_SQUASHED = lambda x: rf"regexp_replace({_FOLDED(x)}, '[^\p{{L}}\p{{N}}]', '', 'g')"
#: Each JSON field as its nodes by path, names squashed and in order; text that isn't JSON squashed. Rows of equal keys are copies.
P5_KEYED = f"""texts AS (SELECT row_no, 'answers' AS field, {_FOLDED('answers')} AS t FROM sft_public_tool_fixture WHERE answers IS NOT NULL UNION ALL SELECT row_no, 'tools', {_FOLDED('tools')} FROM sft_public_tool_fixture WHERE tools IS NOT NULL),
  once AS (SELECT *, CASE WHEN json_valid(t) AND json_type(t) = 'VARCHAR' THEN t->>'$' ELSE t END AS u FROM texts),
  node AS (
    SELECT row_no, field, '' AS path, u::JSON AS v FROM once WHERE json_valid(u) AND json_type(u) IN ('OBJECT', 'ARRAY')
    UNION ALL
    SELECT row_no, field, n.path || CASE json_type(n.v) WHEN 'OBJECT' THEN '.' || {_SQUASHED('k.key')} ELSE '[' || lpad(k.key, 6, '0') END AS path, coalesce(k.value, 'null'::JSON) AS v FROM node n, json_each(n.v) k WHERE json_type(n.v) IN ('OBJECT', 'ARRAY')
  ),
  written AS (SELECT row_no, field, string_agg(path || '=' || CASE json_type(v) WHEN 'OBJECT' THEN '' WHEN 'ARRAY' THEN '-' WHEN 'NULL' THEN 'null' ELSE {_SQUASHED("(v->>'$')")} END, '|' ORDER BY path) AS c FROM node GROUP BY ALL),
  canon AS (SELECT o.row_no, o.field, coalesce(w.c, {_SQUASHED('o.u')}) AS c FROM once o LEFT JOIN written w USING (row_no, field)),
  keyed AS (SELECT f.row_no, {_SQUASHED('query')} AS q, {_SQUASHED('hash_id')} AS h, a.c AS a, t.c AS t FROM sft_public_tool_fixture f LEFT JOIN canon a ON a.row_no = f.row_no AND a.field = 'answers' LEFT JOIN canon t ON t.row_no = f.row_no AND t.field = 'tools'),
  records AS (SELECT row_no, min(row_no) OVER same AS first_no, count(*) OVER same AS copies FROM keyed WINDOW same AS (PARTITION BY q, h, a, t))"""
P5_FOUND_SQL = f"WITH RECURSIVE {P5_KEYED} SELECT first_no, row_no AS copy_no FROM records WHERE row_no <> first_no"
P5_COUNTS_SQL = f"WITH RECURSIVE {P5_KEYED} SELECT copies, count(*) AS records FROM records WHERE row_no = first_no GROUP BY copies"


# p6: leaked evaluation texts


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaks(_read(spark, sf, "documents"), _read(spark, sf, "benchmark_item")).select("doc_id", "item_id")


def p6_items(spark: SparkSession, sf: str) -> DataFrame:
    """Every item that leaked: in how many documents, and at best how much of it."""
    found = leaks.leaks(_read(spark, sf, "documents"), _read(spark, sf, "benchmark_item"))
    items = _read(spark, sf, "benchmark_item").select("item_id", "bench", "split")
    per_item = found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max(F.round(F.col("shared_words") / F.col("item_words"), 6)).alias("largest_share"))
    return per_item.join(items, "item_id")


# p7: mixing sources


def _mixture(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sized = mixing.source_sizes(_read(spark, sf, "documents"))
    plan = written(mixing.mix_plan(sized, _read(spark, sf, "mix_target")), "plan")
    return mixing.mix(sized, plan), plan


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf)).where("short").select("mix_name", "source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*_mixture(spark, sf))


# p8: reading level


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    profiles = written(readability.reading_profiles(_read(spark, sf, "documents")), "profiles")
    return readability.reading_levels(profiles, readability.fit_bounds(profiles, _read(spark, sf, "reading_label")))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("doc_id", "level")


def p8_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by source and level."""
    sources = _read(spark, sf, "documents").select("doc_id", "source")
    levels = _levels(spark, sf).join(sources, "doc_id")
    return levels.groupBy("source", "level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_words").alias("words"), F.round(F.avg("grade"), 6).alias("mean_grade"))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_report, p3_found, p3_fill, p3_joint, p3_space, p3_bound, p3_tokens, p5_found, p5_counts, p6_found, p6_items, p7_found, p7_shares, p8_found, p8_profile)}
ORACLES = {"p3_found": P3_FOUND_SQL, "p3_space": P3_SPACE_SQL, "p3_tokens": P3_TOKENS_SQL, "p5_found": P5_FOUND_SQL, "p5_counts": P5_COUNTS_SQL}
