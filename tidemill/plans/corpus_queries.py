"""Corpus build, budgets, manifests and checks, over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import expr as E
from tidemill.operators import corpus as C
from tidemill.operators.prefix import hash_slot, positions, slot_digits

SEED, VAL, TEST = 42, 0.05, 0.02
FRACTIONS = {"en": 0.7, "de": 0.1, "fr": 0.1, "es": 0.05, "none": 0.03, "it": 0.02}


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")


def _fractions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FRACTIONS.items()), "domain string, fraction double")


def _budget(spark: SparkSession, sf: str) -> int:
    """Two fifths of all bytes there are."""
    return (C.encoded(_docs(spark, sf), "lang").agg(F.sum("n_bytes")).first()[0] or 0) * 2 // 5


def _cut(spark: SparkSession, sf: str) -> DataFrame:
    cut = C.budget_cut(C.encoded(_docs(spark, sf), "lang"), C.domain_targets(_fractions(spark), _budget(spark, sf)))
    return C.with_split(cut, SEED, VAL, TEST)


_FRACTIONS_SQL = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in FRACTIONS.items()) + ") f(domain, fraction)"
_HEX = "('0x' || substr(sha256('{seed}:' || text), 1, 8))::BIGINT % 10000 / 10000.0::DOUBLE"
_SPLIT = f"CASE WHEN {_HEX} < {TEST} THEN 'test' WHEN {_HEX} < {TEST + VAL} THEN 'val' ELSE 'train' END".replace("{seed}", str(SEED))
_ENCODED = r"""
enc AS (SELECT doc_id AS pos, coalesce(lang, 'none') AS domain, text,
  strlen(to_json({'domain': coalesce(lang, 'none'), 'text': text})::VARCHAR) + 4 AS n_bytes FROM documents WHERE regexp_matches(text, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F\x0B]'))
"""
_CUT = f"""
WITH {_ENCODED}, tgt AS (SELECT domain, fraction, floor((SELECT sum(n_bytes)::BIGINT * 2 // 5 FROM enc) * fraction)::BIGINT AS target FROM {_FRACTIONS_SQL}),
run AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  row_number() OVER (PARTITION BY domain ORDER BY pos) AS rn FROM enc),
cut AS (SELECT pos, run.domain, text, n_bytes, {_SPLIT} AS split FROM run JOIN tgt USING (domain) WHERE before < target OR rn = 1),
man AS (SELECT s.split, f.domain, f.fraction, coalesce(c.doc_count, 0)::BIGINT AS doc_count, coalesce(c.byte_count, 0)::BIGINT AS byte_count
  FROM (VALUES ('train'), ('val'), ('test')) s(split) CROSS JOIN {_FRACTIONS_SQL}
  LEFT JOIN (SELECT split, domain, count(*) AS doc_count, sum(n_bytes) AS byte_count FROM cut GROUP BY ALL) c ON c.split = s.split AND c.domain = f.domain)
"""


def corpus_nonblank(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where(E.nonblank("text")).select("doc_id", F.length("text").cast("bigint").alias("chars"))


def corpus_extract_text(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text field is blank fall back to nothing; rows read without a field become their JSON."""
    d = _docs(spark, sf)
    return d.select("doc_id", E.extracted_text(d, "text").isNotNull().alias("has_text"), F.get_json_object(E.extracted_text(d, None), "$.source").alias("json_source"))


def corpus_encoded_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return C.encoded(_docs(spark, sf), "lang").select("pos", "domain", "n_bytes")


def corpus_split(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_split(C.encoded(_docs(spark, sf), "lang"), SEED, VAL, TEST).select("pos", "split")


def corpus_budget_cut(spark: SparkSession, sf: str) -> DataFrame:
    return _cut(spark, sf).select("pos", "domain", "n_bytes", "split")


def tokenizer_sample_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The same cut by plain text bytes, half of each source, as a sample to train a tokenizer on."""
    d = C.encoded(_docs(spark, sf), "source").withColumn("n_bytes", (F.octet_length("text") + 1).cast("bigint"))
    targets = d.groupBy("domain").agg(F.floor(F.sum("n_bytes") / 2).cast("bigint").alias("target"))
    return C.budget_cut(d, targets).groupBy("domain").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_bytes").alias("bytes"))


def corpus_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return C.manifest(_cut(spark, sf), _fractions(spark))


def corpus_split_totals(spark: SparkSession, sf: str) -> DataFrame:
    return C.split_totals(C.manifest(_cut(spark, sf), _fractions(spark)))


def corpus_component_fill(spark: SparkSession, sf: str) -> DataFrame:
    return C.component_fill(_cut(spark, sf), C.domain_targets(_fractions(spark), _budget(spark, sf)), 0.9).select("domain", "target", "byte_count", "filled")


def corpus_split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    docs = C.with_split(C.encoded(_docs(spark, sf), "source"), SEED, VAL, TEST)
    return docs.agg(F.countDistinct(F.md5("text")).alias("texts"), F.count(F.lit(1)).alias("docs")).join(F.broadcast(C.split_leakage(docs).agg(F.count(F.lit(1)).alias("leaked"))))


def corpus_existing_check(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest checked against a listing in which one domain's files are gone and another's have grown."""
    man = C.manifest(_cut(spark, sf), _fractions(spark))
    listing = man.where("domain <> 'es'").select("split", "domain", F.when(F.col("domain") == "de", F.col("byte_count") + 1).otherwise(F.col("byte_count")).alias("file_bytes"))
    return C.existing_check(man, listing).select("split", "domain", "status")


def source_shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).withColumn("domain", F.coalesce("source", F.lit("none"))).withColumn("h", E.hash_order(F.concat_ws(":", "domain", "doc_id"), SEED))
    return positions(d, hash_slot("h", slot_digits(d.count())), ["h", "doc_id"], ["domain"]).select("domain", "doc_id", "pos")


def corpus_fractions(spark: SparkSession, sf: str) -> DataFrame:
    man = C.manifest(_cut(spark, sf), _fractions(spark)).groupBy("domain").agg(F.lit(0.0).alias("fraction"), F.sum("estimated_tokens").alias("tokens"))
    return C.normalized_fractions(man).withColumn("share", F.round("share", 9))


def estimated_steps(spark: SparkSession, sf: str) -> DataFrame:
    return C.estimated_steps(C.manifest(_cut(spark, sf), _fractions(spark)), 8, 256)


QUERIES = {f.__name__: f for f in (corpus_nonblank, corpus_extract_text, corpus_encoded_bytes, corpus_split, corpus_budget_cut, tokenizer_sample_cut, corpus_manifest, corpus_split_totals, corpus_component_fill, corpus_split_leakage, corpus_existing_check, source_shuffle_order, corpus_fractions, estimated_steps)}
_NONBLANK = _ENCODED.split("WHERE ")[1].strip().removesuffix(")")
_PER_SPLIT = "split, sum(doc_count)::BIGINT AS doc_count, sum(byte_count)::BIGINT AS byte_count"
ORACLES = {
    "corpus_nonblank": f"SELECT doc_id, length(text)::BIGINT AS chars FROM documents WHERE {_NONBLANK}",
    "corpus_extract_text": f"SELECT doc_id, coalesce({_NONBLANK}, false) AS has_text, source AS json_source FROM documents",
    "corpus_encoded_bytes": f"WITH {_ENCODED} SELECT pos, domain, n_bytes FROM enc",
    "corpus_split": f"WITH {_ENCODED} SELECT pos, {_SPLIT} AS split FROM enc",
    "corpus_budget_cut": f"{_CUT} SELECT pos, domain, n_bytes, split FROM cut",
    "tokenizer_sample_cut": f"""WITH src AS (SELECT doc_id AS pos, coalesce(source, 'none') AS domain, strlen(text) + 1 AS n FROM documents WHERE {_NONBLANK}),
        run AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY domain ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY domain) AS every FROM src)
        SELECT domain, count(*) AS docs, sum(n)::BIGINT AS bytes FROM run WHERE before < every // 2 OR before = 0 GROUP BY domain""",
    "corpus_manifest": f"{_CUT} SELECT *, byte_count // 4 AS estimated_tokens FROM man",
    "corpus_split_totals": f"{_CUT} SELECT {_PER_SPLIT}, sum(byte_count)::BIGINT // 4 AS estimated_tokens FROM man GROUP BY split",
    "corpus_component_fill": f"{_CUT} SELECT t.domain, t.target, coalesce(sum(n_bytes), 0)::BIGINT AS byte_count, coalesce(sum(n_bytes), 0) >= t.target * 0.9 AS filled FROM tgt t LEFT JOIN cut USING (domain) GROUP BY t.domain, t.target",
    "corpus_split_leakage": f"WITH {_ENCODED} SELECT count(DISTINCT text) AS texts, count(*) AS docs, 0::BIGINT AS leaked FROM enc",
    "corpus_existing_check": f"{_CUT} SELECT split, domain, CASE domain WHEN 'es' THEN 'missing' WHEN 'de' THEN 'changed' ELSE 'ok' END AS status FROM man",
    "source_shuffle_order": f"SELECT coalesce(source, 'none') AS domain, doc_id, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY sha256('{SEED}:' || coalesce(source, 'none') || ':' || doc_id), doc_id) - 1 AS pos FROM documents",
    "corpus_fractions": f"{_CUT} SELECT domain, round(sum(byte_count // 4) / (SELECT sum(byte_count // 4) FROM man), 9) AS share FROM man GROUP BY domain",
    "estimated_steps": f"{_CUT} SELECT split, (sum(byte_count // 4) + 2 * sum(doc_count))::BIGINT AS tokens, ((sum(byte_count // 4) + 2 * sum(doc_count)) // 2048)::BIGINT AS steps FROM man GROUP BY split",
}
