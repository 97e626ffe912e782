"""Writing corpora, manifests, mixtures, scorecards and logs. Manifests go last and by rename, so a reader sees all or nothing."""

from __future__ import annotations

import hashlib
import json
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import runtime
from tidemill.operators.corpus import BYTES_PER_TOKEN


def write_corpus(docs: DataFrame, path: str) -> None:
    """Documents as JSON lines by split and domain."""
    docs.select("split", F.col("domain").alias("part"), "domain", "text").write.mode("overwrite").partitionBy("split", "part").json(path)


def write_text(docs: DataFrame, path: str, by: str) -> None:
    """Documents as plain lines, one directory for each value of a column; line breaks inside become blanks."""
    docs.select(by, F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines with their nulls."""
    rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def replace_json(path: str, value: object) -> None:
    """Writes JSON so that the file is never half there, on any file system Spark knows."""
    runtime.write_text(SparkSession.builder.getOrCreate(), str(path), json.dumps(value, ensure_ascii=False, indent=2) + "\n")


def read_json(path: str) -> dict | None:
    """What replace_json wrote; None if it isn't there."""
    spark = SparkSession.builder.getOrCreate()
    return json.loads(runtime.read_text(spark, str(path))) if runtime.exists(spark, str(path)) else None


def upsert_manifest(path: str, key: str, entry: dict) -> dict:
    """Puts one source's entry into a manifest of several."""
    whole = (read_json(path) or {}) | {key: entry}
    replace_json(path, whole)
    return whole


def corpus_manifests(per_domain: DataFrame, fingerprint: str, path: str) -> dict[str, dict]:
    """One manifest for each split, from the counts per split and domain: a row for each configured component."""
    out: dict[str, dict] = {}
    for r in per_domain.orderBy("split", "domain").collect():  # one row for each split and configured component
        m = out.setdefault(r["split"], {"split": r["split"], "fingerprint": fingerprint, "files": [], "doc_count": 0, "byte_count": 0})
        m["files"].append({"path": f"split={r['split']}/part={r['domain']}", "domain": r["domain"], "target_fraction": r["fraction"], "doc_count": r["doc_count"], "byte_count": r["byte_count"], "estimated_token_count": r["estimated_tokens"]})
        m["doc_count"] += r["doc_count"]
        m["byte_count"] += r["byte_count"]
    for split, m in out.items():
        m["estimated_token_count"] = m["byte_count"] // BYTES_PER_TOKEN
        replace_json(f"{path}/{split}.manifest.json", m)
    return out


def fingerprint(config: object) -> str:
    """SHA-256 of a configuration as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


#: Hashes under one node of the tree, and its levels: enough for 10**12 rows, fixed so that a hash doesn't hang on their number.
FAN_IN, LEVELS = 1024, 4


def content_hash(rows: DataFrame, value: str, order: str) -> DataFrame:
    """SHA-256 of a tree over ordered rows, numbered from 0 by order: no task sees more than FAN_IN hashes of a level below.

    It tells whether two outputs hold the same rows in the same order; file_hashes tells the same of files."""
    level = rows.select(F.col(order).cast("bigint").alias("at"), F.sha2(value, 256).alias("h"))
    for _ in range(LEVELS):
        level = level.groupBy(F.floor(F.col("at") / FAN_IN).alias("at")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256).alias("h"))
    return level.agg(F.max_by("h", F.lit(0)).alias("sha256"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_bytes, sha256) of every file below a path, hashed where it is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def publish(draft: str, final: str) -> None:
    """Puts a finished directory in the place of another one; if it can't be moved there, the other one is put back."""
    spark = SparkSession.builder.getOrCreate()
    old = f"{final}.old-{time.time_ns()}"
    there = runtime.exists(spark, final)
    if there:
        runtime.rename(spark, final, old)
    try:
        runtime.rename(spark, draft, final)
    except Exception:
        if there:
            runtime.rename(spark, old, final)
        raise
    runtime.delete(spark, old)


def append_points(points: DataFrame, path: str) -> None:
    points.write.mode("append").json(path)


_STEP = re.compile(r"step_(\d+)")


def expired(names: list[tuple[str, float]], keep: int) -> list[str]:
    """Of (name, time of change), the step_N directories beyond the newest to keep; others are never named."""
    steps = sorted((changed, int(m[1]), name) for name, changed in names if (m := _STEP.fullmatch(name)))
    return [name for _, _, name in steps[: max(0, len(steps) - keep)]]


def scorecard(rows: DataFrame, by: str, path: str) -> dict:
    """Metrics as nested JSON, one entry for each checkpoint or benchmark."""
    card = {r[by]: {k: v for k, v in r.asDict().items() if k != by} for r in rows.collect()}  # one row for each entry
    replace_json(path, card)
    return card


def report_lines(entries: list[dict]) -> list[str]:
    """Entries as tab-separated lines under their names: floats with four digits, nothing as a dash."""
    if not entries:
        return []
    shown = lambda v: "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    names = list(entries[0])
    return ["\t".join(names), *("\t".join(shown(e.get(n)) for n in names) for e in entries)]
