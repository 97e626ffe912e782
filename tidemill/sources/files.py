"""Reading corpora, chat rows, benchmarks and run logs from files."""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import runtime
from tidemill.functions.expr import is_json_object, nonblank
from tidemill.operators.prefix import positions
from tidemill.runtime import bounded


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines (file, line_no, value), numbered from 0 in each file; blank lines have their number.

    Files may be split among tasks: lines are counted per split, and splits are put in order of where they begin."""
    paths = [path] if isinstance(path, str) else list(path)
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_from"), F.monotonically_increasing_id().alias("_id"), "value")
    return positions(lines, F.col("_from"), ["_from", "_id"], ["file"], "line_no").select("file", "line_no", "value")


def json_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, text) of JSON lines: the text field if it isn't blank, else the whole row; blank lines are skipped.

    A line that isn't an object is an error that shows the line."""
    lines = spark.read.text([path] if isinstance(path, str) else list(path)).where(nonblank("value"))
    checked = F.when(is_json_object("value"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 200))))
    text = F.get_json_object(checked, "$.text")
    return lines.select(F.input_file_name().alias("file"), F.when(nonblank(text), text).otherwise(checked).alias("text"))


def text_documents(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(file, text): each line that isn't blank is a document."""
    return spark.read.text([path] if isinstance(path, str) else list(path)).where(nonblank("value")).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def corpus_sources(path: str, spark: SparkSession | None = None) -> list[dict]:
    """A corpus directory's files with domain, fraction and tokens: by its manifest, else all .jsonl, else all .txt."""
    spark = spark or SparkSession.builder.getOrCreate()
    at, stem = path.rstrip("/"), lambda name: name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    plain = lambda p: {"path": p, "domain": stem(p), "fraction": 0.0, "tokens": 0}
    if runtime.exists(spark, at) and not runtime.is_dir(spark, at):
        return [plain(at)]
    if runtime.exists(spark, f"{at}/manifest.json"):
        out = []
        for f in json.loads(runtime.read_text(spark, f"{at}/manifest.json")).get("files", []):
            if not runtime.exists(spark, f"{at}/{f['path']}"):
                raise FileNotFoundError(f"{at}/{f['path']} is in the manifest only")
            tokens = f["token_count"] if f.get("token_count") is not None else f.get("estimated_token_count", 0)
            out.append({"path": f"{at}/{f['path']}", "domain": f.get("domain", stem(f["path"])), "fraction": float(f.get("target_fraction") or 0), "tokens": tokens + 2 * f.get("doc_count", 0)})
        return out
    names = [name for name, *_ in runtime.listing(spark, at)] if runtime.is_dir(spark, at) else []
    found = [n for n in names if n.endswith(".jsonl")] or [n for n in names if n.endswith(".txt")]
    if not found:
        raise FileNotFoundError(f"no documents in {at}")
    return [plain(f"{at}/{n}") for n in found]


def corpus_documents(spark: SparkSession, path: str) -> DataFrame:
    """(domain, text) of a corpus directory. Files of a kind are read as one, and their domains joined on by name."""
    sources = corpus_sources(path, spark)
    out = None
    for read, end in ((text_documents, ".txt"), (json_documents, "")):
        own = [s for s in sources if s["path"].endswith(".txt") == (end == ".txt")]
        if not own:
            continue
        if len({s["domain"] for s in own}) == 1:
            part = read(spark, [s["path"] for s in own]).select(F.lit(own[0]["domain"]).alias("domain"), "text")
        else:
            domains = bounded(spark.createDataFrame([(s["path"].rsplit("/", 1)[-1], s["domain"]) for s in own], "_name string, domain string"), "files of a corpus")
            part = read(spark, [s["path"] for s in own]).withColumn("_name", F.url_decode(F.element_at(F.split("file", "/"), -1))).join(domains, "_name").select("domain", "text")
        out = part if out is None else out.unionByName(part)
    return out


def chat_rows(spark: SparkSession, path: str, schema: str, problems: Column | None = None) -> DataFrame:
    """Chat rows of JSON lines, with file and line number; problems, if given, are named in an error with the line."""
    rows = numbered_lines(spark, path).where(nonblank("value")).withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    rows = rows.select("file", "line_no", F.col("row.*"))
    if problems is None:
        return rows
    bad = F.when(F.size(problems) > 0, F.raise_error(F.format_string("%s:%d: %s", "file", F.col("line_no") + 1, F.array_join(problems, ", "))).cast("boolean")).otherwise(True)
    return rows.where(bad)


def benchmark_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a benchmark's directory: the files its manifest lists, Parquet or JSON lines, gzip or not. A broken line is an error."""
    at = path.rstrip("/")
    manifest = f"{at}/manifest.json"
    listed = json.loads(runtime.read_text(spark, manifest))["files"] if runtime.exists(spark, manifest) else [n for n, *_ in runtime.listing(spark, at) if not n.endswith(".md")]
    kinds: dict[bool, list[str]] = {}
    for name in listed:
        if not runtime.exists(spark, f"{at}/{name}"):
            raise FileNotFoundError(f"{at}/{name}")
        if not name.endswith((".parquet", ".jsonl", ".json", ".jsonl.gz", ".json.gz")):
            raise ValueError(f"unknown kind of file: {at}/{name}")
        kinds.setdefault(name.endswith(".parquet"), []).append(f"{at}/{name}")
    if not kinds:
        raise FileNotFoundError(f"no files listed for {at}")
    out = None
    for parquet, paths in kinds.items():
        part = spark.read.option("mergeSchema", True).parquet(*paths) if parquet else spark.read.json(paths, mode="FAILFAST")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def exported_rows(spark: SparkSession, path: str, seed: int | None = None) -> DataFrame:
    """Rows of a dataset's local export, Parquet or JSON lines, with their place pos: in the order of the files, or, with a seed, in
    a hash order of their content, so that the first of them are a sample."""
    rows = benchmark_rows(spark, path) if runtime.is_dir(spark, path) else spark.read.parquet(path) if path.endswith(".parquet") else spark.read.json(path, mode="FAILFAST")
    if seed is None:
        return rows.withColumn("pos", F.monotonically_increasing_id())
    # equal rows come one after the other
    order = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})), 256), 1, 12), 16, 10).cast("bigint")
    placed = rows.withColumn("_h", order).withColumn("_n", F.monotonically_increasing_id())
    return positions(placed, F.shiftright("_h", 36), ["_h", "_n"], [], "pos").drop("_h", "_n")


def directory_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(directory, files, n_bytes) of every directory below a path, from the listing alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return listed.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("n_bytes"))


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first rows by order, or all: a limit on what is evaluated."""
    return rows if most is None else rows.orderBy(order).limit(most)


def hub_url_parts(url: Column) -> dict[str, Column]:
    """Repository, revision and path of an hf://datasets/... URL; empty where it is none."""
    pattern = r"^hf://datasets/([^/@]+/[^/@]+)(?:@([^/]+))?/(.+)$"
    return {"repository": F.regexp_extract(url, pattern, 1), "revision": F.regexp_extract(url, pattern, 2), "path": F.regexp_extract(url, pattern, 3)}


def run_logs(spark: SparkSession, root: str) -> DataFrame:
    """Run logs under a root, the newest first; equal times by path. Contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "run.jsonl").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("modificationTime").alias("modified"), "length").orderBy(F.desc("modified"), "path")


def run_log_path(root: str, run: str) -> Path:
    """A run's log below the root; an error if it would lie outside."""
    base = Path(root).resolve()
    path = (base / run).resolve()
    if not path.is_relative_to(base) or path.name != "run.jsonl" or not path.is_file():
        raise FileNotFoundError(run)
    return path


def optional_rows(spark: SparkSession, path: str) -> DataFrame:
    """Lines (file, line_no, value) that aren't blank, of a file or directory that may be missing; then there are none."""
    if not runtime.exists(spark, path):
        return spark.createDataFrame([], "file string, line_no bigint, value string")
    return numbered_lines(spark, path).where(nonblank("value"))
