"""Whole runs: corpus build, source preparation, mixtures, training batches and scorecards, each ending in files or one DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import runtime
from tidemill.config import BatchConfig, BundleConfig, CorpusConfig, MixtureConfig, as_dict
from tidemill.functions import tokenizer
from tidemill.functions.expr import nonblank, normalized_key, stripped
from tidemill.operators import benchmarks, chat, corpus, generate, metrics, sampling, toolrows, windows
from tidemill.operators.dedup import first_wins
from tidemill.operators.prefix import id_slot, positions
from tidemill.runtime import bounded, written
from tidemill.sources import files, sinks


def _component(spark: SparkSession, c) -> DataFrame:  # noqa: ANN001 - a Component
    """(pos, domain, text) of a component: Parquet by its field, lines by theirs."""
    if c.path.endswith(".parquet"):
        rows = spark.read.parquet(c.path)
        text = F.col(c.text_field) if c.text_field else F.to_json(F.struct("*"))
        rows = rows.select(text.alias("text"))
    else:
        rows = files.corpus_documents(spark, c.path).select("text")
    kept = rows.where(nonblank("text")).select(F.monotonically_increasing_id().alias("pos"), F.lit(c.name).alias("domain"), "text")
    return written(kept.withColumn("n_bytes", corpus.encoded_bytes("domain", "text").cast("bigint")), "component")


def existing_corpus(config: CorpusConfig) -> dict[str, dict] | None:
    """The manifests of a corpus built by the same configuration, if they and their files are all there."""
    spark, mark, out = SparkSession.builder.getOrCreate(), sinks.fingerprint(as_dict(config)), {}
    for split in ("train", "val", "test"):
        m = sinks.read_json(f"{config.output_dir}/{split}.manifest.json")
        if m is None or m["fingerprint"] != mark or m["split"] != split or {f["domain"] for f in m["files"]} != {c.name for c in config.components}:
            return None
        if any(f["doc_count"] and not runtime.is_dir(spark, f"{config.output_dir}/documents/{f['path']}") for f in m["files"]):
            return None
        if m["byte_count"] != sum(f["byte_count"] for f in m["files"]):
            return None
        out[split] = m
    return out


def build_corpus(spark: SparkSession, config: CorpusConfig, force: bool = False) -> dict[str, dict]:
    """Budgeted, split documents with manifests, unless the same corpus is there already. Manifests are written last."""
    if not force and (there := existing_corpus(config)) is not None:
        return there
    fractions = spark.createDataFrame([(c.name, c.fraction) for c in config.components], "domain string, fraction double")
    docs = None
    for c in config.components:
        part = _component(spark, c)
        docs = part if docs is None else docs.unionByName(part)
    targets = corpus.domain_targets(fractions, config.total_bytes)
    cut = written(corpus.with_split(corpus.budget_cut(docs, targets), config.seed, config.val_fraction, config.test_fraction), "corpus")
    unfilled = corpus.component_fill(cut, targets, config.min_component_fill).where("not filled").select("domain").collect()  # configured components
    if unfilled:
        raise ValueError(f"components below their least fill: {', '.join(sorted(r['domain'] for r in unfilled))}")
    at = f"{config.output_dir}/documents"
    if config.output_format == "txt":
        cut.select("split", F.col("domain").alias("part"), F.regexp_replace("text", r"[\r\n]+", " ").alias("value")).write.mode("overwrite").partitionBy("split", "part").text(at)
    else:
        sinks.write_corpus(cut, at)
    return sinks.corpus_manifests(corpus.manifest(cut, fractions), sinks.fingerprint(as_dict(config)), config.output_dir)


def prepare_rows(rows: DataFrame, order: str, converted: Column, source: str, target: int, output_dir: str, fits: Column | None = None, most_candidates: int | None = None) -> dict:
    """Reads rows in order until target of them convert and fit; writes them and the source's manifest entry.

    converted gives a row's messages or null; fits, over the messages column, is the context filter."""
    judged = rows.withColumn("messages", converted)
    judged = judged.withColumn("_valid", F.col("messages").isNotNull() & (F.coalesce(fits, F.lit(False)) if fits is not None else F.lit(True)))
    read = written(sampling.take_until_valid(judged, order, "_valid", target, most_candidates), "read")
    path = f"{output_dir}/{source}"
    sinks.write_rows(read.where("_valid").select(F.lit(source).alias("source"), *(c for c in ("tools",) if c in read.columns), "messages"), path)
    return _entry(read, "_valid", source, target, path, output_dir)


def _entry(read: DataFrame, valid: str, source: str, target: int, path: str, output_dir: str, **more: object) -> dict:
    m = sampling.source_manifest(read.withColumn("_s", F.lit(source)), valid, target, "_s").first()
    counts = {k: m[k] for k in ("candidate_rows", "written_rows", "filtered_rows")} if m else {"candidate_rows": 0, "written_rows": 0, "filtered_rows": 0}
    entry = {"source": source, "requested_rows": target, **counts, "output_path": path, **more}
    sinks.upsert_manifest(f"{output_dir}/manifest.json", source, entry)
    return entry


def _tool_set(rows: DataFrame, name: str, output_dir: str) -> dict:
    kept = written(generate.as_chat(rows).withColumn("_valid", F.lit(True)), "tools")
    sinks.write_rows(kept.select(F.lit(name).alias("source"), "tools", "messages"), f"{output_dir}/{name}")
    return _entry(kept, "_valid", name, kept.count(), f"{output_dir}/{name}", output_dir)


def prepare_tool_evaluation(spark: SparkSession, output_dir: str, seed: int, scale: float = 1.0) -> dict[str, dict]:
    """The generated evaluation rows, one set of each kind."""
    rows = generate.evaluation_rows(spark, seed, scale)
    return {f"tool_eval_{k}": _tool_set(rows.where(F.col("kind") == k), f"tool_eval_{k}", output_dir) for k in generate.EVAL_KINDS}


def prepare_tools(spark: SparkSession, output_dir: str, seed: int, scale: float = 1.0) -> dict[str, dict]:
    """The generated tool rows as chat rows: one training set and one evaluation set of each kind."""
    return {"tool_local": _tool_set(generate.training_rows(spark, seed, scale), "tool_local", output_dir)} | prepare_tool_evaluation(spark, output_dir, seed, scale)


def prepare_public_tools(rows: DataFrame, target: int, seed: int, output_dir: str, source: str = "tool_public", preferred: str = "distilabel") -> dict:
    """Public tool rows as chat rows: normalised, the first of each id, hash and query, held-out tools excluded, one origin preferred."""
    spark = rows.sparkSession
    kept = written(toolrows.accepted_tool_rows(rows, generate.held_out_names(spark)), "accepted")
    dropped = rows.count() - kept.count()
    sampled = written(sampling.preferred_sample(kept.withColumn("_p", F.col("origin") == preferred), "row_no", "_p", target, seed).withColumn("_valid", F.lit(True)), "sampled")
    path = f"{output_dir}/{source}"
    sinks.write_rows(toolrows.chat_rows_of_calls(sampled, source).drop("row_no"), path)
    return _entry(sampled, "_valid", source, target, path, output_dir, dropped_rows=dropped)


def _converted(answered: DataFrame, category: str, fields: tuple[str, str], limits: tuple[int, int]) -> DataFrame:
    """(attempt, tools if there are any, messages, reason) of a category's responses."""
    if category == "tool":
        return toolrows.tool_response_rows(answered, chat.parsed_response(F.col("response"))).select("attempt", "tools", "messages", "reason")
    read = chat.math_response(F.col("response"), limits) if category == "math" else chat.response_row(F.col("response"), *fields, limits)
    return answered.withColumn("o", read).select("attempt", "o.*")


def prepare_completions(spark: SparkSession, category: str, fields: tuple[str, str], limits: tuple[int, int], target: int, attempts: int, client_factory: Callable[[], object], output_dir: str, seed: int = 0) -> tuple[dict, DataFrame]:
    """Rows that a model writes, of category assistant, math or tool: prompts, completions, the first of each user text up to target;
    and the reasons of drops. fields and limits are those of the assistant's two fields; limits also hold for a problem and its solution."""
    answered = written(toolrows.complete(generate.prompts(spark, category, target * attempts, seed), client_factory), "answers")
    done = written(_converted(answered, category, fields, limits), "converted")
    reasons = done.groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("responses"))
    asked = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["content"]
    unique = first_wins(done.where("reason is null").withColumn("key", normalized_key(asked)), ["key"], "attempt")
    source = f"internal_{category}"
    return prepare_rows(unique, "attempt", F.col("messages"), source, target, output_dir), reasons


def prepare_all(spark: SparkSession, config: BundleConfig, assistant: DataFrame, math: DataFrame, public_tools: DataFrame, client_factory: Callable[[], object] | None = None) -> dict[str, dict]:
    """All training sources: assistant chats (pos, messages), worked problems (pos, question, answer), public and generated tool
    rows, and, with a client, the rows a model writes. Gives each source's manifest entry; they are also in manifest.json."""
    made = {
        "assistant": prepare_rows(assistant, "pos", chat.plain_chat(F.col("messages")), "assistant", config.assistant_rows, config.output_dir, most_candidates=config.most_candidates),
        "gsm8k": prepare_rows(math, "pos", chat.math_chat(F.col("question"), F.col("answer")), "gsm8k", config.math_rows, config.output_dir, most_candidates=config.most_candidates),
        "tool_public": prepare_public_tools(public_tools, config.tool_rows, config.seed, config.output_dir),
    } | prepare_tools(spark, config.output_dir, config.seed, config.scale)
    for category, n in config.written_rows.items() if client_factory else ():
        entry, _ = prepare_completions(spark, category, ("prompt", "response"), (512, 2048), n, config.attempts, client_factory, config.output_dir, config.seed)
        made[entry["source"]] = entry
    return made


def prepare_eval(spark: SparkSession, config: BundleConfig, assistant: DataFrame, math: DataFrame) -> dict[str, dict]:
    """The held-out bundle: assistant chats, worked problems, and generated tool rows of each evaluation kind."""
    return {
        "assistant_eval": prepare_rows(assistant, "pos", chat.plain_chat(F.col("messages")), "assistant_eval", config.assistant_rows, config.output_dir, most_candidates=config.most_candidates),
        "gsm8k_eval": prepare_rows(math, "pos", chat.math_chat(F.col("question"), F.col("answer")), "gsm8k_eval", config.math_rows, config.output_dir, most_candidates=config.most_candidates),
    } | prepare_tool_evaluation(spark, config.output_dir, config.seed, config.scale)


def mixture_lines(spark: SparkSession, input_dir: str, order: list[str]) -> DataFrame:
    """(source, key, value): the lines of prepared sources. A key is a line's source, file and number, so that equal lines differ."""
    rows = None
    for source in order:
        lines = files.optional_rows(spark, f"{input_dir}/{source}")
        key = F.sha2(F.concat_ws(":", F.lit(source), F.element_at(F.split("file", "/"), -1), "line_no"), 256)
        part = lines.select(F.lit(source).alias("source"), key.alias("key"), "value")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def build_mixture(spark: SparkSession, config: MixtureConfig) -> dict:
    """The mixture of prepared sources by the recipe, or by the fallback recipe if the named source has no rows."""
    order = list(config.order) or sorted(config.recipe)
    rows = mixture_lines(spark, config.input_dir, order)
    rows = written(rows, "sources")
    available = written(rows.groupBy("source").agg(F.count(F.lit(1)).alias("available")), "available")
    recipe, used = config.recipe, "default"
    missing = config.fallback_when_missing
    if missing and config.fallback_recipe is not None and config.recipe.get(missing, 0) > 0 and available.where(F.col("source") == missing).isEmpty():
        recipe, used = config.fallback_recipe, "fallback"
    plan = sampling.mixture_plan(available, recipe, order, config.deficit_policy)
    if config.deficit_policy == "redistribute":
        plan = sampling.check_total(plan)
    plan = written(plan, "plan")
    mixed = written(sampling.mixture(rows, plan, "key", "source", config.seed), "mixture")
    mixed.orderBy("place").select("value").write.mode("overwrite").text(f"{config.output_dir}/mixture")
    manifest = {
        "recipe_used": used, "seed": config.seed, "config_sha256": sinks.fingerprint(as_dict(config)), "total_rows": mixed.count(),
        "output_sha256": sinks.content_hash(mixed, "value", "place").first()[0], "sources": {r["source"]: r.asDict() for r in plan.collect()},  # one row a configured source
    }
    sinks.replace_json(f"{config.output_dir}/mixture.manifest.json", manifest)
    return manifest


def pretrain_windows(docs: DataFrame, order: str, text: str, config: BatchConfig, path: str = tokenizer.TOKENIZER, start_id: int = 0, end_id: int = 1) -> DataFrame:
    """Full batches of token windows (batch_id, slot, input, target, doc_ids) in the order given."""
    ids = written(tokenizer.encoded(docs, [order], text, path).where("size(token_ids) > 0"), "tokens")
    cut = windows.window_segments(windows.stream_offsets(ids.withColumn("n", F.size("token_ids")), "n", order), config.context_length)
    w = windows.window_tokens(cut, "token_ids", start_id, end_id, config.context_length)
    return windows.batches(w, config.batch_size, config.total_tokens, config.context_length)


def sft_training_batches(rows: DataFrame, position: str, tokenizer_path: str, config: BatchConfig, epochs: int = 1) -> DataFrame:
    """Batches (epoch, batch_no, position, input, target, mask) of chat rows in the order of position: rendered as ids, rows that
    don't fit left out, the rest numbered on, padded, and an epoch's partial last batch left out."""
    text = rows.withColumn("tools_text", F.when(F.size("tools") > 0, chat.tool_text(F.col("tools"))))
    ids = written(tokenizer.rendered_ids(text, position, tokenizer_path).where(chat.context_fits("token_ids", "loss_mask", config.context_length)), "ids")
    placed = positions(ids, id_slot(position), [position], [], "_place")
    each = windows.repeated_batches(placed, "_place", config.batch_size, epochs)
    padded = (c.alias(n) for c, n in zip(tokenizer.padded("token_ids", "loss_mask", config.context_length), ("input", "target", "mask"), strict=True))
    return each.select("epoch", "batch_no", position, *padded)


def checkpoint_evaluation(configured: DataFrame, scored: DataFrame, path: str, domains: DataFrame | None = None) -> dict:
    """Loss, perplexity and bits per token of every configured checkpoint, mixed and per domain, as nested JSON; one that wasn't
    scored is there as missing. scored: checkpoint, domain, loss_sum, tokens, batches. With domains (domain), losses of others, whose
    files aren't part of the evaluation, are left out."""
    if domains is not None:
        scored = scored.join(bounded(domains.select("domain").distinct(), "domains"), "domain", "left_semi")
    card: dict = {r["checkpoint"]: {"status": "missing"} for r in configured.select("checkpoint").collect()}  # configured by hand
    for r in metrics.loss_metrics(scored, "domain", ["checkpoint"]).collect():  # one row for each checkpoint and domain
        entry = card.setdefault(r["checkpoint"], {})
        entry["status"] = "ok"
        values = {k: r[k] for k in ("tokens", "batches", "loss", "perplexity", "bits_per_token")}
        if r["domain"] == "mixed":
            entry["mixed"] = values
        else:
            entry.setdefault("domains", {})[r["domain"]] = values
    sinks.replace_json(path, card)
    return card


def mixed_windows(docs: DataFrame, shares: dict[str, float], config: BatchConfig, path: str = tokenizer.TOKENIZER, start_id: int = 0, end_id: int = 1, block: int = 200_000) -> DataFrame:
    """Full batches of token windows over several domains, drawn by the deficit scheduler so that each has its share throughout.

    docs has domain, pos and text; domains without a share are left out. See windows.deficit_order for how exact the order is."""
    spark = docs.sparkSession
    wanted = bounded(spark.createDataFrame(sorted(shares.items()), "domain string, share double"), "domains")
    ids = written(tokenizer.encoded(docs.join(wanted, "domain"), ["domain", "share", "pos"], "text", path).where("size(token_ids) > 0"), "tokens")
    drawn = windows.deficit_order(ids.select("domain", "share", "pos", (F.size("token_ids") + 2).cast("bigint").alias("n_stream")), block)
    placed = positions(drawn, F.col("block"), ["block", "draw"], [], "_place").select("domain", "pos", "_place")
    stream = windows.stream_offsets(ids.join(placed, ["domain", "pos"]).withColumn("n", F.size("token_ids")), "n", "_place")
    w = windows.window_tokens(windows.window_segments(stream, config.context_length), "token_ids", start_id, end_id, config.context_length)
    return windows.batches(w, config.batch_size, config.total_tokens, config.context_length)


def tokenizer_sample(spark: SparkSession, components: dict[str, str], most_bytes: int, output_dir: str) -> dict[str, dict]:
    """Plain lines of each source up to a budget of bytes, for training a tokenizer elsewhere; and a manifest entry for each."""
    made = {}
    for name, path in components.items():
        docs = files.corpus_documents(spark, path).where(nonblank("text")).select(F.lit(name).alias("domain"), F.monotonically_increasing_id().alias("pos"), "text", F.octet_length("text").cast("bigint").alias("n_bytes"))
        targets = spark.createDataFrame([(name, most_bytes)], "domain string, target bigint")
        cut = written(corpus.budget_cut(written(docs, "docs"), targets), "sample")
        sinks.write_text(cut, f"{output_dir}/{name}", "domain")
        n = cut.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
        made[name] = {"documents": n["docs"], "byte_count": n["bytes"], "output_path": f"{output_dir}/{name}"}
        sinks.upsert_manifest(f"{output_dir}/manifest.json", name, made[name])
    return made


def resumed(batches: DataFrame, after_batch: int) -> DataFrame:
    """What is left of batches after one was done: order and numbers never change, so a position is all the state."""
    return batches.where(F.col("batch_id") > after_batch)


def sft_scorecard(configured: DataFrame, cases: DataFrame, outputs: DataFrame, path: str) -> dict:
    """Metrics of every configured checkpoint by category, as nested JSON; a checkpoint without outputs is there as missing.

    cases: category, case_id, expected, expected_tool, expected_arguments, tools_json. outputs: checkpoint, category, case_id,
    text. Every checkpoint that has outputs must have one for each case."""
    there = outputs.select("checkpoint").distinct()
    paired = metrics.paired(cases.join(bounded(there, "checkpoints")), outputs, ["checkpoint", "category", "case_id"])
    read = written(paired.withColumn("attempted", F.contains("text", F.lit("tool_call"))).withColumn("content", F.when(~F.col("attempted"), stripped("text"))), "outputs")
    by = ["checkpoint", "category"]
    calls = read.where("category like 'tool_seen%' or category like 'tool_unseen%'").withColumn("c", toolrows.read_call(F.col("text"), F.col("tools_json")))
    calls = calls.withColumn("m", toolrows.argument_match(F.col("expected_arguments"), F.col("c.arguments"))).select(*by, "c.valid_json", "c.schema_valid", F.coalesce(F.col("c.name") == F.col("expected_tool"), F.lit(False)).alias("selected"), "m.*")
    parts = [
        metrics.assistant_metrics(read.where("category = 'assistant'"), "content", "attempted", by),
        metrics.math_metrics(read.where("category = 'math'"), "expected", "content", by),
        metrics.tool_set_metrics(calls, by),
        metrics.no_call_metrics(read.where("category in ('tool_no_call', 'tool_missing_info')"), "content", "attempted", by),
    ]
    card: dict = {r["checkpoint"]: {"status": "missing"} for r in configured.select("checkpoint").collect()}  # configured by hand
    for part in parts:
        for r in part.collect():  # one row for each checkpoint and category
            entry = card.setdefault(r["checkpoint"], {})
            entry["status"] = "ok"
            entry[r["category"]] = {k: v for k, v in r.asDict().items() if k not in by}
    sinks.replace_json(path, card)
    return card


def benchmark_scorecard(spark: SparkSession, scored_lm: DataFrame, scored_mcq: DataFrame, path: str, only: list[str] | None = None, skip_large: bool = False) -> dict:
    """Bits per byte of language-modelling benchmarks and accuracy of multiple-choice ones; those without scores are missing.

    scored_lm: name, nats, tokens, bytes. scored_mcq: name, case_id, choice, logprob, tokens, label."""
    specs = benchmarks.selected(benchmarks.catalogue(spark), only, skip_large)
    lm = metrics.bits_per_byte(scored_lm.join(bounded(specs.select("name"), "benchmarks"), "name", "left_semi"), "name")
    mcq = metrics.choice_accuracy(scored_mcq.join(bounded(specs.select("name"), "benchmarks"), "name", "left_semi"), ["case_id"], "name")
    card = {r["name"]: {"kind": r["kind"], "status": "missing"} for r in specs.collect()}  # the catalogue
    for part in (lm, mcq):
        for r in part.collect():  # one row for each benchmark
            card[r["name"]] |= {"status": "ok"} | {k: v for k, v in r.asDict().items() if k != "name"}
    sinks.replace_json(path, card)
    return card
