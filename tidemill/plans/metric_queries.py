"""Metrics, benchmarks and run logs. Scores that a model would give are hashes of the rows, the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import expr as E
from tidemill.operators import benchmarks, chat, metrics, runlog
from tidemill.operators.prefix import id_slot, positions
from tidemill.streaming import runlog_stream

RUNS, STEP_SECONDS = 20, 21_600


def _score(key: Column) -> Column:
    """A number from 0 to 9999 by SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit("7:"), key), 256), 1, 8), 16, 10).cast("bigint") % 10_000


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _dialogues(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/sft_row.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def bpb(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark_item.parquet")
    n = F.size(E.spaced_words("context")).cast("bigint")
    scored = items.select("bench", (_score(F.col("item_id").cast("string")) / 100.0).alias("nats"), n.alias("tokens"), F.octet_length("context").cast("bigint").alias("bytes"))
    return _rounded(metrics.bits_per_byte(scored, "bench"))


def _choice_scores(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf}/benchmark_item.parquet").where("choices is not null")
    c = items.select("item_id", "bench", "label", F.posexplode("choices").alias("choice", "text"))
    s = _score(F.concat_ws(":", "item_id", "choice"))
    return c.select("item_id", "bench", "label", "choice", F.when(s % 10 > 0, -(s % 50) / 10.0).alias("logprob"), F.size(E.spaced_words("text")).cast("bigint").alias("tokens"))


def mcq_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.choice_accuracy(_choice_scores(spark, sf), ["item_id"], "bench"))


def loss_metrics_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    scored = _events(spark, sf).select("event_type", (F.col("value") / 10).alias("loss_sum"), (F.col("user_id") % 50 + 5).alias("tokens"), F.lit(1).cast("bigint").alias("batches"))
    return _rounded(metrics.loss_metrics(scored, "event_type")).withColumn("perplexity", F.round(F.least("perplexity", F.lit(1e6)), 3))


def masked_loss(spark: SparkSession, sf: str) -> DataFrame:
    """Per source: losses of tokens, here their ids in thousandths, where the mask is set."""
    r = spark.read.parquet(f"{sf}/rendered_sft.parquet").join(_dialogues(spark, sf).select("row_id", "source"), "row_id")
    tokens = r.select("source", F.explode(F.arrays_zip("token_ids", "loss_mask")).alias("t"))
    return _rounded(metrics.masked_loss(tokens.select("source", (F.col("t.token_ids") / 1000.0).alias("loss"), F.coalesce("t.loss_mask", F.lit(0)).alias("mask")), "loss", "mask", ["source"]))


def val_estimate(spark: SparkSession, sf: str) -> DataFrame:
    batches = _events(spark, sf).select((F.col("user_id") % RUNS).alias("run"), F.floor(F.col("event_id") / 64).alias("batch"), F.col("value").alias("loss"))
    per_batch = batches.groupBy("run", "batch").agg(F.avg("loss").alias("loss"))
    return _rounded(metrics.validation_estimate(per_batch, "loss", "batch", 10, ["run"]))


def _outputs(spark: SparkSession, sf: str) -> DataFrame:
    last = chat.content_cases(_dialogues(spark, sf), "row_id", last=True).join(_dialogues(spark, sf).select("row_id", "source"), "row_id")
    return last.withColumn("attempted", F.contains("expected_content", F.lit("tool")))


def assistant_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.assistant_metrics(_outputs(spark, sf), "expected_content", "attempted", ["source"]))


def no_call_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.no_call_metrics(_outputs(spark, sf), "expected_content", "attempted", ["source"]))


def math_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Expected answers against outputs, a third of which end in another number."""
    out = _outputs(spark, sf).withColumn("actual", F.when(F.col("row_id") % 3 == 0, F.concat("expected_content", F.lit("1"))).otherwise(F.col("expected_content")))
    return _rounded(metrics.math_metrics(out, "expected_content", "actual", ["source"]))


def benchmark_select(spark: SparkSession, sf: str) -> DataFrame:
    return benchmarks.selected(benchmarks.catalogue(spark), ["piqa", "pile_test", "lambada", "mmlu"], skip_large=True).select("name", "kind")


def benchmark_status(spark: SparkSession, sf: str) -> DataFrame:
    present = spark.createDataFrame([("piqa",), ("mmlu",), ("lambada",)], "name string")
    return benchmarks.with_status(benchmarks.catalogue(spark), present).select("name", "status")


def mcq_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items in the shape of three benchmarks, as cases."""
    items = spark.read.parquet(f"{sf}/benchmark_item.parquet").where("choices is not null")
    letters = F.transform("choices", lambda _, i: F.char(i + 65))
    raw = {
        "hellaswag": items.select(F.col("context").alias("ctx"), F.col("choices").alias("endings"), F.col("label").cast("string").alias("label")),
        "mmlu": items.select(F.col("context").alias("question"), "choices", F.col("label").alias("answer")),
        "arc_easy": items.select(F.col("context").alias("question"), F.struct(F.col("choices").alias("text"), letters.alias("label")).alias("choices"), F.char(F.col("label") + 65).alias("answerKey")),
    }
    out = None
    for name, rows in raw.items():
        part = benchmarks.mcq_cases(name, rows).groupBy(F.lit(name).alias("name"), F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("choices")).cast("bigint").alias("choices"))
        out = part if out is None else out.unionByName(part)
    return out


def mcq_other_mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items in the shape of the other six benchmarks, as cases; choices and contexts are told by their lengths."""
    items = spark.read.parquet(f"{sf}/benchmark_item.parquet").where("choices is not null")
    first, second = F.get("choices", F.lit(0)), F.get("choices", F.lit(1))
    letters = F.struct(F.col("choices").alias("text"), F.transform("choices", lambda _, i: F.char(i + 65)).alias("label"))
    answer = F.char(F.col("label") + 65)
    raw = {
        "piqa": items.select(F.col("context").alias("goal"), first.alias("sol1"), second.alias("sol2"), (F.col("label") % 2).alias("label")),
        "boolq": items.select(F.col("context").alias("passage"), first.alias("question"), (F.col("label") % 2).alias("label")),
        "winogrande": items.select(F.concat(F.lit("Say that _ "), "context").alias("sentence"), first.alias("option1"), second.alias("option2"), (F.col("label") % 2 + 1).cast("string").alias("answer")),
        "openbookqa": items.select(F.col("context").alias("question_stem"), letters.alias("choices"), answer.alias("answerKey")),
        "arc_challenge": items.select(F.col("context").alias("question"), letters.alias("choices"), answer.alias("answerKey")),
        "sciq": items.select(F.col("context").alias("question"), *(F.concat(first, F.lit(str(i))).alias(f"distractor{i}") for i in (1, 2, 3)), first.alias("correct_answer")),
    }
    out = None
    for name, rows in raw.items():
        cases = benchmarks.mcq_cases(name, rows)
        right = F.length(F.get("choices", F.col("label")))
        part = cases.agg(F.count(F.lit(1)).alias("cases"), F.sum(F.size("choices")).cast("bigint").alias("choices"), F.sum(F.length("context")).alias("context_chars"), F.sum(right).alias("right_chars")).select(F.lit(name).alias("name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def checkpoint_left_join(spark: SparkSession, sf: str) -> DataFrame:
    """Configured suppliers' nations against those that have customers, as checkpoints against weights."""
    configured = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").alias("name"), "n_name")
    there = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_nationkey").alias("name"))
    return benchmarks.with_status(configured, there).select("n_name", "status")


def _points(events: DataFrame) -> DataFrame:
    step = F.floor(F.unix_timestamp("ts") / STEP_SECONDS)
    val = F.when(F.col("event_id") % 3 == 0, F.col("value"))
    return events.where("ts is not null").select((F.col("user_id") % RUNS).alias("run"), step.alias("step"), F.col("event_id").alias("line_no"), F.col("value").alias("train_loss"), val.alias("val_loss"))


def runlog_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(runlog.last_wins(_points(_events(spark, sf))))


def runlog_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(runlog.latest(_points(_events(spark, sf))))


def runlog_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(runlog.downsampled(runlog.last_wins(_points(_events(spark, sf))), 25)).select("run", "step", "train_loss")


def runlog_running_best(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(runlog.running_best(runlog.last_wins(_points(_events(spark, sf))))).select("run", "step", "val_loss")


def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    steps = positions(runlog.last_wins(_points(_events(spark, sf))), id_slot("step"), ["step"], ["run"], "n")
    return steps.select("run", "n", F.round(E.learning_rate("n", 3e-4, 20, 100), 12).alias("lr"))


def runlog_stream_result(spark: SparkSession, sf: str) -> DataFrame:
    """The same last points from a stream over the event files."""
    events = spark.readStream.schema(runlog_stream.EVENTS).parquet(_stream_dir(spark, sf))
    return _rounded(runlog_stream.run_available(_points(events), "points"))


def _stream_dir(spark: SparkSession, sf: str) -> str:
    """Streams read directories: the events table, written as several files."""
    from tidemill.runtime import new_path

    path = new_path(spark, "events")
    _events(spark, sf).select("event_id", "ts", "user_id", "event_type", "value", "props").repartition(4).write.parquet(path)
    return path


def topk_values(spark: SparkSession, sf: str) -> DataFrame:
    """The three largest entries of each vector, with their places."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.posexplode(E.top_k(F.col("embedding"), 3)).alias("rank", "t"))
    return v.select("vec_id", "rank", "t.place", F.round(F.col("t.value").cast("double"), 6).alias("value"))


def runlog_tail(spark: SparkSession, sf: str) -> DataFrame:
    """The last points of logs that are files, one a run, read as a growing source."""
    from tidemill.runtime import new_path

    at = new_path(spark, "logs")
    lines = _points(_events(spark, sf)).select("run", "line_no", F.to_json(F.struct("step", "train_loss", "val_loss")).alias("value"))
    lines.repartition("run").sortWithinPartitions("run", "line_no").select("run", "value").write.partitionBy("run").text(at)
    read = runlog_stream.log_lines(spark, at, "*.txt").withColumn("run", F.regexp_extract("run", r"run=(\d+)", 1).cast("bigint"))
    return _rounded(runlog_stream.run_available(runlog.parsed_lines(read), "tail").select("run", "step", "train_loss", "val_loss"))


QUERIES = {f.__name__: f for f in (bpb, mcq_accuracy, loss_metrics_grouping_sets, masked_loss, val_estimate, assistant_metrics, no_call_metrics, math_metrics, benchmark_select, benchmark_status, mcq_normalize, mcq_other_mappings, checkpoint_left_join, runlog_last_wins, runlog_latest, runlog_downsample, runlog_running_best, lr_schedule, runlog_tail, topk_values)}
QUERIES["runlog_stream"] = runlog_stream_result

_H = lambda key: f"('0x' || substr(sha256('7:' || {key}), 1, 8))::BIGINT % 10000"
_W = lambda c: f"len(list_filter(string_split_regex({c}, '[ \\t\\n\\r]+'), lambda w: w <> ''))"
_NB = r"coalesce(regexp_matches({c}, '[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x1C-\x1F\x0B]'), false)".replace("{c}", "c")
_OUT = "o AS (SELECT row_id, source, list_filter(messages, lambda x: x.role = 'assistant' AND x.content IS NOT NULL)[-1].content AS c FROM sft_row WHERE len(list_filter(messages, lambda x: x.role = 'assistant' AND x.content IS NOT NULL)) > 0), oo AS (SELECT *, contains(c, 'tool') AS attempted FROM o)"
_REP = r"""w AS (SELECT *, regexp_extract_all(lower(c), '[\p{L}\p{N}_]+') AS w FROM oo), g AS (SELECT *, list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i+4], ' ')) AS grams FROM w),
  r AS (SELECT *, coalesce(len(w) >= 12 AND (len(list_distinct(w)) < len(w) * 0.2 OR len(list_distinct(grams)) * 2 < len(w) - 4), false) AS rep FROM g)"""
_FN = lambda c: rf"(regexp_extract_all(replace(CASE WHEN regexp_extract({c}, '(?is)final answer\s*[:\-]?\s*(.+)$', 1) <> '' THEN regexp_extract({c}, '(?is)final answer\s*[:\-]?\s*(.+)$', 1) ELSE {c} END, ',', ''), '[-+]?[0-9]+(?:\.[0-9]+)?'))[-1]::DOUBLE"
_PTS = f"p AS (SELECT user_id % {RUNS} AS run, floor(epoch(ts) / {STEP_SECONDS})::BIGINT AS step, event_id AS line_no, value AS train_loss, CASE WHEN event_id % 3 = 0 THEN value END AS val_loss FROM events WHERE ts IS NOT NULL), lw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY line_no DESC) AS rn FROM p) WHERE rn = 1)"
_AVG = lambda c: f"round(avg(({c})::INT), 6)"
ORACLES = {
    "bpb": f"SELECT bench, sum({_W('context')})::BIGINT AS tokens, sum(strlen(context))::BIGINT AS bytes, count(*) AS examples, round(sum({_H('item_id')} / 100.0::DOUBLE) / (ln(2.0::DOUBLE) * sum(strlen(context))), 6) AS bpb FROM benchmark_item GROUP BY bench",
    "mcq_accuracy": f"""WITH c AS (SELECT item_id, bench, label, unnest(range(len(choices))) AS choice, unnest(choices) AS t FROM benchmark_item WHERE choices IS NOT NULL),
        s AS (SELECT *, {_H("item_id || ':' || choice")} AS h, {_W('t')} AS n FROM c), x AS (SELECT *, CASE WHEN h % 10 > 0 THEN -(h % 50) / 10.0::DOUBLE END AS lp FROM s),
        b AS (SELECT item_id, bench, label, arg_max(choice, (coalesce(lp, '-inf'::DOUBLE), -choice)) AS p, arg_max(choice, (coalesce(lp / n, '-inf'::DOUBLE), -choice)) AS pn, count(lp) AS k, sum(CASE WHEN lp IS NOT NULL THEN n END) AS n FROM x GROUP BY ALL)
        SELECT bench, round(100 * avg((p = label)::INT), 6) AS acc, round(100 * avg((pn = label)::INT), 6) AS acc_norm, count(*) AS examples, sum(n)::BIGINT AS tokens FROM b WHERE k > 0 GROUP BY bench""",
    "loss_metrics_grouping_sets": """WITH s AS (SELECT coalesce(event_type, 'none') AS g, value / 10 AS l, user_id % 50 + 5 AS n FROM events), a AS (SELECT coalesce(g, 'mixed') AS event_type, sum(n)::BIGINT AS tokens, count(*) AS batches, sum(l) / sum(n) AS loss FROM s GROUP BY GROUPING SETS ((g), ()))
        SELECT event_type, tokens, batches, round(loss, 6) AS loss, round(least(round(exp(loss), 6), 1e6), 3) AS perplexity, round(loss / ln(2.0::DOUBLE), 6) AS bits_per_token FROM a""",
    "masked_loss": "SELECT source, round(sum(list_sum(list_transform(range(1, len(token_ids) + 1), lambda i: (token_ids[i] * loss_mask[i]::INT)::BIGINT))) / 1000.0::DOUBLE / greatest(sum(list_sum(loss_mask)), 1), 6) AS masked_loss FROM (SELECT source, token_ids, list_transform(loss_mask, lambda m: m::INT) AS loss_mask FROM rendered_sft JOIN sft_row USING (row_id)) GROUP BY source",
    "val_estimate": f"SELECT run, round(avg(l), 6) AS val_loss FROM (SELECT user_id % {RUNS} AS run, event_id // 64 AS b, avg(value) AS l FROM events GROUP BY ALL) WHERE b < 10 GROUP BY run",
    "assistant_metrics": f"WITH {_OUT}, {_REP} SELECT source, count(*) AS rows, {_AVG(_NB)} AS non_empty_rate, {_AVG('NOT attempted')} AS no_tool_call_rate, {_AVG('NOT rep')} AS no_repetition_rate FROM r GROUP BY source",
    "no_call_metrics": f"WITH {_OUT} SELECT source, count(*) AS rows, {_AVG('NOT attempted')} AS no_tool_call_rate, {_AVG(_NB)} AS non_empty_rate, {_AVG('NOT attempted AND ' + _NB)} AS correct_rate FROM oo GROUP BY source",
    "math_metrics": f"WITH {_OUT}, n AS (SELECT source, {_FN('c')} AS w, {_FN('CASE WHEN row_id % 3 = 0 THEN c || 1 ELSE c END')} AS g FROM oo) SELECT source, count(*) AS rows, round(avg(coalesce(abs(g - w) <= greatest(1e-6 * greatest(abs(g), abs(w)), 1e-9), false)::INT), 6) AS exact_match_rate FROM n WHERE w IS NOT NULL GROUP BY source",
    "benchmark_select": "SELECT * FROM (VALUES ('piqa', 'multiple_choice'), ('mmlu', 'multiple_choice'), ('lambada', 'language_modeling')) t(name, kind)",
    "benchmark_status": "SELECT name, CASE WHEN name IN ('piqa', 'mmlu', 'lambada') THEN 'ok' ELSE 'missing' END AS status FROM (VALUES " + ", ".join(f"('{c[0]}')" for c in benchmarks.CATALOGUE) + ") t(name)",
    "mcq_normalize": """WITH b AS (SELECT label, len(choices) AS n FROM benchmark_item WHERE choices IS NOT NULL AND label IS NOT NULL AND label < len(choices)),
        u AS (SELECT name, label, n FROM b, (VALUES ('hellaswag'), ('mmlu'), ('arc_easy')) t(name) WHERE NOT (name = 'arc_easy' AND label < 0)) SELECT name, label::BIGINT AS label, count(*) AS cases, sum(n)::BIGINT AS choices FROM u GROUP BY ALL""",
    "mcq_other_mappings": """WITH b AS (SELECT * FROM benchmark_item WHERE choices IS NOT NULL),
        i AS (SELECT *, choices[1] AS c1, choices[2] AS c2 FROM b)
        SELECT 'piqa' AS name, count(*) AS cases, 2 * count(*) AS choices, sum(length(context))::BIGINT AS context_chars, sum(length(CASE label WHEN 0 THEN c1 WHEN 2 THEN c1 ELSE c2 END))::BIGINT AS right_chars FROM i WHERE label >= 0 AND c2 IS NOT NULL
        UNION ALL SELECT 'boolq', count(*), 2 * count(*), sum(length(context) + length(c1) + 12)::BIGINT, sum(CASE WHEN label % 2 = 1 THEN 3 ELSE 2 END)::BIGINT FROM i WHERE label >= 0
        UNION ALL SELECT 'winogrande', count(*), 2 * count(*), (9 * count(*))::BIGINT, sum(length(CASE WHEN label % 2 + 1 = 1 THEN c1 ELSE c2 END) + 1 + length(ltrim(context)))::BIGINT FROM i WHERE c2 IS NOT NULL
        UNION ALL SELECT n, count(*), sum(len(choices))::BIGINT, sum(length(context))::BIGINT, sum(length(choices[label + 1]))::BIGINT FROM i, (VALUES ('openbookqa'), ('arc_challenge')) v(n) WHERE label >= 0 AND label < len(choices) GROUP BY n
        UNION ALL SELECT 'sciq', count(*), 4 * count(*), sum(length(context))::BIGINT, sum(length(c1))::BIGINT FROM i""",
    "checkpoint_left_join": "SELECT n_name, CASE WHEN n_nationkey IN (SELECT s_nationkey FROM supplier) THEN 'ok' ELSE 'missing' END AS status FROM nation",
    "runlog_last_wins": f"WITH {_PTS} SELECT run, step, line_no, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss FROM lw",
    "runlog_latest": f"WITH {_PTS} SELECT run, step, line_no, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY line_no DESC) AS r2 FROM p) WHERE r2 = 1",
    "runlog_downsample": f"WITH {_PTS}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS k, count(*) OVER (PARTITION BY run) AS n FROM lw) SELECT run, step, round(train_loss, 6) AS train_loss FROM k WHERE (k - 1) % greatest(ceil(n / 25), 1) = 0 OR k = n",
    "runlog_running_best": f"WITH {_PTS}, k AS (SELECT *, min(val_loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM lw) SELECT run, step, round(val_loss, 6) AS val_loss FROM k WHERE val_loss IS NOT NULL AND (b IS NULL OR val_loss < b)",
    "lr_schedule": f"WITH {_PTS}, k AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS n FROM lw) SELECT run, n, round(CASE WHEN n < 20 THEN 3e-4 * n / 20 ELSE 3e-4 * 0.5 * (1 + cos(pi() * least(1.0, (n - 20) / 80))) END, 12) AS lr FROM k",
}
ORACLES["runlog_stream"] = ORACLES["runlog_last_wins"]
ORACLES["runlog_tail"] = f"WITH {_PTS} SELECT run, step, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss FROM lw"
ORACLES["topk_values"] = "SELECT vec_id, (rn - 1)::INT AS rank, (place - 1)::INT AS place, round(value::DOUBLE, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY value DESC, place) AS rn FROM (SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS place, unnest(embedding) AS value FROM embeddings) WHERE value IS NOT NULL) WHERE rn <= 3"
