"""Benchmarks: the catalogue, raw rows as multiple-choice cases, and selection."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Name, kind, text field, large.
CATALOGUE = [
    ("hellaswag", "multiple_choice", None, False), ("piqa", "multiple_choice", None, False), ("arc_easy", "multiple_choice", None, False), ("arc_challenge", "multiple_choice", None, False),
    ("winogrande", "multiple_choice", None, False), ("openbookqa", "multiple_choice", None, False), ("boolq", "multiple_choice", None, False), ("sciq", "multiple_choice", None, False), ("mmlu", "multiple_choice", None, False),
    ("wikitext2", "language_modeling", "page", False), ("wikitext103", "language_modeling", "page", False), ("c4_en_validation", "language_modeling", "text", True), ("pile_test", "language_modeling", "text", True), ("lambada", "language_modeling", "text", False),
]


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATALOGUE, "name string, kind string, text_field string, large boolean")


def selected(specs: DataFrame, only: Sequence[str] | None = None, skip_large: bool = False) -> DataFrame:
    """The specs asked for; an unknown name is an error."""
    out = specs
    if only is not None:
        asked = specs.sparkSession.createDataFrame([(n,) for n in only], "name string")
        unknown = asked.exceptAll(specs.select("name")).distinct()
        names = [r["name"] for r in unknown.limit(20).collect()]  # asked for by hand: a few names
        if names:
            raise ValueError(f"unknown benchmarks: {', '.join(sorted(names))}")
        out = out.join(F.broadcast(asked.distinct()), "name", "left_semi")
    return out.where("not large") if skip_large else out


def with_status(specs: DataFrame, present: DataFrame) -> DataFrame:
    """Specs with whether their data is there."""
    return specs.join(present.select("name").distinct().withColumn("_p", F.lit(True)), "name", "left").withColumn("status", F.when(F.col("_p"), "ok").otherwise("missing")).drop("_p")


def _as_int(c: Column) -> Column:
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[-+]?\d+(\.0+)?$"), F.regexp_replace(text, r"\.0+$", "").cast("bigint"))


def _letter(labels: Column, answer: Column) -> Column:
    """0-based place of an answer among its labels, or of its letter."""
    place = F.array_position(labels, answer) - 1
    letter = F.when(answer.rlike(r"^\p{L}$"), F.ascii(F.upper(answer)) - F.lit(65))
    return F.when(place >= 0, place).otherwise(F.when(letter >= 0, letter))


@pandas_udf(T.ArrayType(T.IntegerType()))
def answer_order(question: pd.Series, seed: pd.Series) -> pd.Series:
    """A seeded order of four choices that depends on the question alone."""

    def order(q: str | None, s: int) -> list[int]:
        rng = random.Random(int.from_bytes(sha256(f"{s}:{q}".encode()).digest()[:8], "big"))
        out = list(range(4))
        rng.shuffle(out)
        return out

    return pd.Series([order(q, s) for q, s in zip(question, seed, strict=True)])


def _cases(rows: DataFrame, context: Column, choices: Column, label: Column) -> DataFrame:
    out = rows.select(context.alias("context"), choices.alias("choices"), label.cast("int").alias("label"))
    return out.where(F.col("context").isNotNull() & F.col("choices").isNotNull() & F.col("label").isNotNull() & (F.col("label") < F.size("choices")) & (F.size("choices") > 0))


def _lettered(question: str) -> Callable[[DataFrame, int], DataFrame]:
    return lambda r, _: _cases(r, F.col(question), F.col("choices.text"), _letter(F.col("choices.label"), F.col("answerKey")))


def _winogrande(rows: DataFrame, _: int) -> DataFrame:
    at = F.instr("sentence", "_")
    head, tail = F.rtrim(F.substring("sentence", F.lit(1), at - F.lit(1))), F.ltrim(F.substring(F.col("sentence"), at + F.lit(1), F.length("sentence")))
    option = lambda c: F.when((at > 0) & (tail != ""), F.concat(F.col(c), F.lit(" "), tail)).otherwise(F.col(c))
    context = F.when(at == 0, F.concat("sentence", F.lit(" "))).when(head != "", F.concat(head, F.lit(" "))).when(at > 0, "")
    both = F.when(F.col("option1").isNotNull() & F.col("option2").isNotNull(), F.array(option("option1"), option("option2")))
    return _cases(rows, context, both, F.when(F.col("answer").cast("string") == "1", 0).otherwise(1))


def _sciq(rows: DataFrame, seed: int) -> DataFrame:
    four = ("distractor1", "distractor2", "distractor3", "correct_answer")
    given = rows.where(" and ".join(f"{c} is not null" for c in four) + " and question is not null").withColumn("_o", answer_order("question", F.lit(seed)))
    return _cases(given, F.col("question"), F.transform("_o", lambda i: F.get(F.array(*four), i)), F.array_position("_o", F.lit(3)) - 1)


def _both(a: str, b: str) -> Column:
    return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.array(a, b))


def _yes_no(c: Column) -> Column:
    return F.when(c.isin(0, 1), c)


MAPPINGS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "hellaswag": lambda r, _: _cases(r, F.coalesce("ctx", F.lit("")), F.col("endings"), _as_int(F.col("label"))),
    "piqa": lambda r, _: _cases(r, F.coalesce("goal", F.lit("")), _both("sol1", "sol2"), _yes_no(_as_int(F.col("label")))),
    "arc_easy": _lettered("question"),
    "arc_challenge": _lettered("question"),
    "openbookqa": _lettered("question_stem"),
    "winogrande": _winogrande,
    "boolq": lambda r, _: _cases(r, F.concat("passage", F.lit("\nQuestion: "), "question", F.lit(" ")), F.array(F.lit("no"), F.lit("yes")), _yes_no(_as_int(F.col("label")))),
    "sciq": _sciq,
    "mmlu": lambda r, _: _cases(r, F.col("question"), F.col("choices"), _as_int(F.col("answer"))),
}


def mcq_cases(name: str, rows: DataFrame, seed: int = 0) -> DataFrame:
    """A benchmark's raw rows as (context, choices, label); rows that aren't usable are left out. Negative labels stay."""
    if name not in MAPPINGS:
        raise ValueError(f"no multiple-choice mapping for {name}")
    return MAPPINGS[name](rows, seed)
