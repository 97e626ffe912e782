"""Synthetic tool-calling rows from seeds alone: families of tools described by slots, solvers that give right results, row kinds.

A family is a table entry: its tools, the slots of a call, sentences that ask for one, and a solver that turns a filled call
into a result. Everything else (schema, arguments, messages, requests that lack what a call needs) follows from the slots.
"""

from __future__ import annotations

import datetime
import fractions
import hashlib
import json
import random
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.toolcall import schema_errors
from tidemill.operators.chat import MESSAGES, TOOLS

Dice = random.Random
Call = dict[str, object]


@dataclass(frozen=True)
class Slot:
    """One argument of a call: what it means, which JSON type it has, how a value is drawn; optional ones may be left out."""

    meaning: str
    draw: Callable[[Dice, Call], object]
    kind: str = "string"
    choices: tuple[str, ...] = ()
    optional: bool = False
    most: int = 0

    def schema(self) -> dict:
        shape: dict = {"type": self.kind, "description": self.meaning}
        if self.choices:
            shape["enum"] = list(self.choices)
        if self.kind == "array":
            shape |= {"items": {"type": "string"}, "maxItems": self.most}
        return shape


def _one_of(meaning: str, *choices: str) -> Slot:
    return Slot(meaning, lambda dice, _: dice.choice(choices), choices=choices)


def _free(meaning: str, *examples: str) -> Slot:
    return Slot(meaning, lambda dice, _: dice.choice(examples))


def _whole(meaning: str, low: int, high: int) -> Slot:
    return Slot(meaning, lambda dice, _: dice.randint(low, high), "integer")


def _code(meaning: str, pattern: str, digits: int) -> Slot:
    return Slot(meaning, lambda dice, _: pattern + str(dice.randrange(10 ** (digits - 1), 10**digits)))


def _day(meaning: str) -> Slot:
    first = datetime.date(2025, 3, 1)
    return Slot(meaning, lambda dice, _: (first + datetime.timedelta(days=dice.randrange(500))).isoformat())


def _few(meaning: str, most: int, *pool: str) -> Slot:
    return Slot(meaning, lambda dice, _: dice.sample(pool, dice.randint(1, most)), "array", optional=True, most=most)


# What things are worth in the base unit of their quantity, exactly: value * scale + shift.
_F = fractions.Fraction
MEASURES: Mapping[str, Mapping[str, tuple[fractions.Fraction, fractions.Fraction]]] = {
    "distance": {"metre": (_F(1), _F(0)), "kilometre": (_F(1000), _F(0)), "foot": (_F(3048, 10000), _F(0)), "yard": (_F(9144, 10000), _F(0))},
    "mass": {"gram": (_F(1), _F(0)), "kilogram": (_F(1000), _F(0)), "ounce": (_F(28349523125, 10**9), _F(0))},
    "heat": {"kelvin": (_F(1), _F(0)), "celsius": (_F(1), _F(27315, 100)), "fahrenheit": (_F(5, 9), _F(45967 * 5, 900))},
}
#: How a sum is written, said and done.
SUMS: Mapping[str, tuple[str, Callable[[int, int], fractions.Fraction]]] = {"plus": ("+", lambda a, b: _F(a + b)), "minus": ("-", lambda a, b: _F(a - b)), "times": ("*", lambda a, b: _F(a * b)), "over": ("/", lambda a, b: _F(a, b))}


def exact(value: fractions.Fraction) -> int | float:
    """A whole number where it is one, else six decimals."""
    return value.numerator if value.denominator == 1 else round(float(value), 6)


def converted(value: int, quantity: str, given: str, wanted: str) -> int | float:
    (scale, shift), (other, other_shift) = MEASURES[quantity][given], MEASURES[quantity][wanted]
    return exact((value * scale + shift - other_shift) / other)


def _measure_slots(value: str, quantity: str, given: str, wanted: str) -> dict[str, Slot]:
    unit = lambda not_: lambda dice, call: dice.choice([u for u in MEASURES[str(call[quantity])] if u != call.get(not_)])
    every = tuple(u for units in MEASURES.values() for u in units)
    return {
        value: _whole("The number to convert", 1, 900),
        quantity: _one_of("What is measured", *MEASURES),
        given: Slot("Unit of the number", unit(""), choices=every),
        wanted: Slot("Unit to convert to", unit(given), choices=every),
    }


def _picked(dice: Dice, *pool: str) -> str:
    return dice.choice(pool)



_SKY = ("fair", "hazy", "drizzling", "freezing", "gusty")
_PORTS = ("Bergen", "Porto", "Izmir", "Cork", "Gdansk", "Split")
_WORDS = {"quorum": "the fewest members that may decide", "ledger": "a book of accounts", "sluice": "a gate that holds back water", "tariff": "a fixed list of charges", "vellum": "a fine skin for writing on"}
_THEMES = ("beekeeping", "harbour rules", "clock repair", "choir music")
_STATES = ("waiting", "granted", "withdrawn")


def _weather_of(call: Call, dice: Dice) -> Call:
    kelvin = dice.randint(260, 305)
    return {"sky": _picked(dice, *_SKY), "degrees": exact(_F(converted(kelvin, "heat", "kelvin", str(call["scale"]))).limit_denominator(10))}


def _listing(theme: str, what: str, n: object) -> Call:
    return {"hits": [f"{what} {i} on {theme}" for i in range(1, int(str(n)) + 1)]}


def _sum_of(text: str) -> Call:
    a, sign, b = text.split()
    return {"value": exact(next(do for mark, do in SUMS.values() if mark == sign)(int(a), int(b)))}


def _moved(day: object, by: object) -> str:
    return (datetime.date.fromisoformat(str(day)) + datetime.timedelta(days=int(str(by)))).isoformat()


@dataclass(frozen=True)
class Family:
    """Tools that do the same under two names, with the slots of a call and what comes of it. ask and tell are filled with the call and its result."""

    tools: Mapping[str, str]
    slots: Mapping[str, Slot]
    solve: Callable[[Call, Dice], Call]
    ask: str
    tell: str
    vague: str

    def tool(self, dice: Dice) -> dict:
        name = dice.choice(sorted(self.tools))
        needed = [k for k, s in self.slots.items() if not s.optional]
        schema = {"type": "object", "properties": {k: s.schema() for k, s in self.slots.items()}, "required": needed, "additionalProperties": False}
        return {"type": "function", "function": {"name": name, "description": self.tools[name], "parameters": schema}}

    def call(self, dice: Dice) -> Call:
        call: Call = {}
        for key, slot in self.slots.items():
            if not slot.optional or dice.random() < 0.6:
                call[key] = slot.draw(dice, call)
        return call

    def lacking(self) -> str:
        """What to answer to a request that says nothing of the call."""
        needed = [s.meaning[0].lower() + s.meaning[1:] for s in self.slots.values() if not s.optional]
        return f"I can do that once I know {' and '.join([', '.join(needed[:-1]), needed[-1]]) if len(needed) > 1 else needed[0]}."


#: The families by their keys, which are fixed values: those of the first table are trained on, those of the second are held out.
SEEN: dict[str, Family] = {
    "weather": Family({"sky_now": "Says how the sky looks in a place at this moment.", "outdoor_report": "Reports the present weather of a place."}, {"place": _free("The place", *_PORTS), "scale": _one_of("The scale of degrees", "celsius", "fahrenheit")}, _weather_of, "How is it outside in {place}? Degrees {scale}, please.", "It is {sky} in {place}, at {degrees} degrees {scale}.", "Could you check what it is like outside?"),
    "unit_conversion": Family({"measure_swap": "Expresses a measure in another unit.", "unit_bridge": "Carries a number from one unit to another."}, _measure_slots("number", "quantity", "unit", "target"), lambda c, _: {"number": converted(int(str(c["number"])), str(c["quantity"]), str(c["unit"]), str(c["target"]))}, "How much is {call[number]} {unit} in {target}?", "{call[number]} {unit} is {number} {target}.", "I have a measure in the wrong unit."),
    "calculator": Family({"two_number_sum": "Works out one operation on two numbers.", "quick_arithmetic": "Does plain arithmetic."}, {"left": _whole("The first number", -80, 240), "how": _one_of("The operation", *SUMS), "right": _whole("The second number", 1, 36)}, lambda c, _: {"value": exact(SUMS[str(c["how"])][1](int(str(c["left"])), int(str(c["right"]))))}, "What is {left} {how} {right}?", "{left} {how} {right} makes {value}.", "Please do a sum for me."),
    "date_math": Family({"day_walk": "Walks forward or back from a day.", "calendar_step": "Tells the day that lies so many days away."}, {"from_day": _day("The day to start from"), "step": _whole("Days to go, back if negative", -90, 90)}, lambda c, _: {"day": _moved(c["from_day"], c["step"])}, "Which day is {step} days from {from_day}?", "That day is {day}.", "I need to know a day some time from another."),
    "simple_lookup": Family({"word_sense": "Says what a word means.", "meaning_of": "Gives the meaning of a word."}, {"word": _free("The word", *_WORDS)}, lambda c, _: {"sense": _WORDS[str(c["word"])]}, "What does {word} mean?", "{word}: {sense}.", "There is a word that I don't know."),
    "document_search": Family({"paper_hunt": "Looks for papers on a theme.", "shelf_search": "Searches the shelves by theme."}, {"theme": _free("The theme", *_THEMES), "most": _whole("How many to list", 1, 4), "marks": _few("Marks that papers must bear", 2, "draft", "signed", "public")}, lambda c, _: _listing(str(c["theme"]), "Paper", c["most"]), "List {most} papers on {theme}.", "I found: {hits}.", "Find me something to read."),
    "record_lookup": Family({"entry_state": "Tells the state of an entry in a book.", "book_entry": "Opens an entry of one of the books."}, {"book": _one_of("The book", "guests", "loans", "repairs"), "entry": _code("The entry's number", "E", 4)}, lambda c, d: {"state": _picked(d, *_STATES)}, "What became of entry {entry} in the book of {book}?", "Entry {entry} of the {book} is {state}.", "I am looking for an entry."),
    "inventory": Family({"shelf_count": "Counts an article on the shelves of a depot.", "depot_stock": "Tells how much of an article a depot holds."}, {"article": _code("The article's number", "A-", 4), "depot": _one_of("The depot", "quay", "hilltop", "mill")}, lambda c, d: {"pieces": d.randint(0, 600)}, "How many of {article} does the {depot} depot hold?", "The {depot} depot holds {pieces} of {article}.", "Is there any of it left?"),
}
UNSEEN: dict[str, Family] = {
    "forecast": Family({"sky_ahead": "Tells how the sky will look on a day.", "coming_weather": "Foretells the weather of a place."}, {"spot": _free("The spot", *_PORTS), "on": _day("The day"), "scale": _one_of("The scale of degrees", "celsius", "fahrenheit")}, _weather_of, "How will it be in {spot} on {on}, in {scale}?", "On {on} it will be {sky} in {spot}, at {degrees} degrees {scale}.", "Will I need a coat?"),
    "amount_conversion": Family({"restate_amount": "States an amount in another unit.", "amount_in": "Tells what an amount is in a unit."}, _measure_slots("amount", "sort", "stated_in", "wanted_in"), lambda c, _: {"result": converted(int(str(c["amount"])), str(c["sort"]), str(c["stated_in"]), str(c["wanted_in"]))}, "State {amount} {stated_in} in {wanted_in}.", "{amount} {stated_in} comes to {result} {wanted_in}.", "Put that amount another way."),
    "expression": Family({"reckon": "Reckons a written sum.", "sum_up_text": "Reads a sum and gives its value."}, {"written": Slot("The sum as written", lambda d, _: f"{d.randint(-40, 120)} {d.choice([m for m, _ in SUMS.values()])} {d.randint(1, 24)}")}, lambda c, _: _sum_of(str(c["written"])), "Reckon {written}.", "{written} comes to {value}.", "Reckon this for me."),
    "date_offset": Family({"count_days": "Counts days from a date.", "date_after": "Gives the date that many days away."}, {"origin": _day("The date to count from"), "distance": _whole("Days to count, back if negative", -45, 45)}, lambda c, _: {"reached": _moved(c["origin"], c["distance"])}, "Count {distance} days from {origin}.", "Counting {distance} days from {origin} leads to {reached}.", "Count the days for me."),
    "glossary": Family({"list_of_terms": "Reads from the list of terms.", "term_note": "Gives the note to a term."}, {"term": _free("The term", *_WORDS)}, lambda c, _: {"note": _WORDS[str(c["term"])]}, "Read me the note on {term}.", "The note on {term} says: {note}.", "Read me a note."),
    "knowledge_search": Family({"ask_archive": "Asks the archive about a subject.", "archive_hits": "Lists what the archive has on a subject."}, {"subject": _free("The subject", *_THEMES), "rows": _whole("How many hits", 1, 4), "kinds": _few("Kinds of hits", 2, "letter", "map", "minute")}, lambda c, _: _listing(str(c["subject"]), "Hit", c["rows"]), "What are the first {rows} hits on {subject}?", "The archive has: {hits}.", "Ask the archive."),
    "account_record": Family({"member_card": "Shows a member's card in a district.", "card_standing": "Tells how a member's card stands."}, {"card": _code("The card's number", "M", 6), "district": _one_of("The district", "coast", "inland", "isles")}, lambda c, d: {"standing": _picked(d, *_STATES)}, "How does card {card} stand in the {district} district?", "In the {district} district card {card} is {standing}.", "How does my card stand?"),
    "stock_level": Family({"bin_level": "Tells how full a part's bin is at a yard.", "parts_at": "Counts a part at a yard."}, {"part": _code("The part's number", "P/", 5), "yard": _one_of("The yard", "old", "new", "dry")}, lambda c, d: {"left": d.randint(0, 900)}, "How much of {part} is left in the {yard} yard?", "{left} of {part} are left in the {yard} yard.", "Are there parts left?"),
}
SYSTEM = "You are a helpful assistant that can use the given tools."
SMALL_TALK = (("Good evening.", "Good evening! What can I do for you?"), ("That was all, thanks.", "Glad to hear it."), ("Do you ever rest?", "I am here whenever you write."), ("Say something cheerful.", "The sun is out somewhere."))
#: Kinds of rows and how many of each a training and an evaluation set has; fixed values.
TRAIN_KINDS = {"direct": 6000, "no_tool": 1500, "distractor_heavy": 1000, "missing_info": 750, "hard_variation": 750}
EVAL_KINDS = {"seen": 500, "unseen": 500, "no_call": 250, "missing_info": 250}
#: Kinds of rows without a call, and those with as many tools as there may be.
QUIET, CROWDED = ("no_tool", "no_call", "missing_info"), ("distractor_heavy", "hard_variation")
ROWS = "kind string, no bigint, family string, tools string, messages string"


def _worked(family: Family, name: str, schema: dict, kind: str, dice: Dice) -> Iterator[dict]:
    """Question, call, result and answer; an error if the call breaks its own schema."""
    call = family.call(dice)
    if errors := schema_errors(schema, call):
        raise ValueError(f"{name}: {'; '.join(errors)}")
    result = family.solve(call, dice)
    shown = {k: ", ".join(v) if isinstance(v, list) else v for k, v in (call | result).items()}
    asked = family.ask.format(call=call, **shown)
    if kind == "hard_variation":
        asked = f"Before I forget it, and whatever else you can do: {asked[0].lower()}{asked[1:]}"
    yield {"role": "user", "content": asked}
    yield {"role": "assistant", "tool_calls": [{"type": "function", "function": {"name": name, "arguments": json.dumps(call)}}]}
    yield {"role": "tool", "name": name, "content": json.dumps(result, sort_keys=True)}
    yield {"role": "assistant", "content": family.tell.format(call=call, **shown)}


def tool_row(kind: str, no: int, seed: int, most_tools: int = 5) -> tuple[str, list[dict], list[dict]]:
    """(family, tools, messages) of one row; the same for the same kind, number and seed. Parameters and arguments are JSON text."""
    dice = Dice(hashlib.blake2b(f"{kind}/{no}/{seed}".encode()).digest())
    table = UNSEEN if kind == "unseen" else SEEN
    crowd = dice.sample(sorted(table), most_tools if kind in CROWDED else dice.randint(1, max(1, most_tools - 2)))
    tools = {key: table[key].tool(dice) for key in crowd}
    chosen = crowd[0]
    messages = [{"role": "system", "content": SYSTEM}]
    if kind == "missing_info":
        messages += [{"role": "user", "content": table[chosen].vague}, {"role": "assistant", "content": table[chosen].lacking()}]
    elif kind in QUIET:
        messages += [{"role": role, "content": text} for role, text in zip(("user", "assistant"), dice.choice(SMALL_TALK), strict=True)]
    else:
        function = tools[chosen]["function"]
        messages += _worked(table[chosen], function["name"], function["parameters"], kind, dice)
    listed = [tools[key] | {"function": tools[key]["function"] | {"parameters": json.dumps(tools[key]["function"]["parameters"])}} for key in dice.sample(crowd, len(crowd))]
    return chosen, listed, messages


def tool_rows(spark: SparkSession, kinds: Mapping[str, int], seed: int, scale: float = 1.0) -> DataFrame:
    """Rows of every kind, generated where they are needed: (kind, no, family, tools, messages), the last two as JSON; see as_chat."""
    numbers = spark.createDataFrame([(k, max(0, round(n * scale))) for k, n in kinds.items()], "kind string, n bigint")
    wanted = numbers.where("n > 0").select("kind", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("no")).repartition(F.col("kind"), F.floor(F.col("no") / 1000))

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [tool_row(k, int(n), seed) for k, n in zip(b["kind"], b["no"], strict=True)]
            yield b.assign(family=[x[0] for x in made], tools=[json.dumps(x[1]) for x in made], messages=[json.dumps(x[2]) for x in made])[["kind", "no", "family", "tools", "messages"]]

    return wanted.mapInPandas(make, ROWS)


def as_chat(rows: DataFrame) -> DataFrame:
    """Rows whose tools and messages are JSON as chat rows, with both as arrays of structs."""
    return rows.withColumns({"tools": F.from_json("tools", TOOLS), "messages": F.from_json("messages", MESSAGES)})


def training_rows(spark: SparkSession, seed: int, scale: float = 1.0) -> DataFrame:
    return tool_rows(spark, TRAIN_KINDS, seed, scale)


def evaluation_rows(spark: SparkSession, seed: int, scale: float = 1.0) -> DataFrame:
    """Like training rows with the next seed, so the two sets differ."""
    return tool_rows(spark, EVAL_KINDS, seed + 1, scale)


def held_out_names(spark: SparkSession) -> DataFrame:
    """Names of the tools that only evaluation has."""
    return spark.createDataFrame([(name,) for family in UNSEEN.values() for name in family.tools], "name string")


#: What a model is asked for, by category: the request and the fields of the JSON object it shall return.
REQUESTS = {
    "assistant": ("Write a short exchange between a person and a helpful assistant.", ("prompt", "response"), "Keep the response brief and right."),
    "math": ("Write a word problem that a pupil can solve.", ("problem", "solution", "final_answer"), "Show the steps in the solution; final_answer is one plain number."),
    "tool": ("Write an example in which exactly this tool is called:", ("user_prompt", "arguments", "tool_result", "final_answer"), "arguments follow the schema and aren't nested; tool_result is JSON text; final_answer tells the person what came of it."),
}


def _schemas(seed: int) -> list[str]:
    return [json.dumps(f.tool(Dice(f"{seed}/{key}"))) for key, f in sorted(SEEN.items())]


def prompts(spark: SparkSession, category: str, n: int, seed: int = 0) -> DataFrame:
    """(attempt, tool, prompt): numbered requests to a model for one example of a category. A tool request carries its tool's schema."""
    wish, fields, rules = REQUESTS[category]
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("attempt") % len(values) + 1).cast("int"))
    tool: Column = pick(_schemas(seed)) if category == "tool" else F.lit(None).cast("string")
    about = F.col("tool") if category == "tool" else F.concat(F.lit("Theme: "), pick(_THEMES))
    text = F.concat_ws("\n", F.lit(wish), about, F.lit(f"Return nothing but a JSON object with the fields {', '.join(fields)}."), F.lit(rules), F.concat(F.lit("Example number: "), F.col("attempt")))
    return spark.range(1, n + 1).select(F.col("id").alias("attempt")).withColumn("tool", tool).withColumn("prompt", text)
