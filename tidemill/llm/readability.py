"""Reading level: the median of classic readability grades, sentence by sentence.

Markup, code, links and headings are left out and list items count as sentences. Every sentence gets five grade estimates
(Flesch-Kincaid, Gunning fog, SMOG, Coleman-Liau, automated readability index) from its length, letters and syllables; their
median is its grade. Syllables follow hyphenation-style rules per language (vowel groups, diphthongs, hiatus, silent
endings), for Cyrillic and Greek vowels; in other scripts, whose syllables letters don't tell, every word counts as one of
average length, so that the sentences' lengths alone tell. A document keeps how many of its words stand at which grade. Its level is that of most of its words; the two
bounds between the levels are fitted to rated documents, a bounded sample of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.runtime import spread, written

LEVELS = ("easy", "medium", "hard")
#: Grades 0 to GRADES-1, the last one for all beyond.
GRADES = 40
#: Bounds where there are no ratings: below the first easy, from the second on hard.
DEFAULT_BOUNDS = (6, 18)
#: At most so many rated documents are fitted to.
RATED_SAMPLE = 20_000

# How many letters and syllables a word has on average beside English, so that grades compare.
LETTER_SCALE = {"en": 1.0, "de": 0.80, "es": 0.94, "fr": 0.96, "cyrillic": 0.84, "greek": 0.86}
SYLLABLE_SCALE = {"en": 1.0, "de": 0.82, "es": 0.74, "fr": 0.90, "cyrillic": 0.65, "greek": 0.65}
#: Letters, syllables and share of long words of average English prose, for scripts that don't tell them.
AVERAGE_LETTERS, AVERAGE_SYLLABLES, AVERAGE_COMPLEX = 4.7, 1.5, 0.1
#: Words that a character stands for in scripts without spaces.
WORDS_A_CHARACTER = 0.6

_VOWELS = {
    "en": re.compile(r"[aeiouy]+"),
    "de": re.compile(r"ei|ai|au|eu|äu|ie|aa|ee|oo|[aeiouyäöü]"),
    "es": re.compile(r"[iu]?[aeoáéó][iuy]?(?![íú])|[íú]|[iuü]+|y$"),
    "fr": re.compile(r"eau|[aeiouyàâäéèêëîïôöùûüÿœæ]+"),
    "cyrillic": re.compile(r"[аеёиоуыэюяіїєў]"),
    "greek": re.compile(r"αι|ει|οι|ου|αυ|ευ|υι|[αεηιουωάέήίόύώϊϋΐΰ]"),
}
_BEYOND_LATIN = re.compile(r"[\u0370-\u1dff\u2e80-\ud7ff\uf900-\ufefc\U00020000-\U0003ffff]")
_CYRILLIC, _GREEK = re.compile(r"[\u0400-\u052f]"), re.compile(r"[\u0370-\u03ff\u1f00-\u1fff]")
_UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_EN_SILENT = re.compile(r"(?:[^aeiouyl]e|[aeiouy]le[sd]?|[^aeiouytdl]ed|[^aeiouysxzhcgl]es)$")
_EN_HIATUS = re.compile(r"i[ao](?!us)|eo|ua(?!l?it)|[iu]um|[aeiouy][^aeiouy]+ea$|ier$|ying")
_FR_SILENT = re.compile(r"[^aeiouyàâäéèêëîïôöùûüÿœæ](?:e|es|ent)$")
_CACHE: dict[str, dict[str, int]] = {lang: {} for lang in _VOWELS}

_FENCE = re.compile(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1\s*$|\Z)")
_TAG = re.compile(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->|<[^<>\n]{1,300}>", re.S)
_LINK = re.compile(r"\bhttps?://\S+|\bwww\.\S+|`[^`\n]*`")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s.*|=+\s.*=+|\*\*[^*]*\*\*|<h\d>.*</h\d>)\s*$", re.M)
_ITEM = re.compile(r"^\s*(?:[-*•·+–]|\d{1,3}[.)]|\([A-Za-z0-9]\))\s+")
_END = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|[A-ZÄÖÜÉÈÀÇÁÍÓÚÑ¿¡]|$)|[。！？؟।]+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")

# Frequent words that tell the languages apart.
_COMMON = {
    "en": frozenset("the of and to in is that it was for on are with as this be by at from have or an they which you we not can but if more".split()),
    "de": frozenset("der die das und ist nicht mit den von zu ein eine im auf für sich dem wird als auch es an wenn wer nach noch bevor wir sie er".split()),
    "es": frozenset("el la los las de que y en un una por con para se del al es no lo su más como cuando muy cada también hay está".split()),
    "fr": frozenset("le la les de des et un une du que qui dans est pour pas sur au avec il elle ce se ne plus par on quand chaque très".split()),
}


def syllables(word: str, lang: str) -> int:
    """Syllables of a lower-case word by hyphenation-style rules; at least one."""
    n = len(_VOWELS[lang].findall(word))
    if lang == "en":
        if len(word) > 3 and _EN_SILENT.search(word):
            n -= 1
        n += len(_EN_HIATUS.findall(word))
    elif lang == "fr" and len(word) > 3 and _FR_SILENT.search(word):
        n -= 1
    return max(1, n)


def script(words: list[str]) -> str:
    """The script that most words are in: latin, cyrillic, greek or other."""
    beyond = [w for w in words if not w.isascii() and _BEYOND_LATIN.search(w)]
    if len(beyond) * 2 <= len(words):
        return "latin"
    of = lambda letters: sum(bool(letters.search(w)) for w in beyond) * 2 > len(beyond)
    return "cyrillic" if of(_CYRILLIC) else "greek" if of(_GREEK) else "other"


def language(words: list[str], stated: str | None = None) -> str:
    """The script if it isn't the Latin one, else the stated language if it is known, else the one whose frequent words are most."""
    written = script(words)
    if written != "latin":
        return written
    if stated in _COMMON:
        return stated
    counts = {lang: sum(w in common for w in words) for lang, common in _COMMON.items()}
    return max(counts, key=counts.__getitem__)


def sentences(text: str) -> list[str]:
    """Prose sentences and list items, without code, markup, headings and links."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n\n", text)
    text = _HEADING.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _LINK.sub(" ", text)
    out: list[str] = []
    block: list[str] = []

    def flush() -> None:
        if block:
            joined = " ".join(block)
            at = 0
            for end in _END.finditer(joined):
                out.append(joined[at : end.end()])
                at = end.end()
            out.append(joined[at:])
            block.clear()

    for line in text.split("\n"):
        if not line.strip():
            flush()
        elif item := _ITEM.match(line):
            flush()
            block.append(line[item.end() :])
            flush()
        else:
            block.append(line)
    flush()
    return out


def grade(n_words: int, letters: float, n_syllables: float, complex_words: int) -> float:
    """Median of five grade estimates for one sentence."""
    return median(
        (
            0.39 * n_words + 11.8 * n_syllables / n_words - 15.59,
            0.4 * (n_words + 100 * complex_words / n_words),
            1.043 * (30 * complex_words) ** 0.5 + 3.1291,
            5.88 * letters / n_words - 29.6 / n_words - 15.8,
            4.71 * letters / n_words + 0.5 * n_words - 21.43,
        )
    )


def profile(text: str, stated: str | None = None) -> tuple[list[int], int, int, int, float | None]:
    """Words by grade, words, sentences and syllables, and the median grade of the words; of the whole text."""
    by_grade = [0] * GRADES
    split = [w for w in (_WORD.findall(s.lower()) for s in sentences(text)) if w]
    if not split:
        loose = _WORD.findall(text.lower())  # nothing but markup, code or headings: read as it stands
        split = [loose] if loose else []
    if not split:
        return by_grade, 0, 0, 0, None
    lang = language([w for words in split for w in words], stated)
    if lang == "other":
        return _profile_of_lengths(split)
    cache = _CACHE[lang]
    if len(cache) > 200_000:
        cache.clear()
    letter_scale, syllable_scale, hard_from = LETTER_SCALE[lang], SYLLABLE_SCALE[lang], 4 if lang in ("de", "es") else 3
    total = total_syllables = 0
    for words in split:
        n = len(words)
        counts = []
        for w in words:
            c = cache.get(w)
            if c is None:
                c = cache[w] = syllables(w, lang)
            counts.append(c)
        own = sum(counts)
        g = grade(n, letter_scale * sum(map(len, words)), syllable_scale * own, sum(c >= hard_from for c in counts))
        by_grade[min(GRADES - 1, max(0, round(g)))] += n
        total += n
        total_syllables += own
    middle = int(np.searchsorted(np.cumsum(by_grade), total / 2))
    return by_grade, total, len(split), total_syllables, float(middle)


def _profile_of_lengths(split: list[list[str]]) -> tuple[list[int], int, int, int, float | None]:
    """The profile of prose in a script that tells neither letters nor syllables, by words a sentence."""
    by_grade = [0] * GRADES
    for words in split:
        n = max(1, round(sum(1 if not (k := len(_UNSPACED.findall(w))) else k * WORDS_A_CHARACTER for w in words)))
        by_grade[min(GRADES - 1, max(0, round(grade(n, AVERAGE_LETTERS * n, AVERAGE_SYLLABLES * n, round(AVERAGE_COMPLEX * n)))))] += n
    total = sum(by_grade)
    return by_grade, total, len(split), round(AVERAGE_SYLLABLES * total), float(np.searchsorted(np.cumsum(by_grade), total / 2))


PROFILE = "doc_id bigint, words_by_grade array<int>, n_words bigint, n_sentences bigint, n_syllables bigint, grade double"


def reading_profiles(documents: DataFrame) -> DataFrame:
    """One row per document, in its place: how many words stand at each grade.

    Null, empty and wordless texts have no words and a null grade. An unknown or null lang is found from the words. Repeated
    ids are profiled each on its own; columns other than doc_id, text and lang are left out.
    """

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [profile(t or "", g) for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = (pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", "words_by_grade", "n_words", "n_sentences", "n_syllables", "grade"])

    return spread(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")).mapInArrow(profiles, PROFILE)


def fit_bounds(profiles: DataFrame, ratings: DataFrame, sample: int = RATED_SAMPLE) -> tuple[int, int]:
    """The bounds that agree best with the ratings; of equally good ones, those beside which the fewest words stand.

    At most sample ratings are used.
    Null and unknown levels are left out; without ratings the bounds are DEFAULT_BOUNDS.
    """
    rated = ratings.where(F.col("level").isin(*LEVELS)).select("doc_id", "level").orderBy(F.xxhash64("doc_id", "level")).limit(sample)
    rated = written(rated, "rated")
    own = profiles.where("n_words > 0").join(F.broadcast(rated.select("doc_id").distinct()), "doc_id", "left_semi")
    once = own.groupBy("doc_id").agg(F.min("words_by_grade").alias("words_by_grade"))  # a repeated id is rated once
    pairs = once.join(F.broadcast(rated), "doc_id").select("words_by_grade", "level").collect()
    if not pairs:
        return DEFAULT_BOUNDS
    sums = np.cumsum(np.array([p[0] for p in pairs]), axis=1)
    sums = np.hstack([np.zeros((len(sums), 1), int), sums])
    truth = np.array([LEVELS.index(p[1]) for p in pairs])
    score: dict[tuple[int, int], int] = {}
    for low in range(1, GRADES - 1):
        for high in range(low + 1, GRADES):
            parts = np.stack([sums[:, low], sums[:, high] - sums[:, low], sums[:, -1] - sums[:, high]])
            score[low, high] = int((parts.argmax(axis=0) == truth).sum())
    best = max(score.values())
    words = np.array([p[0] for p in pairs]).sum(axis=0)
    beside = lambda bound: int(words[max(0, bound - 1) : bound + 1].sum())
    return min((k for k, v in score.items() if v == best), key=lambda k: (beside(k[0]) + beside(k[1]), k))


def level_of(bounds: tuple[int, int]) -> Column:
    """The level of most words; ties go to the easier level."""
    part = lambda start, n: F.aggregate(F.slice("words_by_grade", start + 1, n), F.lit(0), lambda a, x: a + x)
    low, high = bounds
    easy, medium, hard = part(0, low), part(low, high - low), part(high, GRADES - high)
    return F.when((easy >= medium) & (easy >= hard), LEVELS[0]).when(medium >= hard, LEVELS[1]).otherwise(LEVELS[2])


def reading_levels(profiles: DataFrame, bounds: tuple[int, int]) -> DataFrame:
    """(doc_id, level, grade, ...) of every document with words in it."""
    return profiles.where("n_words > 0").withColumn("level", level_of(bounds))
