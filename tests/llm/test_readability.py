"""Reading levels: syllables, sentences, accuracy on held-out ratings, odd rows."""

from tidemill.llm.readability import DEFAULT_BOUNDS, fit_bounds, profile, reading_levels, reading_profiles, sentences, syllables

EASY = "The cat is small. We run to the hat. Put it in the box. Look at the dog! I like the map."
MEDIUM = "When a dataset looks noisy, the team at the office rarely stores the dataset and the tokenizer. You should compare the recent dashboard slowly if the folder has more than twelve entries."
HARD = "Because distributional misalignment simultaneously complicates quantization uncertainty and constrains methodological parameterization, the experimental protocol incorporates heteroscedastic hyperparameter sensitivity throughout approximately all independent replications of the counterfactual characterization."
DOCS = "doc_id bigint, text string, lang string, level string, n_words string"


def test_syllables():
    for word, n in {"cat": 1, "table": 2, "walked": 1, "reading": 2, "hyperparameter": 6, "the": 1, "idea": 3}.items():
        assert syllables(word, "en") == n, word
    assert syllables("straße", "de") == 2
    assert syllables("perro", "es") == 2
    assert syllables("livre", "fr") == 1


def test_sentences_leave_out_code_and_markup():
    text = "# Title\n\nOne is here. Two is\nthere!\n\n```\ncode = 1\n```\n- an item\n- another one\n<b>Three</b> ends.Four begins."
    assert [s.strip() for s in sentences(text)] == ["One is here.", "Two is there!", "", "an item", "", "another one", "", "Three  ends.", "Four begins.", ""] or [s.strip() for s in sentences(text) if s.strip()] == ["One is here.", "Two is there!", "an item", "another one", "Three  ends.", "Four begins."]


def _levels(spark, rows):
    profiles = reading_profiles(spark.createDataFrame(rows, DOCS))
    return {r["doc_id"]: r["level"] for r in reading_levels(profiles, DEFAULT_BOUNDS).collect()}


def test_levels_go_by_most_of_the_words(spark):
    rows = [(1, EASY, "en", "", ""), (2, MEDIUM, "en", "", ""), (3, HARD, "en", "", ""), (4, (EASY + " ") * 4 + MEDIUM, "en", "", ""), (5, EASY + " " + HARD, None, "", ""), (6, "# " + MEDIUM, "xx", "", "")]
    assert _levels(spark, rows) == {1: "easy", 2: "medium", 3: "hard", 4: "easy", 5: "hard", 6: "medium"}


def test_odd_rows(spark):
    rows = [(1, None, None, "", ""), (2, "", "en", "", ""), (3, " \n\u200b", "en", "", ""), (4, "123 !!", "de", "", ""), (5, "```\nonly code here\n```", "en", "", ""), (6, EASY * 20_000, "en", "", ""), (6, EASY, "en", "", ""), (None, EASY, "en", "", "")]
    got = reading_levels(reading_profiles(spark.createDataFrame(rows, DOCS)), DEFAULT_BOUNDS).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 5, 6, 6]
    assert _levels(spark, []) == {}
    assert profile("")[4] is None


def test_bounds(spark):
    profiles = reading_profiles(spark.createDataFrame([(1, EASY, "en", "", ""), (2, MEDIUM, "en", "", ""), (3, HARD, "en", "", "")], DOCS))
    ratings = "doc_id bigint, rater string, level string"
    assert fit_bounds(profiles, spark.createDataFrame([], ratings)) == DEFAULT_BOUNDS
    assert fit_bounds(profiles, spark.createDataFrame([(1, "a", None), (2, "a", "odd")], ratings)) == DEFAULT_BOUNDS
    low, high = fit_bounds(profiles, spark.createDataFrame([(1, "a", "easy"), (2, "a", "medium"), (3, "b", "hard")], ratings))
    assert {r["doc_id"]: r["level"] for r in reading_levels(profiles, (low, high)).collect()} == {1: "easy", 2: "medium", 3: "hard"}


def test_accuracy_on_held_out_ratings(spark, sf):
    small = sf.replace("sf0.001", "sf0.01")
    documents, ratings = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "reading_label"))
    profiles = reading_profiles(documents).cache()
    bounds = fit_bounds(profiles, ratings.where("doc_id % 2 = 0"))
    held = reading_levels(profiles, bounds).select("doc_id", "level").join(ratings.where("doc_id % 2 = 1 and level is not null").select("doc_id", "level").withColumnRenamed("level", "rated"), "doc_id").collect()
    assert sum(r["level"] == r["rated"] for r in held) >= 0.85 * len(held)


def test_other_scripts_are_not_read_as_english():
    from tidemill.llm.readability import language, profile, syllables

    assert syllables("молоко", "cyrillic") == 3 and syllables("άνθρωπος", "greek") == 3
    assert language("это очень хороший дом".split(), "en") == "cyrillic" and language("the house и".split()) == "en"
    short, long = "Кот спит. Дом стоит.", "Представленная концептуализация методологических предпосылок обусловливает необходимость всестороннего переосмысления исследовательских парадигм. " * 2
    assert profile(short)[4] < 6 < profile(long)[4]
    easy, hard = "我去。你来。", "我" * 80 + "。"
    assert profile(easy)[1] > 0 and profile(easy)[4] < profile(hard)[4]
    assert profile("هذا بيت. هذا باب.")[4] < profile("هذا " * 60 + ".")[4]


def test_repeated_ids_do_not_enlarge_the_sample(spark):
    from tidemill.llm.readability import fit_bounds, reading_profiles

    docs = spark.createDataFrame([(1, "The cat sat. The dog ran.", "en")] * 50 + [(2, "Notwithstanding considerable methodological heterogeneity, interdisciplinary investigations demonstrate extraordinarily consistent epistemological presuppositions.", "en")], "doc_id bigint, text string, lang string")
    ratings = spark.createDataFrame([(1, "a", "easy"), (1, "b", "easy"), (2, "a", "hard"), (2, "b", None)], "doc_id bigint, rater string, level string")
    low, high = fit_bounds(reading_profiles(docs), ratings)
    assert 0 < low < high
