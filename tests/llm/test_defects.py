"""Broken pairs: the kinds, hard look-alikes of them, and odd rows."""

import random
import time

import pytest

from tidemill.llm.defects import defect, dialogue_defects, pair_defects, stops_short, tiled

ASK = "How can I review the unusual cache called Vanaba when the dashboard shows 807 errors?"


@pytest.mark.parametrize(
    ("reply", "kind"),
    [
        (None, "empty"), ("", "empty"), (" \t\n", "empty"), ("\u200b", "empty"), ("N/A", "empty"), ("null", "empty"), ("...", "empty"), ("[]", "empty"), ("{}", "empty"), ('""', "empty"), ("[ ]", "empty"), ("—", "empty"),
        ("Yes.", None), ("954", None), ("350 rows", None), ("Look at the old map!", None), ("Use the second one.", None),
        ("The cache is small. You should load it because", "truncated"), ("The cache is small. People who load the,", "truncated"), ("Look at this.\n\n```\nfor x in y:\n    run(x)", "truncated"),
        ("Look at this.\n\n```\nfor x in y:\n    run(x)\n```", None), ('[{"name": "a", "arguments": {"b": [1, 2', "truncated"), ('[{"name": "a", "arguments": {"b": "x', "truncated"), ('[{"name": "a", "arguments": {}}]', None),
        ("Do this.\n- load the file\n- drop the old index", None), ("1. We load the file first.\n2. We load the", "truncated"), ("Multiply 2 by 3.\nFinal answer: 6", None), ("It is good (see the", "truncated"), ("He said 'it is done.'", None),
        ("I'm sorry, but I can't help with that.", "refusal"), ("Unfortunately I am not able to answer questions on Vanaba.", "refusal"), ("Sorry! None of my functions fit, so I have no answer for Vanaba.", "refusal"), ("No. I won't do that.", "refusal"),
        ("I’m sorry, but I can’t help with that.", "refusal"), ("Das muss ich ablehnen.", "refusal"), ("Debo rechazar esta solicitud.", "refusal"), ("Je suis désolé, mais je ne peux pas vous aider.", "refusal"), ("Es tut mir leid, aber dabei kann ich nicht helfen.", "refusal"),
        ("You cannot store more than 37 rows at once, so do it in steps.", None), ("I can't stress this enough: load the file first.", None), ("I'm sorry to hear that the cache failed, here is what to do.", None), ("It is not possible to load a frozen index, but a copy works well.", None), ("Which cache should I use?", None), ("Sorry for the long wait! Load it again.", None),
        (ASK, "copy"), (ASK.upper().replace("?", "!"), "copy"), (ASK + "\n" + ASK, "copy"), (ASK.replace("unusual", "quickly"), "copy"), (ASK + "\n\nFirst you load the file. Then you check what the others have written about it and keep the rest.", None),
        ("Quand le fichier semble trop grand, une personne vérifie alors le message.", "wrong_language"), ("Wenn der Speicher zu groß wird, prüft das Team zuerst den Ordner.", "wrong_language"), ("Cuando el archivo parece muy grande, el equipo revisa primero el mensaje.", "wrong_language"),
        ("```\nprint('le la les des')\n```", None),
    ],
)
def test_kinds(reply, kind):
    assert defect(ASK, reply) == kind


@pytest.mark.parametrize(
    "reply",
    [
        "I'm sorry, but I can't say.", "We are afraid that we cannot say.", "I won't answer.", "We could not answer this.", "I couldn't help.", "I can not comply.", "I must reject your request.", "We will have to decline.", "I need to refuse.", "I decline to answer.", "We refuse this.",
        "I am unable to say.", "We're not able to say.", "I'm not allowed to say.", "I am not permitted to say.", "We are not authorised to say.", "I'm not authorized to say.", "I am not in a position to say.", "I'd rather not say.", "That's not something I can do.", "This isn't something we're allowed to say.", "It is something I cannot do.", "Anything I'm unable to read stays unread.",
        "My guidelines forbid it.", "My policy does not let me.", "My rules prevent that.", "My instructions prohibit this.", "It is not possible for me to say.", "It's impossible for us to say.", "This question cannot be answered.", "The task can't be completed.", "Your prompt could not be processed.", "The query cannot be served.", "That request can not be handled.", "This request cannot be fulfilled.",
        "None of my tools fit.", "None of the functions apply.", "I have no answer.", "We don't have the means.", "I do not have the right.", "I don't have the authorization.", "I don't have the ability.", "I do not have the permission.", "It falls outside what I know.", "That lies beyond our field.", "Please ask someone else.", "Please contact somebody else.", "Please turn to another person.", "We regret to stop here.", "I regret that I'm unable.",
        "Das kann ich nicht.", "Dazu darf ich kein Wort sagen.", "Das werde ich nicht tun.", "Ich kann dir dabei nicht helfen.", "Wir dürfen dazu keine Auskunft geben.", "Das möchte ich ablehnen.", "Wir müssen das ablehnen.", "Ich lehne das ab.", "Tut mir leid, das geht nicht.",
        "No me es posible responder a eso.", "No puedo ayudar.", "No podemos responder.", "No podré contestar.", "No podría atender eso.", "Debo declinar.", "Tengo que negarme.", "He de rechazar eso.", "No tengo permiso.", "No cuento con autorización.", "No estoy autorizada.", "No se me permite.", "Me es imposible.", "Me niego a eso.",
        "Je ne peux pas.", "Je ne pourrai pas répondre.", "Je ne puis rien dire.", "Je ne saurais pas répondre.", "Je ne vais pas répondre.", "Je dois décliner.", "Je préfère refuser.", "Je refuse.", "Je ne suis pas autorisée.", "Je ne suis pas en mesure.", "Je ne suis pas habilité.", "Il m'est impossible.", "Il m'est interdit.", "Je n'ai pas le droit.", "Je n'ai pas l'autorisation.", "Je suis au regret.",
    ],
)
def test_each_sentence_of_the_refusal_grammar_is_found(reply):
    assert defect(None, reply) == "refusal"


@pytest.mark.parametrize("reply", ["Please try another browser.", "Is there anything I can do for you?", "It is something we like.", "Here is something that I'm proud of."])
def test_weak_hints_are_no_refusals(reply):
    assert defect(None, reply) is None


def test_a_language_that_was_asked_for_is_right():
    reply = "Wenn der Speicher zu groß wird, prüft das Team zuerst den Ordner."
    assert defect(ASK + " Answer in German, please.", reply) is None
    assert defect(ASK + " Answer in French, please.", reply) == "wrong_language"


def test_without_prompt_only_the_reply_counts():
    assert defect(None, "Quand le fichier semble trop grand, on le lit.") is None
    assert defect(None, "It breaks off because") == "truncated"


def test_long_texts():
    text = "The cache is small and the team reads it. " * 50_000
    assert defect(ASK, text) is None
    assert stops_short(text + "It is")
    assert defect(ASK, "[" * 100_000) == "truncated" or defect(ASK, "[" * 100_000) == "empty"


def test_tiling_lets_prompt_words_be_used_again():
    assert tiled("a b c d a b c d".split(), "a b c d".split()) == (8, 4)
    assert tiled("x y z".split(), "a b c d".split()) == (0, 0)


MESSAGES = "row_id bigint, messages array<struct<role string, content string, name string, tool_calls array<struct<type string, function struct<name string, arguments string>>>>>, defect string"


def test_dialogues(spark):
    call = [("function", ("f", "{}"))]
    rows = [
        (1, [("user", ASK, None, None), ("assistant", None, None, call), ("tool", "{}", "f", None), ("assistant", "", None, None)], "x"),
        (2, [("user", ASK, None, None), ("assistant", None, None, None), ("user", "And now?", None, None), ("assistant", "It breaks because", None, [])], None),
        (3, None, None), (4, [], None), (5, [None, ("assistant", "", None, None)], None), (1, [("assistant", "", None, None)], "x"), (6, [("assistant", None, None, [])], None),
    ]
    got = sorted(map(tuple, dialogue_defects(spark.createDataFrame(rows, MESSAGES)).collect()))
    assert got == [("sft_row", 1, 0, "empty"), ("sft_row", 1, 3, "empty"), ("sft_row", 2, 1, "empty"), ("sft_row", 2, 3, "truncated"), ("sft_row", 5, 1, "empty"), ("sft_row", 6, 0, "empty")]


def test_empty_tables(spark):
    assert dialogue_defects(spark.createDataFrame([], MESSAGES)).count() == 0
    assert pair_defects(spark.createDataFrame([], "row_no bigint, query string, answers string"), "row_no", "query", "answers", "t").count() == 0


def test_pairs_with_nulls(spark):
    rows = [(1, None, None, "a"), (2, "Hello there, how are you?", None, "b"), (3, None, "Fine.", "c"), (3, None, "Fine.", "c")]
    got = pair_defects(spark.createDataFrame(rows, "row_no bigint, query string, answers string, p string"), "row_no", "query", "answers", "t").collect()
    assert sorted(map(tuple, got)) == [("t", 1, 0, "empty"), ("t", 2, 0, "empty")]


@pytest.mark.parametrize(
    ("reply", "kind"),
    [
        ("<ul><li>one</li><li>two", "truncated"), ("<ul><li>one</li><li>two</li></ul>", None), ("It is done. (for instance when it walks a tree.", "truncated"), ("It is done (for instance when it walks a tree).", None), ("She said “it is done.", "truncated"),
        ("Use `load(", "truncated"), ("Use `load()`.", None), ("See <a href=\"x\">this</a>.", None), ("See <a href=\"x", "truncated"), ("A list[int] holds numbers.", None), ("If a < b, it holds.", None), ("- first it (loads\n- then it runs\n- then it ends", None),
        ("```\nx = 1\n```\n```\ny = 2", "truncated"), ("One.\n\nTwo (see\n\nThree.", None), ("| a | b |\n| 1 | 2 |", None), ("Ответ готов, и он", "wrong_language"),
        ("Это очень хороший ответ на вопрос.", "wrong_language"), ("这是一个很好的回答。", "wrong_language"), ("هذا جواب جيد على السؤال.", "wrong_language"), ("Questo è un file molto grande e non si può leggere ogni giorno.", "wrong_language"), ("これはとても良い答えです。", "wrong_language"),
        ("К сожалению, я не могу помочь с этим.", "refusal"), ("I'm not comfortable writing that.", "refusal"), ("Mi dispiace, non posso aiutarti.", "refusal"), ("Não posso responder.", "refusal"), ("Dat kan, maar ik kan je daar niet mee helpen.", "refusal"), ("抱歉，我不能帮你。", "refusal"), ("I am not going to the shop today.", None),
    ],
)
def test_markup_brackets_scripts_and_other_languages(reply, kind):
    assert defect(ASK, reply) == kind


def test_a_script_that_was_asked_for_is_right():
    assert defect("Please answer in Russian: what is a cache?", "Это память для данных.") is None
    assert defect("Please answer in Chinese: what is a cache?", "Это память для данных.") == "wrong_language"
    assert defect("Что такое кэш?", "It is the memory that is used for data.") == "wrong_language"
    assert defect("日本語の質問です。", "これは答えです。") is None


def test_quotations_of_other_languages_close():
    assert not any(map(stops_short, ("„Es ist fertig.“", "«C'est fini.»", "»Es ist fertig.«", "“It is.”")))
    assert all(map(stops_short, ("„Es ist fertig.", "«C'est fini.", "“It is.")))


def test_code_spans():
    assert not any(map(stops_short, ("It holds the useful `tokenizer.`", "An index `` alone is fine.", "Use `a` and `b`.")))
    assert all(map(stops_short, ("It holds the `tokenizer.", "Use `a` and `b")))


def test_the_parser_decides(monkeypatch):
    replies = ["It is good (see the", "It breaks off because", "<ul><li>one", "1. We load the file first.\n2. We load the", "```\nx = 1"]
    assert [defect(ASK, r) for r in replies] == ["truncated"] * 5
    monkeypatch.setattr("tidemill.llm.defects.left_open", lambda text: [])
    assert [defect(ASK, r) for r in replies] == [None] * 5


def test_tiling_takes_the_longest_first():
    # from the left, "a b c" would be taken first and break the longer "b c d e f"
    assert tiled("a b c d e f".split(), "x a b c x b c d e f".split()) == (5, 5)
    rng = random.Random(9)
    for _ in range(300):
        reply, prompt = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        covered, used = tiled(reply, prompt)
        inside = {tuple(prompt[i : i + 3]) for i in range(len(prompt))}
        possible = set()
        for i in range(len(reply) - 2):
            if tuple(reply[i : i + 3]) in inside:
                possible |= {i, i + 1, i + 2}
        assert covered <= len(possible) and used <= len(prompt) and bool(covered) == bool(possible)


def test_tiling_is_fast_on_long_repetitive_texts():
    words = ("one two three four five " * 20_000).split()
    start = time.perf_counter()
    assert tiled(words, words) == (100_000, 100_000)
    assert tiled(words, words[:7] + ["x"] + words[:40_000])[0] > 99_000
    assert time.perf_counter() - start < 20
