"""Broken prompt and response pairs, with the kind of defect.

Each pair is read once, in its place. A pushdown parser follows fences, markup, brackets, quotations, list items and sentences
through the reply; what its stack holds at the end tells whether the reply stops inside one of them. Greedy string tiling
tells how much of the reply is the prompt given back; scripts by Unicode block and, within the Latin one, counts of frequent
words tell the languages of both; a grammar of refusals, put together from parts of speech per language, tells those.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.normalize import INVISIBLE, squashed, words
from tidemill.runtime import spread

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: Tiles are at least so many words; a copy is a reply that tiles of the prompt cover to COPY_SHARE, and PROMPT_SHARE of the prompt.
TILE, COPY_SHARE, PROMPT_SHARE = 3, 0.85, 0.7

# What stands for nothing, frequent words per language (articles, pronouns, prepositions, conjunctions, auxiliaries and the commonest adverbs and verbs), names of the languages.
PLACEHOLDERS = frozenset("na none null nil nan tbd todo undefined empty noanswer noresponse placeholder".split())
_FREQUENT = {
    "en": "the of and to in is that it was for on are with as this be by at from have or an they which you we not can but if more a i my your our their his her its do does did has had will would should could there here who what when where why how than then so no yes most every each after before over one two people first look some any all only also use look about into them he she him says said say".split(),
    "de": "der die das und ist nicht mit den von zu ein eine im auf für sich dem wird als auch es an wenn wer nach noch bevor wir sie er des einen einem einer war sind hat haben kann soll sollte muss jeden jeder jedes tag zuerst sehr schon etwa dass nur selten oft oder aber bei aus am zum zur über unter wie was wo hier ihn ihm ihr mein dein sein kein keine diese dieser mehr man heute vor durch".split(),
    "es": "a el la los las de que y en un una por con para se del al es no lo su más como cuando muy cada también hay está están son fue era este esta ese esa dónde qué quien debe puede saber casi nunca siempre tarde primero después otra otro vez antes tiene unas unos dice nadie todo todos sobre entre desde hasta sin pero si ya me te le les nos hoy yo ella".split(),
    "fr": "a le la les de des et un une du que qui dans est pour pas sur au aux avec il elle ils on ce se ne plus par quand chaque très ceux cette ces celui soir encore fois aussi après avant personne toujours jamais trop alors jour peut sont été être fait son sa ses leur mais ou où donc tout tous nous vous je tu y en comme même entre".split(),
    "it": "il lo la i gli le di che e un una uno in è per con non si del della dei delle dello al alla ai da dal dalla nel nella su sul sulla come più anche ma se o questo questa questi sono era ha hanno essere molto ogni quando dove chi cosa dopo prima sempre mai ancora già qui lui lei noi voi loro io mi ti ci suo sua tutto tutti".split(),
    "pt": "o a os as de que e um uma em é por com para não se do da dos das ao à no na nos nas como mais mas ou este esta isso são foi era tem têm ser muito cada também quando onde quem depois antes sempre nunca ainda já aqui ele ela eles nós você eu me lhe seu sua todo todos pelo pela entre até sem".split(),
    "nl": "de het een en van in is dat op te zijn voor met niet aan er om ook als maar bij of uit nog naar dan wordt worden heeft hebben kan moet deze dit die door over wat waar wie hoe wanneer zeer elke altijd nooit al hier hij zij wij jullie ik je mijn jouw ons hun geen meer eerst daarna omdat".split(),
}
_NAMED = {
    "en": re.compile(r"\b(?:english|englisch|inglés|ingles|anglais|inglese|inglês|engels)\b"),
    "de": re.compile(r"\b(?:german|deutsch|alemán|aleman|allemand|tedesco|alemão|duits)\b"),
    "es": re.compile(r"\b(?:spanish|spanisch|español|espanol|castellano|espagnol|spagnolo|espanhol|spaans)\b"),
    "fr": re.compile(r"\b(?:french|französisch|francés|frances|français|francais|francese|francês|frans)\b"),
    "it": re.compile(r"\b(?:italian|italienisch|italiano|italien|italiaans)\b"),
    "pt": re.compile(r"\b(?:portuguese|portugiesisch|portugués|portugais|portoghese|português|portugees)\b"),
    "nl": re.compile(r"\b(?:dutch|niederländisch|holandés|néerlandais|olandese|holandês|nederlands)\b"),
    "cyrillic": re.compile(r"\b(?:russian|ukrainian|bulgarian|serbian|russisch|ukrainisch|ruso|ucraniano|russe|ukrainien|cyrillic|по-русски|русском)\b"),
    "han": re.compile(r"\b(?:chinese|mandarin|cantonese|chinesisch|chino|chinois|cinese)\b|中文"),
    "kana": re.compile(r"\b(?:japanese|japanisch|japonés|japonais|giapponese|kanji)\b|日本語"),
    "hangul": re.compile(r"\b(?:korean|koreanisch|coreano|coréen)\b|한국어"),
    "arabic": re.compile(r"\b(?:arabic|arabisch|árabe|arabe|arabo|persian|farsi|urdu)\b|العربية"),
    "hebrew": re.compile(r"\b(?:hebrew|hebräisch|hebreo|hébreu)\b"),
    "greek": re.compile(r"\b(?:greek|griechisch|griego|grec|greco)\b"),
    "indic": re.compile(r"\b(?:hindi|bengali|tamil|telugu|marathi|sanskrit|gujarati|punjabi)\b"),
    "thai": re.compile(r"\b(?:thai|thailändisch|tailandés|thaï)\b"),
}
_ANY_NAMED = re.compile("|".join(p.pattern for p in _NAMED.values()))
#: Letters of the scripts beside the Latin one, by Unicode block.
_SCRIPTS = {
    "cyrillic": re.compile("[\u0400-\u052f]"), "greek": re.compile("[\u0370-\u03ff\u1f00-\u1fff]"), "hebrew": re.compile("[\u0590-\u05ff]"), "arabic": re.compile("[\u0600-\u077f\u08a0-\u08ff\ufb50-\ufdff\ufe70-\ufefc]"),
    "indic": re.compile("[\u0900-\u0dff]"), "thai": re.compile("[\u0e00-\u0eff]"), "hangul": re.compile("[\u1100-\u11ff\uac00-\ud7af]"), "kana": re.compile("[\u3040-\u30ff]"), "han": re.compile("[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]"),
}
_LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u3040-\ud7af\uf900-\ufefc]")
_LANGUAGES = tuple(_FREQUENT)
#: For each frequent word a weight per language: it is shared among the languages that have it.
_WEIGHT: dict[str, tuple[float, ...]] = {}
for _w in {w for ws in _FREQUENT.values() for w in ws}:
    _owners = [_w in _FREQUENT[lang] for lang in _LANGUAGES]
    _WEIGHT[_w] = tuple(o / sum(_owners) ** 2 for o in _owners)
_MARKS = {"de": re.compile("[äöüß]"), "es": re.compile("[ñ¿¡áíóú]"), "fr": re.compile("[èêëàâçîïôûùœ]"), "it": re.compile("[àèìòù]"), "pt": re.compile("[ãõáâêç]")}

_NOT_REFUSED = r"(?! (?:stress|emphasi[sz]e|overstate|help but|wait|say enough|thank|recommend .{0,20}enough|\w+ this enough))"
REFUSALS = [
    re.compile(p)
    for p in (
        # English
        r"\b(?:i|we)(?:'m| am|'re| are)? (?:\w+ )?(?:sorry|afraid),? (?:but |that )?(?:i|we) (?:can't|cannot|can not|won't|will not|am not|am unable|'m unable|'m not)",
        r"\b(?:i|we) (?:can't|cannot|can not|won't|will not|could not|couldn't)" + _NOT_REFUSED + r"(?: \w+)?(?: to)? (?:help|assist|do that|do this|comply|answer|respond|provide|fulfil|fulfill|discuss|share|continue|complete|handle|support|give|engage|process|carry out|say)\b",
        r"\b(?:i|we) (?:must|have to|need to|will have to|'ll have to) (?:\w+ )?(?:decline|refuse|reject)",
        r"\b(?:i|we) (?:\w+ )?(?:decline|refuse) (?:to|this|that|your)",
        r"\b(?:i|we)(?:'m| am|'re| are) (?:\w+ )?(?:unable|not able|not allowed|not permitted|not authori[sz]ed|not in a position) to",
        r"\bi(?:'d| would) rather not\b",
        r"\b(?:i|we)(?:'m| am|'re| are) (?:\w+ )?(?:not|un)(?: \w+)? ?(?:comfortable|willing|prepared|going) (?:to (?:help|assist|answer|do|write|provide|say|discuss|give)|with (?:this|that|it)|\w+ing (?:this|that|it|about|you|such))",
        r"(?:\bnot|n't|\bnever) (?:\w+ )?(?:something|anything) (?:that )?(?:i|we)(?:'m| am| can| are|'re)\b|\b(?:something|anything) (?:that )?(?:i|we)(?:'m| am| can| are|'re)? ?(?:not|unable|cannot|can't)\b",
        r"\bmy (?:guidelines?|polic(?:y|ies)|rules?|instructions?) (?:\w+ )?(?:do|does|don't|doesn't|prevent|prohibit|forbid)",
        r"\b(?:not possible|impossible) for (?:me|us) to",
        r"\b(?:query|question|request|task|prompt) (?:cannot|can't|can not|could not) (?:\w+ )?be (?:answered|fulfill?ed|completed|handled|processed|served)",
        r"\bnone of (?:my|the|our) (?:functions?|tools?) (?:\w+ )?(?:fit|fits|apply|applies|match|matches|can|help|suit)",
        r"\b(?:i|we) have no answer\b",
        r"\b(?:i|we) (?:don't|do not) have the (?:ability|permission|authori[sz]ation|means|right)\b",
        r"\b(?:falls?|is|lies|goes) (?:outside|beyond) (?:of )?(?:what (?:i|we)|my|our)\b",
        r"\bplease (?:ask|contact|try|turn to|consult) (?:someone|somebody|another (?:person|assistant|expert|specialist|professional|colleague|model|service|source))\b",
        r"\b(?:i|we) regret (?:that|to)\b.{0,40}\b(?:not|unable|decline|stop)",
        # Italian, Portuguese, Dutch, Russian, Chinese, Japanese
        r"\bnon (?:posso|possiamo|mi è possibile|sono in grado di|sono autorizzat[oa] a) (?:\w+ )?(?:aiutar\w*|risponder\w*|far\w*|dar\w*|fornir\w*|assister\w*|soddisfar\w*)|\b(?:devo|dobbiamo) (?:rifiutar\w*|declinare)",
        r"\bnão (?:posso|podemos|consigo|me é possível|estou autorizad[oa] a) (?:\w+ )?(?:ajudar|responder|fazer|dar|fornecer|atender|ajudá)|\b(?:devo|tenho de|preciso) (?:recusar|declinar)",
        r"\b(?:ik|wij|we) (?:kan|kunnen|mag|mogen|wil) .{0,60}\bniet\b.{0,30}\b(?:helpen|beantwoorden|antwoorden|geven|doen)|\b(?:ik|wij|we) (?:moet|moeten) .{0,40}\bweigeren\b",
        r"\b(?:я|мы) (?:\w+ )?не (?:могу|можем|буду|будем|имею права|вправе)\b|\bвынужден[аы]? отказать",
        r"(?:我|我们)(?:不能|无法|不可以|没办法)(?:帮|协助|回答|提供|满足|完成|讨论)",
        r"(?:お答え|お手伝い|回答|対応|提供)(?:は|することは|することが)?(?:でき|致しかね|いたしかね|しかね)(?:ません|ます)",
        # German
        r"\b(?:kann|darf|werde|möchte|könnte) (?:ich|wir)\b.{0,60}\b(?:nicht|keine?[nrms]?)\b",
        r"\b(?:ich|wir) (?:kann|können|darf|dürfen|werde|möchte)\b.{0,80}\b(?:nicht|keine?[nrms]?)\b.{0,40}\b(?:helfen|beantworten|antworten|geben|unterstützen|bearbeiten|besprechen|erfüllen|ausführen|tun)\b",
        r"\b(?:muss|möchte) (?:ich|wir)\b.{0,60}\bablehnen\b|\b(?:ich|wir) (?:muss|müssen|möchte)\b.{0,60}\bablehnen\b|\bich lehne\b",
        r"\btut mir leid\b.{0,40}\b(?:nicht|kein)",
        # Spanish
        r"\bno (?:me es posible|puedo|podemos|podré|podría) (?:\w+ )?(?:ayudar|responder|contestar|hacer|dar|atender|cumplir|proporcionar|tratar|asistir|continuar)",
        r"\b(?:debo|tengo que|he de) (?:rechazar|declinar|negarme)",
        r"\bno (?:tengo|cuento con) (?:permiso|autorización)|\bno estoy autorizad[oa]|\bno se me permite|\bme es imposible\b|\bme niego a\b",
        # French
        r"\bje ne (?:peux|pourrai|puis|saurais|vais)(?: \w+)? (?:pas|rien)|\bje (?:dois|préfère) (?:\w+ )?(?:refuser|décliner)|\bje refuse\b|\bje ne suis pas (?:autorisée?|en mesure|habilitée?)|\bil m'est (?:impossible|interdit)|\bje n'ai pas (?:le droit|l'autorisation)|\bje suis au regret",
    )
]


def _needed(parsed) -> frozenset[str]:
    """Literals of which each match of a parsed rule has at least one: those whose shortest is longest. None are known if empty."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        inner = []
        if op is _parser.SUBPATTERN:
            inner = [_needed(value[3])]
        elif op is _parser.BRANCH:
            inner = [_needed(v) for v in value[1]]
        elif op is _parser.MAX_REPEAT and value[0] > 0:
            inner = [_needed(value[2])]
        if inner and all(inner):
            found.append(frozenset().union(*inner))
    return max(found, key=lambda words: (min(map(len, words)), -len(words)), default=frozenset())


#: Each rule with its needed literals, so that a text without them is spared the rule and no sentence of the grammar is lost.
_RULES = [(tuple(sorted(_needed(_parser.parse(p.pattern)))), p) for p in REFUSALS]
_POLITE = re.compile(r"(?:no|sorry|sorry again|apologies|désolée?|lo siento|es tut mir leid|leider|unfortunately|nein|non)[ ,]*", re.I)
_SENTENCE = re.compile(r"[^.!?…\n]+[.!?…]*")

_DONE = re.compile(r"[.!?…。][\"'”’»«)\]*_`~>\s]*$")
_VALUE = re.compile(r"^[^.!?]{1,40}:\s*\S+(?:\s\S+){0,2}$")
#: Words that no sentence or list item ends with; fixed values.
_HANGING = frozenset("a an the of to and or but with for by from in on at as that which because if when than is are was were be der die das den dem ein eine und oder mit von zu im auf für dass weil el la los las un una de del y o con por para que le les des du et ou avec pour dans".split())


def json_stops(text: str) -> bool | None:
    """Whether JSON text breaks off inside a value; None if it isn't JSON that breaks off or ends well."""
    try:
        json.loads(text)
        return False
    except (ValueError, RecursionError):
        pass
    stack: list[str] = []
    at, n = 0, len(text)
    while at < n:
        c = text[at]
        if c == '"':
            at += 1
            while at < n and text[at] != '"':
                at += 2 if text[at] == "\\" else 1
            if at >= n:
                return True
        elif c in "[{":
            stack.append(c)
        elif c in "]}":
            if not stack or (stack.pop() == "[") != (c == "]"):
                return None
        at += 1
    return True if stack else None


# Elements of markup that must be closed, and which bracket or quotation closes which.
_ELEMENTS = frozenset("a abbr article aside b blockquote button code del details div dl em figure footer form h1 h2 h3 h4 h5 h6 header i ins kbd main mark nav ol pre q s section select small span strong sub summary sup table textarea u ul".split())
_CLOSES = {")": "(", "]": "[", "}": "{"}
_TOKEN = re.compile(
    r"(?P<fence>^[ \t>]*(?:```|~~~)[^\n]*)|(?P<blank>\n[ \t>]*(?=\n))|(?P<item>^[ \t]*(?:>[ \t]*)*(?:[-*•·+–]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)])[ \t]+(?=\S))"
    r"|(?P<tag></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?>)|(?P<cut></?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?\Z)|(?P<code>`+)|(?P<open>[(\[{])|(?P<shut>[)\]}])|(?P<mark>[\"“”„«»])|(?P<end>[.!?…。！？]+(?=[\"'”’»«)\]*_`~>\s]|</|\Z))",
    re.M,
)


def _quotation(stack: list[str], mark: str, text: str, at: int) -> None:
    """Opens or closes a quotation: marks stand on either side in one language or another, so what is open decides."""
    partners = {"”": "“„", "“": "„", "»": "«", "«": "»", '"': '"', "„": ""}[mark]
    if stack and stack[-1] in partners:
        stack.pop()
    elif mark != "”" and not (at and text[at - 1].isalnum()) and text[at + 1 : at + 2].strip():
        stack.append(mark)


def left_open(text: str) -> list[str]:
    """What a reply is still inside of at its end, outermost first, by a pushdown parser over the whole text.

    Fences and elements of markup reach over paragraphs; brackets, quotations, code spans, list items and sentences end with
    theirs, and list items also where the next one begins. A sentence ends with its mark. An item of a list whose items are
    no sentences ends with the text, as do a field (`name: value`), a row of a table and a fragment of few words that is all there is.
    """
    stack: list[str] = []
    fence, done, items, block = None, 0, [], 0
    for m in _TOKEN.finditer(text):
        kind, token = m.lastgroup, m[0]
        if kind == "fence":
            bare = token.strip(" \t>")
            if fence is None:
                if bare[:3] not in bare[3:]:  # opened and closed on one line it is a code span
                    fence = bare[:3]
            elif bare.startswith(fence):
                fence = None
                done, block = m.end(), m.end()
            continue
        if fence is not None:
            continue
        if stack and stack[-1][0] == "`" and kind not in ("code", "blank"):
            continue
        if kind in ("blank", "item"):
            while stack and stack[-1][0] != "<":
                stack.pop()
            done = block = m.end()
            if kind == "item":
                items.append(m.end())
        elif kind == "tag":
            name = re.match(r"</?(\w+)", token)[1].lower()
            if name in _ELEMENTS and token[-2] != "/":
                opened = f"<{name}>"
                if token[1] != "/":
                    stack.append(opened)
                elif opened in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(opened) :]
            if token[1] == "/":
                done = m.end()
        elif kind == "cut":
            if re.match(r"</?(\w+)", token)[1].lower() in _ELEMENTS:
                stack.append("<")
        elif kind == "code":
            if stack and stack[-1] == token:
                stack.pop()
                if text[m.start() - 1] in ".!?…。":
                    done = m.end()
            elif text[m.end() : m.end() + 1].strip():
                stack.append(token)
        elif kind == "open":
            stack.append(token)
        elif kind == "shut":
            if stack and stack[-1] == _CLOSES[token]:
                stack.pop()
        elif kind == "mark":
            _quotation(stack, token, text, m.start())
        else:
            done = m.end()
    if fence is not None:
        return [fence]
    tail = text[done:].strip()
    if _ends_open(text, block, items, tail):
        stack.append("item" if items and block == items[-1] else "sentence")
    return stack


def _ends_open(text: str, block: int, items: list[int], tail: str) -> bool:
    """Whether a sentence or list item is open after what follows the last mark."""
    if any(map(str.isalnum, tail)):
        return not _ends_unmarked(text, block, items, tail)
    return bool(block) and tail[-1:] in (",", ";", ":", "-")


def _ends_unmarked(text: str, block: int, items: list[int], tail: str) -> bool:
    """Whether what follows the last sentence may end without a mark: an item, a field, a row, a fragment."""
    tokens = words(tail)
    if tail[-1] in ",;(-–" or tokens[-1:] and tokens[-1] in _HANGING:
        return False
    last = text.rstrip().rsplit("\n", 1)[-1].strip()
    if items and block == items[-1]:
        ends = [text.find("\n", i) for i in items[:-1]]
        others = [text[i:e] for i, e in zip(items, ends, strict=False)]
        if not others:
            return not (tail[:1].isupper() and len(tokens) > 5)
        if sum(bool(_DONE.search(o)) for o in others) * 2 > len(others):
            return False
        return len(words(text[block:])) >= min(len(words(o)) for o in others) - 1
    if _VALUE.match(last) and not last.endswith(":"):
        return True
    if last[0] == "|" and last[-1] == "|" or last[0] == "<" and last[-1] == ">":
        return True
    return len(tokens) <= 3 and tail == text.strip()


def stops_short(text: str) -> bool:
    """Whether a reply stops inside a JSON value, code block, element, bracket, quotation, list item or sentence."""
    text = INVISIBLE.sub("", text).strip()
    if not text:
        return False
    if text[0] in "[{" and (stops := json_stops(text)) is not None:
        return stops
    if text[0] in "[{" and text[-1] in "]}":
        return False  # broken in another way, but at its end
    return bool(left_open(text))


def _window_hashes(codes: list[int], size: int) -> list[int]:
    """A hash of every size words in a row."""
    if len(codes) < size:
        return []
    top = pow(_BASE, size, _PRIME)
    h, out = 0, []
    for i, c in enumerate(codes):
        h = (h * _BASE + c) % _PRIME
        if i >= size:
            h = (h - codes[i - size] * top) % _PRIME
        if i >= size - 1:
            out.append(h)
    return out


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def tiled(reply: list[str], prompt: list[str]) -> tuple[int, int]:
    """Greedy string tiling: words of the reply in tiles of the prompt, and prompt words in tiles.

    Longest tiles first: matches are looked for by hashes of so many words in a row, from the longest possible down by halves
    to TILE; those of one length are extended as far as they go and taken from the longest on, where no tile is yet. A reply
    may give words of the prompt more than once. For each length all words are passed once: n log n in all.
    """
    ids: dict[str, int] = {}
    a, b = ([ids.setdefault(w, len(ids) + 1) for w in side] for side in (reply, prompt))
    taken, used = bytearray(len(a)), bytearray(len(b))
    size = 1 << max(min(len(a), len(b)), 1).bit_length() - 1
    while True:
        size = max(size, TILE)
        starts: dict[int, int] = {}
        for j, h in enumerate(_window_hashes(b, size)):
            if h not in starts or used[starts[h]]:  # words not yet used come first
                starts[h] = j
        matches, i, hashes = [], 0, _window_hashes(a, size)
        while i < len(hashes):
            j = starts.get(hashes[i])
            busy = taken.find(1, i, i + size) if j is not None else -1
            if j is None or busy >= 0 or a[i : i + size] != b[j : j + size]:
                i = busy + 1 if busy >= 0 else i + 1
                continue
            n = size
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not taken[i + n]:
                n += 1
            matches.append((-n, i, j))
            i += n - size + 1
        for n, i, j in sorted(matches):
            if taken.find(1, i, i - n) < 0:
                taken[i : i - n] = b"\1" * -n
                used[j : j - n] = b"\1" * -n
        if size == TILE:
            return sum(taken), sum(used)
        size //= 2


def copies_prompt(reply: list[str], prompt: list[str]) -> bool:
    if len(reply) < TILE or len(prompt) < TILE:
        return reply == prompt and len(reply) > 1
    known, slack = set(prompt), 2  # words beside a changed one may be too few for a tile
    if sum(w in known for w in reply) + slack < COPY_SHARE * len(reply):
        return False
    covered, used = tiled(reply, prompt)
    return covered + slack >= COPY_SHARE * len(reply) and used + slack >= PROMPT_SHARE * len(prompt)


def refuses(text: str) -> bool:
    """Whether a reply declines to help and gives nothing else."""
    low = text.lower().replace("’", "'")
    rules = [p for needed, p in _RULES if not needed or any(w in low for w in needed)]
    if not rules:
        return False
    refused = other = 0
    for s in _SENTENCE.findall(low):
        s = s.strip()
        if not s or not any(c.isalnum() for c in s) or _POLITE.fullmatch(s.rstrip(".!?… ")):
            continue
        if any(p.search(s) for p in rules):
            refused += 1
        else:
            other += 1
    return refused > 0 and other <= refused


def script(text: str) -> str:
    """The script most letters of a text are in; Chinese and Japanese are told apart by kana."""
    if text.isascii() or not _BEYOND_LATIN.search(text):
        return "latin"
    counts = {name: len(letters.findall(text)) for name, letters in _SCRIPTS.items()}
    if counts["kana"] * 10 >= counts["han"]:
        counts["kana"], counts["han"] = counts["kana"] + counts["han"] if counts["kana"] else 0, 0 if counts["kana"] else counts["han"]
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] > len(_LATIN.findall(text)) else "latin"


def language_scores(tokens: list[str], text: str) -> list[float]:
    scores = [0.0] * len(_LANGUAGES)
    for w in tokens:
        weight = _WEIGHT.get(w)
        if weight is not None:
            for i, x in enumerate(weight):
                scores[i] += x
    if not text.isascii():
        for lang, marks in _MARKS.items():
            n = len(marks.findall(text))
            if n:
                scores[_LANGUAGES.index(lang)] += 0.5 * min(n, len(tokens))
    return scores


def told_language(tokens: list[str], text: str) -> str | None:
    """The language of prose in the Latin script, the script of other prose, None where too little tells it."""
    written = script(text)
    if written != "latin":
        return written
    scores = language_scores(tokens, text)
    best = max(range(len(scores)), key=scores.__getitem__)
    second = max(s for i, s in enumerate(scores) if i != best)
    if scores[best] < 1.0 or scores[best] < 1.5 * second or scores[best] < 0.06 * len(tokens):
        return None
    return _LANGUAGES[best]


def asked_languages(prompt: str) -> set[str]:
    low = prompt.lower()
    if not _ANY_NAMED.search(low):
        return set()
    return {lang for lang, name in _NAMED.items() if name.search(low)}


def in_other_language(reply: list[str], reply_text: str, prompt: list[str], prompt_text: str) -> bool:
    """Whether prose is in another script, or in another language of one script, than the prompt, and not in one that was asked for.

    Names of languages in the prompt ask for them. A reply in another script counts even where the language of a prompt in Latin letters isn't told."""
    reply_in = told_language(reply, reply_text)
    if reply_in is None:
        return False
    prompt_in = told_language(prompt, prompt_text)
    if prompt_in is None and (reply_in in _LANGUAGES or not prompt):
        return False
    return reply_in != prompt_in and reply_in not in asked_languages(prompt_text)


_FENCED = re.compile(r"(?ms)^\s*(```|~~~).*?(?:^\s*\1\s*$|\Z)")


def is_empty(reply: str | None) -> bool:
    if reply is None:
        return True
    if len(reply) > 400 and any(map(str.isalnum, reply)):
        return False
    core = squashed(reply)
    return not core or core in PLACEHOLDERS


def defect(prompt: str | None, reply: str | None) -> str | None:
    """The defect of a reply to a prompt, None if there is none. Without a prompt only the reply itself is looked at."""
    if is_empty(reply):
        return "empty"
    text = reply.strip()
    if text[0] in '[{"':
        try:
            value = json.loads(text)
            if not isinstance(value, str):
                return None
            if is_empty(value):
                return "empty"
            text = value.strip()
        except (ValueError, RecursionError):
            if text[0] in "[{" and json_stops(text):
                return "truncated"
    if refuses(text):
        return "refusal"
    tokens = words(text)
    if prompt is not None and prompt.strip():
        asked = words(prompt)
        if copies_prompt(tokens, asked):
            return "copy"
        prose = _FENCED.sub("", text) if "```" in text or "~~~" in text else text
        spoken = tokens if prose is text else words(prose)
        if in_other_language(spoken, prose.lower(), asked, prompt.lower()):
            return "wrong_language"
    return "truncated" if stops_short(text) else None


FOUND = "table_name string, row_key bigint, msg_pos int, defect string"


def _result(table: str, found: list[tuple[int, int, str]]) -> pa.RecordBatch:
    keys, at, kinds = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array([table] * len(found), pa.string()), pa.array(keys, pa.int64()), pa.array(at, pa.int32()), pa.array(kinds, pa.string())], names=["table_name", "row_key", "msg_pos", "defect"])


def dialogue_defects(rows: DataFrame, table_name: str = "sft_row") -> DataFrame:
    """Defects of the assistant messages of rows (row_id, messages), each against the user's last message before it.

    Messages with tool calls are never empty; null messages and null or empty arrays have no replies. A repeated row_id is
    looked at for each of its rows. Other columns are left out; an empty table gives no defects.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, str]] = []
            keys, array = b.column(0).to_pylist(), b.column(1)
            offsets, null, m = array.offsets.to_pylist(), array.is_null().to_pylist(), array.values
            roles, contents, calls = m.field("role").to_pylist(), m.field("content").to_pylist(), m.field("calls").to_pylist()
            for k, key in enumerate(keys):
                if null[k]:
                    continue
                prompt = None
                for i, at in enumerate(range(offsets[k], offsets[k + 1])):
                    if roles[at] == "user":
                        prompt = contents[at]
                    elif roles[at] == "assistant":
                        if calls[at] and is_empty(contents[at]):
                            continue
                        kind = defect(prompt, contents[at])
                        if kind:
                            out.append((key, i, kind))
            yield _result(table_name, out)

    brief = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), (F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0).alias("calls")))
    return spread(rows.select(F.col("row_id").cast("bigint").alias("row_id"), brief.alias("messages"))).mapInArrow(found, FOUND)


def pair_defects(rows: DataFrame, key: str, prompt: str, reply: str, table_name: str) -> DataFrame:
    """Defects of rows that hold one prompt and one reply each, at position 0. Null replies are empty."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = map(defect, b.column(1).to_pylist(), b.column(2).to_pylist())
            yield _result(table_name, [(k, 0, kind) for k, kind in zip(b.column(0).to_pylist(), kinds, strict=True) if kind])

    narrow = rows.select(F.col(key).cast("bigint").alias("k"), F.col(prompt).cast("string").alias("p"), F.col(reply).cast("string").alias("r"))
    return spread(narrow).mapInArrow(found, FOUND)
