"""Text folding in Python, for use inside Arrow batches."""

from __future__ import annotations

import re
import unicodedata

#: Invisible characters, as fixed values: soft hyphen, joiners, direction marks, word joiner and kin, variation selectors, byte order mark.
INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_WORD = re.compile(r"[^\W_]+")
_NOT_WORD = re.compile(r"[\W_]+")
_ASCII_DROP = bytes(i for i in range(128) if not chr(i).isalnum())


def folded(text: str) -> str:
    """Lower case, composed, without invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", INVISIBLE.sub("", text)).casefold())


def words(text: str | None) -> list[str]:
    return _WORD.findall(folded(text)) if text else []


def squashed(text: str) -> str:
    """Only the letters and digits, folded."""
    if text.isascii():
        return text.encode().lower().translate(None, _ASCII_DROP).decode()
    return _NOT_WORD.sub("", folded(text))
