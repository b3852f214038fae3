"""Word normalisation shared by the text operators of this subpackage."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

_TAG = re.compile(r"<[^<>\n]{1,120}>")
_NOTE = re.compile(r"\[\s?\d{1,3}\s?\]|\[\^\d{1,3}\]|\{\d{1,3}\}")
_COMBINING = re.compile("[̀-ͯ­​-‏⁠﻿]")
_SUPERSCRIPT = re.compile("[¹²³⁰-⁹]+")
_BEYOND_ASCII = re.compile("[^\x00-\x7f]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")
# Letters without a decomposition and their plain spelling.
_PLAIN = str.maketrans({"ß": "ss", "ø": "o", "ł": "l", "ð": "d", "þ": "th", "æ": "ae", "œ": "oe", "ı": "i"})


@lru_cache(maxsize=100_000)
def _folded(stretch: str) -> str:
    return _COMBINING.sub("", unicodedata.normalize("NFKD", _SUPERSCRIPT.sub(" ", stretch))).lower().translate(_PLAIN)


def _fold_match(match: re.Match) -> str:
    return _folded(match.group())


def fold(text: str) -> str:
    """Small letters without accents, markup, note marks and invisible characters."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "[" in text or "{" in text:
        text = _NOTE.sub(" ", text)
    text = text.lower()
    return text if text.isascii() else _BEYOND_ASCII.sub(_fold_match, text)


def words(text: str | None) -> list[str]:
    """Normalised words of a text; none for null or blank text."""
    if not text:
        return []
    folded = fold(text)
    return (_ASCII_WORD if folded.isascii() else _WORD).findall(folded)
