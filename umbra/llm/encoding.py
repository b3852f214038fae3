"""Garbled text from a wrong character encoding (problem 9).

Method: every character that a legacy code page gives to a byte of 0x80 or more is
mapped back to that byte; a byte-structure automaton (one regular expression for each
code page, over the characters that stand for lead and continuation bytes) finds the
maximal runs of well-formed multibyte sequences; only those runs are decoded.  The
result is scanned again until nothing changes (each round makes the text shorter), so text
read wrongly more than once is unwound.  Any assigned character may come out.  Letters and
signs of the ranges in ``ALONE`` count by themselves; those of other scripts count where
they stand in company: a run of several of one script, for a single one may be a chance
neighbour in right text ("CAFE" in accented capitals before a quotation mark).

Single-byte text read with another single-byte page holds no multibyte sequence, so the
named method cannot see it; it is found by the letter patterns that such readings leave
(see ``_single_byte``).

Defined results: null and blank text are not affected; replacement characters count
as affected and stay as they are (their original is lost); an HTML escape counts only
if the character it stands for is part of a garbled run; where two pages explain the same
runs by different texts the likelier is given and marked as lossy.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Legacy code pages in which multibyte text is commonly misread.
CODE_PAGES = ("cp1252", "latin-1", "iso8859-15", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859-2", "cp1254", "cp1257", "koi8-r", "cp866", "mac_cyrillic", "cp1253", "cp1255", "cp1256", "cp1258", "cp874", "iso8859-7", "iso8859-9")

# Code point ranges whose characters count by themselves.
ALONE = (
    (0xA0, 0x17F), (0x192, 0x192), (0x1A0, 0x1A1), (0x1AF, 0x1B0), (0x218, 0x21B), (0x2C6, 0x2DC), (0x386, 0x3CE), (0x401, 0x45F), (0x490, 0x491),
    (0x1E00, 0x1EFF), (0x200B, 0x2027), (0x202F, 0x205E), (0x2070, 0x209F), (0x20A0, 0x20BF), (0x2100, 0x23FF), (0x2460, 0x27BF), (0x2900, 0x2BFF), (0xF8FF, 0xF8FF), (0xFB01, 0xFB02), (0xFEFF, 0xFEFF), (0xFFFD, 0xFFFD), (0x1F000, 0x1FAFF),
)
# Accents that follow the letter they stand over.
ACCENTS = frozenset("\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0323\u0327\u0328")
# Names of scripts that are written together, as character names begin.
TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "FULLWIDTH": "CJK", "HALFWIDTH": "CJK", "IDEOGRAPHIC": "CJK", "LEFT": "CJK", "RIGHT": "CJK"}


@lru_cache(maxsize=200_000)
def _script(ch: str) -> str | None:
    """Script of a character that needs company, "" of one that counts alone, None of one that cannot come out."""
    if ch != "\uf8ff" and unicodedata.category(ch) in ("Cn", "Co", "Cs", "Cc"):  # that sign is a byte of mac_roman
        return None
    point = ord(ch)
    if any(low <= point <= high for low, high in ALONE):
        return ""
    name = unicodedata.name(ch, "").split(" ")[0]
    return TOGETHER.get(name, name)


def _weight(decoded: str, before: str) -> bool | None:
    """Whether a decoded run counts by itself (True), only in company (False), or not at all (None)."""
    scripts = [_script(c) for c in decoded]
    if any(s is None and not "\x80" <= c <= "\x9f" for s, c in zip(scripts, decoded)) or all(s is None for s in scripts):
        return None
    if decoded[0] in ACCENTS and before.isalpha() and before.islower():
        return True
    foreign = [s for s in scripts if s]
    if len(foreign) * 2 < len(decoded):
        return True
    most = max(map(foreign.count, set(foreign)))
    # two characters of three bytes or three of two bytes do not come about by chance
    return most >= (2 if len(decoded[0].encode()) > 2 else 3) and most * 4 >= len(foreign) * 3


def _byte_map(page: str) -> dict[str, int]:
    """Character to byte for 0x80..0xFF; bytes without a character keep their C1 control."""
    out = {}
    for byte in range(0x80, 0x100):
        try:
            out[bytes([byte]).decode(page)] = byte
        except UnicodeDecodeError:
            out[chr(byte)] = byte
    return out


@lru_cache(maxsize=None)
def _page(page: str) -> tuple[dict[str, int], re.Pattern]:
    back = _byte_map(page)

    def chars(low: int, high: int) -> str:
        return "[" + "".join(re.escape(c) for c, b in back.items() if low <= b <= high) + "]"

    cont = chars(0x80, 0xBF)
    unit = f"{chars(0xC2, 0xDF)}{cont}|{chars(0xE0, 0xEF)}{cont}{cont}|{chars(0xF0, 0xF4)}{cont}{cont}{cont}"
    return back, re.compile(f"(?:{unit})+")


_BEYOND_ASCII = re.compile("[^\x00-\x7f]{2,}")
Run = tuple[int, int, str, bool]


@lru_cache(maxsize=200_000)
def _decoded(stretch: str, before: str) -> tuple[tuple[int, tuple[Run, ...]], ...]:
    """For each code page that finds any: its maximal well-formed runs in a stretch without ASCII."""
    out = []
    for order, page in enumerate(CODE_PAGES):
        back, pattern = _page(page)
        runs = []
        for match in pattern.finditer(stretch):
            try:
                decoded = bytes(back[c] for c in match.group()).decode("utf-8")
            except UnicodeDecodeError:
                continue
            alone = _weight(decoded, before if match.start() == 0 else stretch[match.start() - 1])
            if alone is not None:
                runs.append((match.start(), match.end(), decoded, alone))
        if runs:
            out.append((order, tuple(runs)))
    return tuple(out)


def _runs(text: str) -> dict[int, list[Run]]:
    """Maximal well-formed runs by code page (its place in ``CODE_PAGES``) as (start, end, decoded).

    Runs that need company stay only beside others of their script.
    """
    out: dict[int, list[Run]] = {}
    for match in _BEYOND_ASCII.finditer(text):
        at, stretch = match.start(), match.group()
        before = text[at - 1] if at else " "
        for order, runs in _decoded(stretch, before) if len(stretch) < 200 else _decoded.__wrapped__(stretch, before):
            out.setdefault(order, []).extend((at + s, at + e, d, alone) for s, e, d, alone in runs)
    kept = {}
    for order, runs in out.items():
        scripts = {_script(c) for _, _, d, alone in runs if alone for c in d} - {"", None}
        runs = [r for r in runs if r[3] or {_script(c) for c in r[2]} - {"", None} <= scripts]
        if any(alone for *_, alone in runs):
            kept[order] = runs
    return kept


_CYRILLIC = re.compile(r"[\u0400-\u04ff]")
_CYRILLIC_PAGES = frozenset(("cp1251", "koi8-r", "cp866", "mac_cyrillic"))
_CONTROL = re.compile(r"[\x80-\x84\x86-\x9f]")


# Letters of the Cyrillic pages that right Russian does not hold.
_NOT_RUSSIAN = frozenset("ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐґЅѕј")
_RUSSIAN_MARKS = frozenset("«»„“”…–—№’‘ \xa0")


def _credible(text: str, page: str, runs: list[Run]) -> bool:
    """Whether runs of a page are garbling rather than chance neighbours in right text."""
    if not runs:
        return False
    units = sum(len(decoded) for _, _, decoded, _ in runs)
    if page in _CYRILLIC_PAGES:  # right Cyrillic text holds such pairs by chance
        if any(c in _NOT_RUSSIAN or not c.isalpha() and c not in _RUSSIAN_MARKS for start, end, _, _ in runs for c in text[start:end]):
            return True
        rest, at = [], 0
        for start, end, _, _ in runs:
            rest.append(text[at:start])
            at = end
        rest.append(text[at:])
        outside = len(_CYRILLIC.findall("".join(rest)))
        longest = max(len(decoded) for _, _, decoded, _ in runs)
        return units > outside / 4 if longest < 4 else True
    if page not in ("cp1252", "latin-1", "iso8859-15"):
        if any(end - start >= 4 or end - start == 3 and not text[start:end].isalpha() for start, end, _, _ in runs):
            return True
        return any(c.isalpha() or c in "\u2019\u201c\u201d\u2013\u2014\u2026\u00a3\u20ac\u00a7\u00b0\u00d7\u2212\ufffd" for _, _, d, _ in runs for c in d)
    return True


# What is left of a sequence whose later bytes were lost or turned into plain blanks.
_REMAINS = re.compile("\u00e2\u20ac|\u00e2\u201a\u00ac|(?:^|[\\s('\u2019])[\u00c3\u00c2](?=[\\s,.])|\\s\u00e2\\s|\u00ef\u00bf\u00bd|\u00c3[\u0080-\u00bf]")

# Letters of a Cyrillic page read as a western one: words wholly of accented letters.
_ACCENTED_WORD = re.compile("(?<![A-Za-z\u00c0-\u00ff])[\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u00f7]{4,}(?![A-Za-z\u00c0-\u00ff])")
# Letters of a central European page read as a western one: signs inside words.
_SIGN_IN_WORD = re.compile("[a-z\u00df-\u00ff\u0153\u0178][\u00b3\u00b9\u00bf\u00b6\u00b1\u00bc\u0178\u00a5\u00a3\u00a1][a-z\u00df-\u00ff\u0153]")
# Turkish letters read as the western ones of the same bytes, in texts without the accents that go with those elsewhere.
_TURKISH_WORD = re.compile("[^\\W\\d_]*[a-z\u00e7\u00f6\u00fc][\u00f0\u00fd\u00fe][^\\W\\d_]*|[\u00f0\u00fd\u00fe][a-z][^\\W\\d_]*[\u00f0\u00fd\u00fe][^\\W\\d_]*")
_NOT_TURKISH = re.compile("[\u00e1\u00e6\u00e9\u00ed\u00f3\u00fa\u00c1\u00c6\u00c9\u00cd\u00d3\u00da]")
_TURKISH = str.maketrans("\u00f0\u00fd\u00fe\u00d0\u00dd\u00de", "\u011f\u0131\u015f\u011e\u0130\u015e")
# Punctuation of another page inside words.
_MARK_IN_WORD = re.compile("[a-z]{2}[\u201a\u201e\u0192\u2020\u2021\u02c6\u2030\u02dc\u2122\u00a2\u00a4\u00a6\u00ac\u00af\u00b8\u00b4\u221a\u2248\u2202\u2260\u25ca\u2261\u2320\u2552-\u2593][a-z]")
# Cyrillic or Greek letters inside a Latin word.
_MIXED_WORD = re.compile("[a-z][\u0400-\u045f\u0391-\u03c9\u0393\u0398\u03a6][a-z]|[a-z]{2}[\u0430-\u044f]\\b")
# Accented capitals and signs inside words in small letters.
_CAPITAL_IN_WORD = re.compile("[a-z][\u00c0-\u00d6\u00d8-\u00de\u0160\u017d\u0178\u00a1-\u00a5][a-z]")
# Readings tried for such marks: the page of the text, the page it was read with.
_PAIRS = (("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"))
# Words of Cyrillic letters with the case turned round.
_TURNED_CASE = re.compile("\\b[\u0430-\u044f][\u0410-\u042f]{3,}\\b")


def _letters(text: str, page: str, target: str) -> str | None:
    try:
        return text.encode(page).decode(target)
    except (UnicodeEncodeError, UnicodeDecodeError):
        return None


# The most frequent letters of Russian and Greek.
_COMMON_LETTERS = dict.fromkeys("\u043e\u0435\u0430\u0438\u043d\u0442\u0441\u0440\u0432\u043b\u03b1\u03bf\u03b9\u03b5\u03c4\u03c3\u03bd\u03b7\u03c5\u03c1\u03c2", 1)
_POLISH = str.maketrans({"\u00b3": "\u0142", "\u00b9": "\u0105", "\u00ea": "\u0119", "\u0153": "\u015b", "\u00bf": "\u017c", "\u0178": "\u017a", "\u00e6": "\u0107", "\u00f1": "\u0144", "\u00a3": "\u0141", "\u00b6": "\u015b", "\u00b1": "\u0105", "\u00bc": "\u017a", "\u0152": "\u015a", "\u00af": "\u017b", "\u00a6": "\u015a"})
_WORD = re.compile(r"[^\s.,;:!?()\"]+")


# One of these characters is part of everything that ``_single_byte`` finds; common letters of right text are not among them.
_ODD = re.compile("[\u00c0-\u00d6\u00d8-\u00de\u00a1-\u00bf\u0160\u017d\u0178\u0192-\u03ff\u0400-\u045f\u201a\u201e-\u2021\u2030\u2122\u2202-\u2593]|[\u00e0-\u00ff]{4}")


def _single_byte(text: str) -> tuple[str, list[tuple[int, int]], str] | None:
    """(restored text, spans, name of the reading) where one single-byte page was read as another."""
    if not _ODD.search(text):
        return None
    words = list(_ACCENTED_WORD.finditer(text))
    if words and (len(words) > 1 or len(words[0].group()) > 5):
        best, joined = None, "".join(w.group() for w in words)
        for target in ("cp1251", "koi8-r", "iso8859-5", "cp1253", "iso8859-7"):
            decoded = _letters(joined, "latin-1", target)
            if decoded:
                score = sum(_COMMON_LETTERS.get(c, 0) for c in decoded)
                if best is None or score > best[0]:
                    best = (score, target)
        if best and best[0] * 4 > sum(len(w.group()) for w in words):
            run = re.compile("[\u00a1-\u00ff]+" if best[1] in ("cp1253", "iso8859-7") else "[\u00c0-\u00ff\u00a8\u00b8]+")
            restored = run.sub(lambda m: _letters(m.group(), "latin-1", best[1]) or m.group(), text)
            return restored, [(m.start(), m.end()) for m in run.finditer(text)], f"{best[1]} as latin-1"
    turkish = list(_TURKISH_WORD.finditer(text))
    if len(turkish) > 1 and not _NOT_TURKISH.search(text):
        return text.translate(_TURKISH), [(m.start(), m.end()) for m in turkish], "cp1254 as cp1252"
    signs = list(_SIGN_IN_WORD.finditer(text))
    if signs:
        spans, parts, at = [], [], 0
        for word in _WORD.finditer(text):
            if any(word.start() <= s.start() < word.end() for s in signs) or re.search("[\u00b3\u00b9]", word.group()) and re.search("[a-z]", word.group()):
                parts += [text[at : word.start()], word.group().translate(_POLISH)]
                at = word.end()
                spans.append((word.start(), word.end()))
        return "".join([*parts, text[at:]]), spans, "cp1250 as cp1252"
    turned = list(_TURNED_CASE.finditer(text))
    if len(turned) > 1:
        restored = _letters(text, "cp1251", "koi8-r")
        return restored or text, [(m.start(), m.end()) for m in turned], "koi8-r as cp1251"
    found = [m.span() for p in (_MARK_IN_WORD, _MIXED_WORD) for m in p.finditer(text)]
    capitals = [m.span() for m in _CAPITAL_IN_WORD.finditer(text)]
    if len(capitals) > 1:
        found += capitals
    if not found:
        return None
    for true, read in _PAIRS:
        restored = _letters(text, read, true)
        if restored and not any(p.search(restored) for p in (_MARK_IN_WORD, _MIXED_WORD, _CAPITAL_IN_WORD, _CONTROL)):
            return restored, found, f"{true} as {read}"
    return text, found, "unknown"


def repair(text: str | None) -> dict | None:
    """Garbled spans of a text and the text restored; None if the text is not affected.

    Keys: ``restored`` (null if nothing could be restored), ``spans`` in the text as
    given (or with its HTML escapes resolved, then ``escaped`` is true), ``readings``
    (the code pages, in the order undone), ``lossy`` (a part stays unrestored).
    """
    if not text or (text.isascii() and "&" not in text):
        return None
    plain, escaped = text, False
    if "&" in text:
        unescaped = html.unescape(text)
        if unescaped != text and not unescaped.isascii():
            plain, escaped = unescaped, True
    current, spans, readings = plain, [], []
    foreign = False
    if _ODD.search(plain) and len(_ACCENTED_WORD.findall(plain)) > 2:  # perhaps a whole text in letters of another page
        beyond = sum(map(len, re.findall("[^\x00-\x7f]+", plain)))
        foreign = max((sum(e - s for s, e, *_ in runs) for runs in _runs(plain).values()), default=0) * 2 < beyond
    doubtful = False
    while not foreign:
        best: tuple[int, int, str, list] | None = None
        rivals: list[tuple[int, list[Run]]] = []
        for order, runs in _runs(current).items():
            page = CODE_PAGES[order]
            if _credible(current, page, runs):
                key = (sum(len(d) for _, _, d, _ in runs), -order)
                rivals.append((key[0], runs))
                if best is None or key > best[:2]:
                    best = (*key, page, runs)
        if best is None:
            break
        page, runs = best[2], best[3]
        doubtful = doubtful or any(size == best[0] and [r[:2] for r in other] == [r[:2] for r in runs] and any(x[2] != y[2] and x[2].isalpha() and y[2].isalpha() for x, y in zip(other, runs)) for size, other in rivals)
        if not readings:
            spans = [(s, e) for s, e, *_ in runs]
        readings.append(page)
        parts, at = [], 0
        for start, end, decoded, _ in runs:
            parts += [current[at:start], decoded]
            at = end
        current = "".join([*parts, current[at:]])
    lossy = doubtful or "\ufffd" in current
    if "\ufffd" in current:
        spans += [m.span() for m in re.finditer("\ufffd+", plain)]
    if not readings:
        single = _single_byte(plain)
        if single:
            restored, more, reading = single
            spans += more
            readings.append(reading)
            lossy = lossy or reading == "unknown"
            current = restored
    remains = [m.span() for m in _REMAINS.finditer(current)] + [m.span() for m in _CONTROL.finditer(current)]
    if remains:
        lossy = True
        if not readings:
            spans += remains
    if not spans:
        return None
    return {"restored": current if current != plain else None, "spans": spans, "readings": readings, "lossy": lossy, "escaped": escaped}


_SCHEMA = "doc_id long, restored string, readings array<string>, n_spans int, spans array<struct<start:int,end:int>>, lossy boolean, escaped boolean"


def _repair_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            found = repair(text)
            if found:
                spans = [{"start": s, "end": e} for s, e in found["spans"]]
                rows.append((doc_id, found["restored"], found["readings"], len(spans), spans, found["lossy"], found["escaped"]))
        yield pd.DataFrame(rows, columns=["doc_id", "restored", "readings", "n_spans", "spans", "lossy", "escaped"])


def repair_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per affected document.

    Texts of plain ASCII without an escape are dropped in the JVM, so only the rest is
    handed to Python.  No shuffle.  Extra columns of the input are ignored.
    """
    narrow = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    suspects = narrow.where("doc_id IS NOT NULL").where(F.col("text").rlike(r"[^\x00-\x7F]|&[#A-Za-z]"))
    return suspects.mapInPandas(_repair_batches, _SCHEMA)
