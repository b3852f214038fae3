"""Personal information inside free text (problem 2).

Method: information-theoretic sanitisation.  What a term discloses about a protected
entity is estimated from the corpus: the pointwise mutual information, in bits, between
the term and the contexts that introduce entities of a kind.

* Cues: which contexts introduce a person is learnt.  Words behind a title (Mr, Herr, Mme,
  don) are the first names and surnames known; a context of two or three tokens before or
  behind capitalised words is a cue if such words stand there much more often than
  elsewhere (``CUE_BITS``), and nearly as often as behind a title.  How many of all names
  are known is measured on one half of the records with the words of the other.
* Names: every word of the corpus is counted, and counted again where a title, salutation
  or cue introduces a person.  Words whose co-occurrence discloses more than
  ``DISCLOSURE_BITS``, in at least ``DISCLOSING_SHARE`` of their places, are name terms
  wherever and in whatever case they occur; those below that share, but at or above
  ``POSSIBLE_SHARE``, only where a person is introduced; company contexts count against them.
* Numbers: a number's shape (letters, digits and separators) is the term; its
  co-occurrence with words that introduce identity numbers, telephone numbers or mere codes
  (orders, files, stock) decides what the shape discloses, whatever its country.
* Forms: e-mail addresses, telephone numbers by their prefix, street addresses by their
  language and identity numbers beside a naming word are terms too: their patterns only
  propose values, the co-occurrence of the form with contexts that introduce such values
  decides whether it discloses in this corpus.

Terms over the threshold are grown to whole values (initials, particles, "Surname, Given",
prefix and extension, house number to town) and generalised to typed placeholders such as
``[EMAIL]``; the rest of the text stays as it is.

The count tables stay distributed; each record meets only the cues and terms it holds.

Defined results: null and blank texts have no occurrence; rows of one uid count once;
overlapping finds keep the one that begins first, then the longer; placeholders already in
the text are left alone; a corpus that never introduces a kind of value yields none of it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.session import cut

DISCLOSURE_BITS = 1.0
DISCLOSING_SHARE = 0.25  # least share of a term's occurrences in entity contexts, where entities are rare
POSSIBLE_SHARE = 0.05  # least share for a word that is a name only where a person is introduced
SEED_SHARE = 0.05  # least share of a word's places behind a title to be known as a name
CUE_BITS = 1.0  # least bits that a context discloses of a person to be a cue
CUE_SHARE = 0.65  # least share of names behind it, against that behind a title
CUE_NAMES = 8  # least number of different known words behind it
SENT_CUES = 20_000  # cues sent to the workers whole; results do not depend on it
PHONE_SEEN = 2  # least number of places behind a naming word for a shape outside the known forms

# ---------------------------------------------------------------- fixed values: words
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Mme Mlle Madame Monsieur don doña señor señora Sr Sra Sir Lady".split()
PARTICLES = frozenset("de van der den von zu zum del della di da la le du ten ter bin al".split())
COMPANY_WORDS = frozenset("plc ltd limited sa gmbh inc llc ag kg sarl sl spa bv nv llp corp co council bank coaches power city savings group holding partners airlines insurance university".split())
STREET_WORDS = "Street St Road Rd Lane Ln Close Court Ct Gardens Gdns Avenue Ave Row Place Pl Drive Dr Way Terrace Crescent Square Sq Hill Walk Mews Grove Park Green Parade".split()
STREET_ENDS_DE = "straße|strasse|str\\.|weg|gasse|allee|platz|ring|damm|ufer|steig|pfad|chaussee|promenade"
STREETS_FR = "rue|boulevard|bd|avenue|av\\.|impasse|place|allée|chemin|quai|cours|passage|route|square|sentier|villa"
STREETS_ES = "Calle|C/|Cl\\.|Avenida|Avda\\.|Av\\.|Paseo|Pº|Plaza|Pza\\.|Camino|Ronda|Travesía|Carretera|Glorieta|Callejón"
ID_WORDS = (
    "SSN|social security (?:number|no\\.?)|National Insurance (?:number|no\\.?)|NI (?:number|no\\.?)|passport(?: number| no\\.?)?|driving licen[cs]e(?: number| no\\.?)?|driver.s licen[cs]e(?: number)?|identity card(?: number| no\\.?)?|ID(?: card| number| no\\.?)?|tax (?:reference|number|ID|code)(?: number| no\\.?)?|TIN|id"
    "|Steuer-ID|Steuer-Id|Steuernummer|Steueridentifikationsnummer|Sozialversicherungsnummer|Personalausweis(?:nummer)?|Ausweisnummer|Reisepass(?:nummer)?|Pass(?:nummer)?|Führerschein(?:nummer)?|Rentenversicherungsnummer"
    "|passeport(?: n°| numéro)?|numéro de sécurité sociale|sécurité sociale(?: n°)?|numéro fiscal|carte (?:nationale )?d[’']identité(?: n°)?|permis de conduire(?: n°)?|CNI|NIR"
    "|pasaporte(?: n\\.?º)?|DNI|NIE|NIF|permiso de conducir|carné de conducir|número de (?:la )?seguridad social|documento de identidad"
)
CODE_WORDS = "case|file|order|application(?: no\\.?)?|stock code|stock|tracking(?: number)?|invoice|parcel|section|build|version|commande|requête|dossier|colis|Bestellung|Akte|Aktenzeichen|Beschwerde(?:nummer)?|Sendung|pedido|expediente|demanda|factura|facture|Rechnung|ticket|ref(?:erence)?\\.?"
MAIL_WORDS = "e-?mail|mail|courriel|correo|write to|wrote|writes|send|sent|reply|answer|contact|kontakt|schreiben|schreibt|antworten|écri(?:re|vez|vit)|répond(?:re|ez)|escrib(?:ir|an|a)|respond(?:er|an)|confirmation to|address"
ADDRESS_WORDS = "address|lives?|lived|living|resid(?:es|ed|ing|ent)|deliver(?:ed|y)?|sent to|ship(?:ped)? to|moved to|flat|house|wohnt|wohnhaft|Anschrift|Adresse|zugestellt|ging an|geht an|habite|demeur(?:e|ant)|domicili[éo]|adresse|parti au|livré|vive|reside|dirección|enviado|entregado|paquete a"
PHONE_WORDS = "tel|tél|teléfono|telephone|téléphone|Telefon|phone|number|ring|call|dial|reach|Rückruf|appel|llam|joindre|Rappelez|unter|Llamen al|llamar|mobile|fax|ext\\.?"

def _first(alternatives: str) -> str:
    """The letters with which the words of a pattern begin."""
    return "".join(sorted({word[0].lower() for word in re.sub(r"\([^()]*\)\??", "", re.sub(r"\([^()]*\)\??", "", alternatives)).split("|")}))


# ---------------------------------------------------------------- values by their form
_AT = r"(?:\s?@\s?|\s?[\[({]\s?(?:at|AT|arroba|ät)\s?[\])}]\s?|\s(?:AT)\s)"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|DOT|punto|punkt|point)\s?[\])}]\s?|\s(?:DOT)\s)"
EMAIL = re.compile(rf"(?<![\w.+\-@])[\w+\-]+(?:\.[\w+\-]+)*{_AT}[\w\-]+(?:{_DOT}[\w\-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w\-])")

NUMBER = re.compile(r"(?<![\w@#/.\-+(])(?:\(?\+\s?\d{1,3}\)?|\(\d{2,5}\)|\d)(?:[\s ./\-]{0,1}(?:\(0\)|\d))+(?:\s?(?:ext\.?|x|extension|Durchwahl|poste)\s?\d{1,5})?(?![\w@])")
_EXTENSION = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|DW|poste)\s?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w@#/.\-+(£$€])(?:"
    r"(?:\(?(?:\+|00)\s?[1-9]\d{0,2}\)?[\s.\-]?(?:\(0\)\s?)?(?:\(\d{1,4}\)[\s.\-]?)?\d(?:[\s.\-/]?\d){6,11})"
    r"|\(0\d{1,4}\)\s?\d(?:[\s.\-]?\d){5,9}"
    r"|\(\d{3}\)\s?\d{3}[\s.\-]\d{4}"
    r"|\d{3}([.\-])\d{3}\1\d{4}"
    r"|07\d{3}\s?\d{3}\s?\d{3}|020[\s.\-]?\d{4}[\s.\-]?\d{4}|01\d{3}\s\d{6}"
    r"|0[1-9](?:([\s.\-]?)\d{2})(?:\2\d{2}){3}"
    r"|0\d{2,4}[\s/]\d{2,8}(?:[\s\-]\d{2,5}){0,3}"
    r"|[69]\d{2}(?:([\s.\-]?)\d{3}\3\d{3}|[\s]\d{2}[\s]\d{2}[\s]\d{2})"
    r")" + _EXTENSION + r"(?![\w@/]|[\-.]\d)"
)
_TOKEN_ID = r"(?=[A-Za-z0-9 .\-/]*\d[A-Za-z0-9 .\-/]*\d)[A-Za-z0-9]{1,16}(?:[ .\-/]{1}(?=[A-Za-z]{0,3}\d|[A-HJ-Za-z]\b)[A-Za-z0-9]{1,12}){0,9}"
ID_AFTER = re.compile(rf"(?<![\w\-])(?i:(?=[{_first(ID_WORDS)}])(?:{ID_WORDS}))(?:\s+(?:is|was|lautet|est|es|número|n[°º.]+|no\.?|[Nn]r\.?|[Nn]um\.?))?(?:\s?[:=#]\s?|\s+)(?P<v>(?-i:{_TOKEN_ID}))")
ID_BEFORE = re.compile(rf"(?<![\w\-])(?P<v>(?:{_TOKEN_ID}))(?=\s+(?:as|als|comme|como)\s+(?:the|die|der|das|den|le|la|el|his|her|their)\s+(?i:{ID_WORDS})\b)")
_ID_BEHIND = re.compile(r"\s(?:as|als|comme|como)\s")  # what every value of ID_BEFORE has behind it
ID_SHAPED = re.compile(r"(?<![\w@#/.\-+])(?=[A-Za-z0-9 .\-/]{5,24})(?:(?:[A-Z]{1,5}[\- ]?|[a-z]{1,5}\-?)?\d[A-Za-z0-9]*(?:[ .\-/][A-Za-z0-9]*\d[A-Za-z0-9]*|[ .\-/][A-HJ-Z]\b){0,9})(?![\w@/]|[\-.]\d)")
_CODE_BEFORE = re.compile(rf"(?i:\b(?:{CODE_WORDS}))\W{{0,3}}(?:(?:no|number|nummer|num|n[°º])\.?\W{{0,2}})?$")
_ID_BEFORE_SHAPE = re.compile(rf"(?:\b(?i:{ID_WORDS}))\W{{0,3}}$")
_ID_AFTER_SHAPE = re.compile(rf"^\s+(?:as|als|comme|como)\s+\w+\s+(?i:{ID_WORDS})\b")


_BESIDE = {
    "email": re.compile(rf"(?i)\b(?=[{_first(MAIL_WORDS)}])(?:{MAIL_WORDS})\b"),
    "address": re.compile(rf"(?i)\b(?=[{_first(ADDRESS_WORDS)}])(?:{ADDRESS_WORDS})\b"),
    "phone": re.compile(rf"(?i)\b(?=[{_first(PHONE_WORDS)}])(?:{PHONE_WORDS})"),
    "id": re.compile(rf"\b(?i:(?=[{_first(ID_WORDS)}])(?:{ID_WORDS}))\b"),
}

_TOWN = r"(?:(?!(?i:Flat|Apt|Tel|Tél|Mail|The|In|On|At|And|Bestellung|Commande|Pedido|Order)\b)[A-ZÀ-ÞŁŚŻ][\wß-ÿ’'\-]+)"
_NAME_WORDS = r"(?!(?i:at|in|of|to|the|and|for|lists|by|a|on|with|from|room|row|copies)\b)[A-Za-zÀ-ÿŁłŚśŻż][\wÀ-ÿ’'\-]+"
_SEP = r"(?:,\s?|\s)"
_POSTCODE = r"(?:[A-Za-z]{1,2}\d[A-Za-z\d]?\s?\d[A-Za-z]{2})"
ADDRESS_EN = re.compile(
    rf"(?<![\w\-/.,])(?:(?:(?i:Flat|Apt|Apartment|Unit|Suite|Room)\.?\s\d+[A-Za-z]?,?\s)?\d{{1,4}}[A-Za-z]?(?:\s?[-–/]\s?\d{{1,4}}[A-Za-z]?)?,?\s{_NAME_WORDS}(?:\s{_NAME_WORDS})?\s(?i:St\.|(?:{'|'.join(STREET_WORDS)})\b))"
    rf"(?:{_SEP}(?P<town>{_TOWN})(?={_SEP}{_POSTCODE}\b))?(?:{_SEP}{_POSTCODE}\b|,\s(?P<town2>{_TOWN})|\n(?P<town3>{_TOWN})(?=\n|$))?"
)
ADDRESS_DE = re.compile(rf"(?<![\w\-])(?:[A-ZÄÖÜa-zäöü][\wäöüß\-]*(?i:{STREET_ENDS_DE})|(?:Am|An der|Auf dem|Im|Zum|Zur)\s[A-ZÄÖÜ][\wäöüß\-]+)\s\d{{1,4}}(?:\s?[a-zA-Z]\b)?(?:\s?[-–/]\s?\d{{1,4}}[a-z]?)?(?:(?:,\s?|\s(?:in\s)?|\n)(?:D[-\s])?\d{{5}}(?:\s(?:{_TOWN}))?|,\s(?:{_TOWN})|\n(?:{_TOWN})(?=\n|$))?")
ADDRESS_FR = re.compile(rf"(?<![\w\-])\d{{1,4}}(?:\s(?:bis|ter|quater)|[A-Z])?,?\s(?i:{STREETS_FR})\s(?:(?i:du|de la|de l[’']|des|de|d[’'])\s?)?{_NAME_WORDS}(?:[,\s]\s?(?:F[-\s])?\d{{5}}(?:\s{_TOWN})?|,\s{_TOWN}|\n{_TOWN}(?=\n|$))?")
ADDRESS_ES = re.compile(rf"(?<![\w\-])(?i:{STREETS_ES})\s?(?:(?i:del|de la|de los|de las|de)\s)?{_NAME_WORDS},?\s(?:(?i:n\.?º|núm\.?)\s?)?\d{{1,4}}[A-Za-z]?\b(?:,\s?\d{{1,2}}\.?\s?[ºªo°]\.?\s?(?:(?:dcha|izda|izq|ctro)\.|(?i:[A-Z])\b)?)?(?:(?:,\s?|\s)\d{{5}}(?:\s{_TOWN})?|,\s{_TOWN}|\n{_TOWN}(?=\n|$))?")
_ADDRESSES = (ADDRESS_EN, ADDRESS_DE, ADDRESS_FR, ADDRESS_ES)
# The same for texts in small letters, where a town is a word that ends at a mark or before a postcode.
_LOW_TOWN = rf"(?:(?!(?:flat|apt|tel|tél|mail|bestellung|commande|pedido|order)\b)[a-zß-ÿł][\wß-ÿ’'\-]{{2,}}(?=[,.;:)(\n]|\s\(|\s{_POSTCODE}|\s(?:signed|although)|$))"
_LOW_ADDRESSES = tuple(re.compile(p.pattern.replace(_TOWN, _LOW_TOWN)) for p in _ADDRESSES)
PLACEHOLDER = re.compile(r"\[[A-Z_]{2,20}\]|<[A-Z_]{2,20}>|\{\{[A-Z_]+\}\}")

# ---------------------------------------------------------------- names
_LETTERS = r"[^\W\d_]"
WORD = re.compile(rf"{_LETTERS}+(?:[-’']{_LETTERS}{{2,}})*")
_RUN = rf"(?:{_LETTERS}\.\s|{_LETTERS}{{2,}}(?:[-]{_LETTERS}+)*,?\s){{0,4}}?{_LETTERS}{{2,}}(?:[-]{_LETTERS}+)*"
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
BEFORE_NAME = re.compile(
    rf"(?i:\b(?=[abcdefghklmnprs])(?:\b(?:{_TITLE})\.?\s|\bname\s?[=:]\s?|\bcontact:\s|\b(?:kind |best )?regards,\s|\batentamente, |\bcordialement, |\bgrü(?:ß|ss)en?,? |\bgrü(?:ß|ss)en?,?\n|\bsigned,? |\bdear |\bchère? |\bestimad[oa] ))"
)
_AFTER_COMPANY = re.compile(r"^(?:\s?(?:&|and|und|et|y)\s[^\W\d_][\w\-’']+)?\s(?i:plc|ltd|limited|sa|gmbh|inc|llc|ag|kg|sarl|sl|bv|nv|llp|corp|city council|savings bank|coaches|power|council|bank|group)\b|^\s?&")
_BEFORE_COMPANY = re.compile(r"&\s?$")
_BEFORE_PLACE = re.compile(r"\b(?:[Ii]n|near|at|en|à|À|zu|nach|outside|to|from|around|bei|aus|cerca de|desde)\s$")


_LEADING_TITLE = re.compile(rf"(?i:(?=[dfhlmps])(?:{_TITLE}))\.?\s")
_TITLE_WORDS = frozenset(t.lower() for t in TITLES) | {"m"}


_JOINED = re.compile(r"[-’']")


def name_words(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """start, end, word in small letters and whether it is written with a capital, hyphenated parts apart."""
    for match in WORD.finditer(text):
        at, whole = match.start(), match.group()
        if whole.isalpha():  # no hyphen or apostrophe
            yield at, match.end(), whole.lower(), whole[0].isupper()
            continue
        for part in _JOINED.split(whole):
            yield at, at + len(part), part.lower(), part[:1].isupper()
            at += len(part) + 1


def is_small(text: str) -> bool:
    """Whether a text is written in small letters throughout."""
    return sum(map(str.isupper, text)) * 200 < len(text)


_NEAR = re.compile(r"\w+|[^\w\s]|\n")


class Contexts:
    """Tokens of a text, for the two and three before or behind a place."""

    def __init__(self, text: str):
        self.tokens = [t.lower() for t in _NEAR.findall(text)]
        found = [m.span() for m in _NEAR.finditer(text)]
        self.at_start = {a: n for n, (a, _) in enumerate(found)}
        self.at_end = {b: n for n, (_, b) in enumerate(found)}

    def cued(self, cues: frozenset[str]) -> tuple[set[int], set[int], set[int]]:
        """Places of tokens that stand behind a cue, behind one of three tokens, and before a cue."""
        behind, behind_three, before = set(), set(), set()
        tokens, last = self.tokens, len(self.tokens)
        for cue in cues:
            held = cue[1:].split(" ")
            size, first, at = len(held), held[0], -1
            if size not in (2, 3):
                continue
            while True:
                try:
                    at = tokens.index(first, at + 1)
                except ValueError:
                    break
                if tokens[at : at + size] != held:
                    continue
                if cue[0] == "<" and at + size < last:
                    behind.add(at + size)
                    if size == 3:
                        behind_three.add(at + size)
                elif cue[0] == ">" and at:
                    before.add(at - 1)
        return behind, behind_three, before

    def before(self, start: int) -> list[str]:
        n = self.at_start.get(start)
        return [] if n is None else ["<" + " ".join(self.tokens[n - size : n]) for size in (2, 3) if n >= size]

    def behind(self, end: int) -> list[str]:
        n = self.at_end.get(end)
        return [] if n is None else [">" + " ".join(self.tokens[n + 1 : n + 1 + size]) for size in (2, 3) if n + size < len(self.tokens)]


def capital_runs(text: str, words: list[tuple[int, int, str, bool]]) -> list[tuple[int, int]]:
    """First and last place in ``words`` of stretches of capitalised words (initials and particles inside them)."""
    out, at = [], 0
    while at < len(words):
        if not words[at][3] or words[at][2] in _TITLE_WORDS:
            at += 1
            continue
        last = at
        while last + 1 < len(words):
            gap, (_, _, word, capital) = text[words[last][1] : words[last + 1][0]], words[last + 1]
            if gap not in (" ", "-", ". ") or gap == ". " and words[last][1] - words[last][0] > 1 or not (capital or word in PARTICLES) or word in _TITLE_WORDS:
                break
            last += 1
        while words[last][2] in PARTICLES and last > at:
            last -= 1
        out.append((at, last))
        at = last + 1
    return out


def context_counts(text: str, half: int) -> Counter:
    """(key, word) counts of one text: the contexts of its capitalised words; the key of a title is its half of the corpus."""
    out: Counter = Counter()
    words, near = list(name_words(text)), Contexts(text)
    titled = {m.end() for m in _LEADING_TITLE.finditer(text)}
    for first, last in capital_runs(text, words):
        names = [w for *_, w, _ in words[first : last + 1] if len(w) > 1 and w not in PARTICLES]
        start, end = words[first][0], words[last][1]
        keys = near.before(start) + near.behind(end) + [f"title {half}"] * (start in titled) + ["anywhere"]
        out.update((key, name) for key in keys for name in names)
        if last > first and opens_sentence(text, start):  # its first word may be none of the name
            later = [w for *_, w, _ in words[first + 1 : last + 1] if len(w) > 1 and w not in PARTICLES]
            out.update((key, name) for key in near.before(words[first + 1][0]) for name in later)
    return out


def opens_sentence(text: str, start: int) -> bool:
    """Whether a sentence or line begins at a place."""
    return re.search(r"(?:^|[.!?…\n])[ \t]*$", text[max(0, start - 4) : start]) is not None


class Cues:
    """Cues, with the tokens at their outer ends, which tell most contexts apart before they are built."""

    def __init__(self, cues):
        self.all = frozenset(cues)
        sizes = {"<": {2: set(), 3: set()}, ">": {2: set(), 3: set()}}
        for cue in self.all:
            held = cue[1:].split(" ")
            if len(held) in (2, 3):
                sizes[cue[0]][len(held)].add(held[-1 if cue[0] == "<" else 0])
        self.before, self.behind = sizes["<"], sizes[">"]

    def held(self, text: str) -> set[str]:
        """Those of ``held_contexts`` that are cues."""
        near = Contexts(text)
        tokens, all_cues = near.tokens, self.all
        before = [(n, size, key) for size, ends in self.before.items() for n in range(size, len(tokens)) if tokens[n - 1] in ends and (key := "<" + " ".join(tokens[n - size : n])) in all_cues]
        behind = [(n, key) for size, ends in self.behind.items() for n in range(len(tokens) - size) if tokens[n + 1] in ends and (key := ">" + " ".join(tokens[n + 1 : n + 1 + size])) in all_cues]
        if not before and not behind:
            return set()
        words = list(name_words(text))
        if is_small(text):
            longer, places, last = set(), {near.at_start.get(start) for start, *_ in words}, {near.at_end.get(end) for _, end, *_ in words}
        else:
            runs = capital_runs(text, words)
            longer = {near.at_start.get(start) for start, _, _, capital in words if not capital}
            places = {near.at_start.get(words[at][0]) for first, final in runs for at in (first, first + 1 if final > first else first)}
            last = {near.at_end.get(words[final][1]) for _, final in runs}
        return {key for n, size, key in before if n in places or size == 3 and n in longer} | {key for n, key in behind if n in last}


def held_contexts(text: str) -> set[str]:
    """Contexts in which a name of the text may stand."""
    words, near, small = list(name_words(text)), Contexts(text), is_small(text)
    if small:
        return {key for start, end, *_ in words for key in (*near.before(start), *near.behind(end))}
    runs = capital_runs(text, words)
    longer = {key for start, _, _, capital in words if not capital for key in near.before(start)[1:]}
    places = {words[first][0] for first, _ in runs} | {words[first + 1][0] for first, last in runs if last > first}
    return longer | {key for start in places for key in near.before(start)} | {key for _, last in runs for key in near.behind(words[last][1])}


def introduced(text: str, words: list[tuple[int, int, str, bool]], inside, cues: frozenset[str] = frozenset(), near: Contexts | None = None) -> tuple[set[int], set[int]]:
    """Places in ``words`` that stand in a context which introduces a person, and those of the words that introduce one."""
    person: set[int] = set()
    starts = {start: index for index, (start, *_) in enumerate(words)}

    small = is_small(text)
    begins: set[int] = set()  # places behind a title, salutation or cue

    def mark(index: int, step: int) -> None:
        taken, at = 0, index
        lower = not words[index][3] and words[index][2] not in PARTICLES
        plain = 0  # words in small letters taken, parts after a hyphen and particles apart
        while 0 <= at < len(words) and taken < 5:
            start, end, word, capital = words[at]
            if taken and at + 1 in begins and word not in PARTICLES or word in _TITLE_WORDS and len(word) > 1 or not (capital or word in PARTICLES or lower and plain < (3 if small else 2) or lower and text[start - 1 : start] == "-") or inside(start):
                break
            if taken:
                gap = text[words[at - step][1] : start] if step > 0 else text[end : words[at - step][0]]
                first = word if step < 0 else words[at - step][2]
                if gap not in (" ", "-", ". ", ", ", "  ") or gap == ", " and taken > 2 or gap == ". " and len(first) > 1:
                    break
            if word not in PARTICLES and len(word) > 1:
                person.add(at)
                plain += not capital and text[start - 1 : start] != "-"
            if step < 0 and at in begins:
                break  # what stands before it introduces it
            taken += 1
            at += step

    for match in BEFORE_NAME.finditer(text):
        at = match.end()
        title = _LEADING_TITLE.match(text, at)
        at = title.end() if title else at
        # "la señora" is a common noun where no name follows
        if at in starts and (words[starts[at]][3] or small or not re.search("(?i)señora?\\s$", text[max(0, at - 8) : at])):
            begins.add(starts[at])
    if not cues:
        for index in sorted(begins):
            mark(index, 1)
    else:
        near = Contexts(text) if near is None else near
        behind, behind_three, before = near.cued(cues)
        at_start, at_end = near.at_start, near.at_end
        if behind:  # a word in small letters needs the longer context
            begins.update(index for index, (start, _, _, capital) in enumerate(words) if at_start.get(start) in (behind if capital or small else behind_three))
        for index in sorted(begins):
            mark(index, 1)
        if before:
            for index, (_, end, word, capital) in enumerate(words):
                if at_end.get(end) in before and (capital or small or word in PARTICLES):
                    mark(index, -1)
    leading = {at - 1 for at in begins if at and words[at - 1][2] not in PARTICLES and len(words[at - 1][2]) > 1 and text[words[at - 1][1] : words[at][0]] in (" ", ", ", ": ", "\n")}
    return person - leading, leading


def _nowhere(at: int) -> bool:
    return False


def phone_form(value: str) -> str:
    """What a telephone number begins with."""
    bare = value.lstrip("( ")
    return "phone:" + ("+" if bare.startswith("+") else "00" if bare.startswith("00") else "0" if bare.startswith("0") else "9")


def forms(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Proposed values: kind, start, end and form."""
    for m in EMAIL.finditer(text):
        yield "email", *m.span(), "email"
    for language, pattern in zip(("en", "de", "fr", "es"), _LOW_ADDRESSES if is_small(text) else _ADDRESSES):
        for m in pattern.finditer(text):
            yield "address", m.start(), m.start() + len(m.group().rstrip(" ,\n")), f"address:{language}"
    for m in PHONE.finditer(text):
        value = m.group().rstrip(" .-/")
        yield "phone", m.start(), m.start() + len(value), phone_form(value)
    for m in NUMBER.finditer(text):
        value = m.group().rstrip(" .-/")
        yield "number", m.start(), m.start() + len(value), shape(value)


def term_counts(text: str, cues: frozenset[str] = frozenset(), proposed: list[tuple[str, int, int, str]] | None = None) -> Counter:
    """(kind, term, context) counts of one text, for the corpus tables; ``proposed`` are its ``forms``, if they are known."""
    out: Counter = Counter()
    proposed = list(forms(text)) if proposed is None else proposed
    for kind, start, _, form in proposed:
        beside = _BESIDE["phone" if kind == "number" else kind].search(text[max(0, start - 60) : start]) is not None
        coded = kind in ("phone", "number") and _CODE_BEFORE.search(text[max(0, start - 40) : start])
        out["number" if kind == "number" else "form", form, "code" if coded else "entity" if beside else "none"] += 1
    for kind, pattern in _BESIDE.items():  # how often such a context stands anywhere
        out["base", kind, "entity"] += sum(1 for _ in pattern.finditer(text))
    out["base", "words", "none"] += text.count(" ") + 1
    protected = [(a, b) for kind, a, b, _ in proposed if kind == "email"]
    inside = (lambda at: any(a <= at < b for a, b in protected)) if protected else _nowhere
    words = list(name_words(text))
    person, _ = introduced(text, words, inside, cues)
    for index, (start, end, word, capital) in enumerate(words):
        if len(word) < 2 or word in PARTICLES or inside(start):
            continue
        company = _AFTER_COMPANY.match(text[end : end + 40]) or _BEFORE_COMPANY.search(text[max(0, start - 3) : start])
        out["name", word, "company" if company else "person" if index in person else "none"] += 1
    for match in ID_SHAPED.finditer(text):
        value = match.group()
        if sum(c.isdigit() for c in value) < 4 or inside(match.start()):
            continue
        before, after = text[max(0, match.start() - 40) : match.start()], text[match.end() : match.end() + 60]
        context = "id" if _ID_BEFORE_SHAPE.search(before) or _ID_AFTER_SHAPE.match(after) else "code" if _CODE_BEFORE.search(before) else "none"
        out["shape", shape(value), context] += 1
    return out


def shape(value: str) -> str:
    """Digits as 9, letters as A, the rest as it is."""
    return "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in value)


# ---------------------------------------------------------------- spans
def _names(text: str, known: frozenset[str], possible: frozenset[str], taken: list[tuple[int, int, str]], cues: frozenset[str] = frozenset()) -> list[tuple[int, int, str]]:
    if not known and not possible:
        return []
    blocked = [(a, b) for a, b, _ in taken]
    inside = (lambda at: any(a <= at < b for a, b in blocked)) if blocked else _nowhere
    words = list(name_words(text))
    small, near = is_small(text), Contexts(text)
    person, leading = introduced(text, words, inside, cues, near)
    introduced_at, leads = {words[at][0] for at in person}, {words[at][0] for at in leading}
    here = {start for start, _, _, capital in words if start in introduced_at and (capital or small)} if possible else set()
    tokens = []  # start, end, kind: N name, I initial, P particle
    for match in re.finditer(rf"{_LETTERS}+(?:-{_LETTERS}+)*\.?", text):
        value = match.group()
        bare = value.rstrip(".")
        start, end = match.start(), match.start() + len(bare)
        parts = bare.lower().split("-")
        if inside(start) or start in leads:
            continue
        if all(p in known or p in possible and start in here for p in parts) and len(bare) > 1 and bare.lower() not in _TITLE_WORDS:
            tokens.append((start, end, "N", bare))
        elif len(bare) == 1 and value.endswith("."):
            tokens.append((start, end + 1, "I", bare))
        elif bare.lower() in PARTICLES:
            tokens.append((start, end, "P", bare))
        elif bare.lower() in ("s",) and text[start - 1 : start] in "’'":
            continue
    out, at = [], 0
    while at < len(tokens):
        run = [tokens[at]]
        while at + len(run) < len(tokens):
            last, new = run[-1], tokens[at + len(run)]
            gap = text[last[1] : new[0]]
            if gap in (" ", "  "):
                run.append(new)
            elif gap in (", ", ",  ") and sum(t[2] == "N" for t in run) == 1 and new[2] == "N" and last[2] == "N":
                run.append(new)
            else:
                break
        at += len(run)
        while run and run[-1][2] != "N":
            run.pop()
        while run and run[0][2] == "I" and len(run) > 1 and run[0][3] == "M" and re.search(r"(?:requérant,|\b(?:et|que|à|par|de|Contactez|Monsieur))\s$", text[max(0, run[0][0] - 12) : run[0][0]]):
            run.pop(0)
        if not any(t[2] == "N" for t in run):
            continue
        if run[0][2] == "P" and (run[0][3][:1].isupper() is False) and not any(t[2] == "N" for t in run[1:2]) and run[0][3].lower() in ("la", "le", "al", "du", "zum", "zu", "da"):
            run.pop(0)
        start, end = run[0][0], run[-1][1]
        names = [t for t in run if t[2] == "N"]
        before, after = text[max(0, start - 60) : start], text[end : end + 45]
        if _AFTER_COMPANY.match(after) or _BEFORE_COMPANY.search(before) or before.endswith("@"):
            continue
        if run[0][2] == "P" and run[0][3].lower() in ("de", "del", "la", "le", "du", "da", "di", "al", "der", "den") and not run[0][3][:1].isupper():
            lead = 0
            cued = start in introduced_at or any(m.end() == len(before) for m in BEFORE_NAME.finditer(before)) or any(key in cues for key in near.before(start))
            if not cued and run[0][3].lower() in ("la", "le", "du", "al", "der", "den"):
                lead = 1
            run = run[lead:]
            start = run[0][0]
        low = [t for t in names if not t[3][:1].isupper()]
        if low and len(names) < 2:
            cue = None
            for cue in BEFORE_NAME.finditer(before):
                pass
            if not (cue and cue.end() == len(before)) and not any(key in cues for key in (*near.before(start), *near.behind(end))):
                continue
        out.append((start, end, "PERSON"))
    return out


_DIGIT = re.compile(r"\d")


def _shaped(text: str, disclosing: frozenset[str], named: bool = True) -> list[tuple[int, int, str]]:
    """Identity numbers: beside a naming word (if the corpus holds such at all), or of a shape that discloses."""
    out = []
    if not _DIGIT.search(text):
        return out
    if not named:
        return [(m.start(), m.end(), "ID_NUMBER") for m in ID_SHAPED.finditer(text) if shape(m.group()) in disclosing and not _CODE_BEFORE.search(text[max(0, m.start() - 40) : m.start()])]
    for match in ID_AFTER.finditer(text):
        start, end = _trim(text, *match.span("v"))
        if sum(c.isdigit() for c in text[start:end]) >= 4:
            out.append((start, end, "ID_NUMBER"))
    for match in ID_BEFORE.finditer(text) if _ID_BEHIND.search(text) else ():
        start, end = _trim(text, *match.span("v"))
        if sum(c.isdigit() for c in text[start:end]) >= 4:
            out.append((start, end, "ID_NUMBER"))
    for match in ID_SHAPED.finditer(text):
        if shape(match.group()) in disclosing and not _CODE_BEFORE.search(text[max(0, match.start() - 40) : match.start()]):
            out.append((match.start(), match.end(), "ID_NUMBER"))
    return out


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    """Without words at the ends that are no part of a number: the value begins with a group that holds a digit or stands before one in capitals, and ends with its last digits."""
    value = text[start:end]
    last = max((m.end() for m in re.finditer(r"\d[ \-.][A-Z]\b|\d[A-Za-z]*", value)), default=len(value))
    if value[last - 2 : last - 1] == " " and value[last - 1 : last].isalpha() and not re.match(r"\s*[A-Za-z]{2}(?: ?\d\d){3}", value):
        last -= 2  # a pronoun or article after the number
    value = value[:last].rstrip(" .-/")
    lead = re.match(r"\s*(?:[a-z]+\s+)*(?:[A-Z]?[a-z]{2,}\s+)*", value).end()
    return start + lead, start + len(value)


def find(
    text: str | None, names: frozenset[str], shapes: frozenset[str], possible: frozenset[str] = frozenset(), disclosing: frozenset[str] = frozenset(), numbers: frozenset[str] = frozenset(), cues: frozenset[str] = frozenset(), proposed: list[tuple[str, int, int, str]] | None = None
) -> list[tuple[int, int, str]]:
    """Spans and labels of one text, given the terms that disclose.

    ``names`` are name terms wherever they stand, ``possible`` only where a person is
    introduced (by ``cues`` among others); ``shapes`` are shapes of identity numbers,
    ``numbers`` of telephone numbers, ``disclosing`` the forms.
    """
    if not text or text.isspace():
        return []
    found: list[tuple[int, int, str, int]] = []
    for match in PLACEHOLDER.finditer(text):
        found.append((*match.span(), "", -1))
    found += [(s, e, label, 1) for s, e, label in _shaped(text, shapes, "id" in disclosing)]
    for kind, start, end, form in forms(text) if proposed is None else proposed:
        if kind == "email" and form in disclosing:
            found.append((start, end, "EMAIL", 0))
        elif kind == "address" and form in disclosing:
            found.append((start, end, "ADDRESS", 2))
        elif kind == "phone" and form in disclosing or kind == "number" and form in numbers:
            digits = sum(c.isdigit() for c in text[start:end])
            if 8 <= digits <= 17 and not _CODE_BEFORE.search(text[max(0, start - 40) : start]):
                found.append((start, end, "PHONE", 3 if kind == "phone" else 4))
    kept: list[tuple[int, int, str]] = []
    for start, end, label, order in sorted(found, key=lambda f: (f[3], f[0], f[0] - f[1])):
        if all(end <= a or start >= b for a, b, _ in kept):
            kept.append((start, end, label))
    kept += _names(text, names, possible, kept, cues)
    return sorted(k for k in kept if k[2])


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with typed placeholders."""
    out, at = [], 0
    for start, end, label in spans:
        out += [text[at:start], f"[{label}]"]
        at = end
    return "".join([*out, text[at:]])


# ---------------------------------------------------------------- Spark
def _summed(count):
    """Counts of the texts of a batch, given out whenever they grow large."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for batch in batches:
            for row in batch.itertuples(index=False):
                total.update(count(row))
            if len(total) > 200_000:
                yield pd.DataFrame([(*k, n) for k, n in total.items()])
                total = Counter()
        yield pd.DataFrame([(*k, n) for k, n in total.items()])

    return scan


def _frozen(values) -> frozenset[str]:
    return frozenset(() if values is None else values)


def learn_cues(texts: DataFrame) -> DataFrame:
    """term, bits: the contexts (two or three tokens, < before and > behind) that introduce persons."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _summed(lambda row: context_counts(row.text, zlib.crc32(row.uid.encode()) & 1))(batches):
            frame.columns = ["key", "word", "n"] if len(frame.columns) else []
            yield frame if len(frame) else pd.DataFrame({"key": pd.Series(dtype=str), "word": pd.Series(dtype=str), "n": pd.Series(dtype="int64")})

    counted = cut(texts.select("uid", "text").mapInPandas(scan, "key string, word string, n long").groupBy("key", "word").agg(F.sum("n").alias("n")))
    titled = counted.where(F.col("key").startswith("title "))
    # a street may end in what looks like a title, so a word must stand behind one often enough
    everywhere = counted.where("key = 'anywhere'").select("word", F.col("n").alias("all"))
    seeds = cut(titled.groupBy("word").agg(F.sum("n").alias("titled")).join(everywhere, "word").where(F.col("titled") >= SEED_SHARE * F.col("all")).select("word", F.lit(1).alias("seed")))
    # of the names behind titles in one half, how many are known from the other
    titled = titled.join(seeds.select("word"), "word", "left_semi")
    other = titled.where("key = 'title 0'").select("word").withColumn("met", F.lit(1))
    known = titled.where("key = 'title 1'").join(other, "word", "left").agg((F.sum(F.col("n") * F.coalesce("met", F.lit(0))) / F.sum("n")).alias("known"))
    marked = counted.join(seeds, "word", "left").withColumn("named", F.col("n") * F.coalesce("seed", F.lit(0)))
    by_key = marked.groupBy("key").agg(F.sum("n").alias("n"), F.sum("named").alias("named"), F.count("seed").alias("names"))
    by_key = cut(by_key.where("named > 0"))
    anywhere = by_key.where("key = 'anywhere'").select((F.col("named") / F.col("n")).alias("base"))
    share = F.col("named") / F.col("n")
    bits = F.log2(share / F.col("base"))
    told = by_key.where(F.col("key").rlike("^[<>]")).where(F.col("names") >= CUE_NAMES).crossJoin(F.broadcast(anywhere.crossJoin(known)))  # one row of two numbers
    kept = told.withColumn("bits", bits).where((F.col("bits") >= CUE_BITS) & (share >= CUE_SHARE * F.coalesce("known", F.lit(1.0)))).select(F.col("key").alias("term"), "bits")
    # a given name introduces a surname, but is none of the words around a name
    own = kept.select("term", F.explode(F.split(F.substring("term", 2, 1000), " ")).alias("word")).join(seeds.select("word"), "word", "left_semi").select("term").distinct()
    return kept.join(own, "term", "left_anti")


_PROPOSED = "array<struct<kind:string,start:int,end:int,form:string>>"


def _packed(text: str) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "form": f} for k, s, e, f in forms(text)]


def _unpacked(proposed) -> list[tuple[str, int, int, str]]:
    return [(p["kind"], p["start"], p["end"], p["form"]) for p in (() if proposed is None else proposed)]


def with_cues(texts: DataFrame, cues: DataFrame) -> DataFrame:
    """uid, text, the cues that each text holds and its proposed values, which every later pass uses.

    Up to ``SENT_CUES`` cues are sent to the workers; more are joined to the texts' contexts.
    """
    few = [row["term"] for row in cues.select("term").limit(SENT_CUES + 1).collect()]
    if len(few) <= SENT_CUES:
        sent = texts.sparkSession.sparkContext.broadcast(few)

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = Cues(sent.value)
            for batch in batches:
                batch["cues"] = [sorted(known.held(text)) for text in batch["text"]]
                batch["proposed"] = [_packed(text) for text in batch["text"]]
                yield batch

        return texts.select("uid", "text").mapInPandas(look, f"uid string, text string, cues array<string>, proposed {_PROPOSED}")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(uid, key) for uid, text in zip(batch["uid"], batch["text"]) for key in held_contexts(text)]
            yield pd.DataFrame(rows, columns=["uid", "term"])

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["proposed"] = [_packed(text) for text in batch["text"]]
            yield batch

    held = texts.select("uid", "text").mapInPandas(scan, "uid string, term string").join(cues.select("term"), "term").groupBy("uid").agg(F.collect_set("term").alias("cues"))
    return texts.select("uid", "text").join(held, "uid", "left").mapInPandas(propose, f"uid string, text string, cues array<string>, proposed {_PROPOSED}")


def disclosure(texts: DataFrame) -> DataFrame:
    """role, kind, term, bits: terms that disclose more than the threshold, and words that may be names.

    ``texts`` has text, cues and proposed.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _summed(lambda row: term_counts(row.text, _frozen(row.cues), _unpacked(row.proposed)))(batches):
            if len(frame):
                frame.columns = ["kind", "term", "context", "n"]
                yield frame

    counted = texts.select("text", "cues", "proposed").mapInPandas(scan, "kind string, term string, context string, n long")
    entity = F.sum(F.when(F.col("context").isin("person", "id", "entity"), F.col("n")).otherwise(0)).alias("entity")
    by_term = cut(counted.groupBy("kind", "term").agg(entity, F.sum("n").alias("n")))
    terms = by_term.where("kind IN ('name', 'shape')")
    whole = terms.groupBy("kind").agg(F.sum("entity").alias("all_entity"), F.sum("n").alias("all_n"))  # two rows
    share = F.col("entity") / F.col("n")
    bits = F.log2(share / (F.col("all_entity") / F.col("all_n")))
    scored = terms.where("entity > 0").join(F.broadcast(whole), "kind").withColumn("bits", bits)
    strong = (F.col("bits") >= DISCLOSURE_BITS) & (share >= DISCLOSING_SHARE)
    found = scored.where(share >= POSSIBLE_SHARE).select(F.when(strong, F.col("kind")).otherwise("possible").alias("role"), "kind", "term", "bits").where("role <> 'possible' OR kind = 'name'")
    # forms and shapes of telephone numbers, against how often their contexts stand anywhere
    base = by_term.where("kind = 'base'")
    rates = base.where("term <> 'words'").select(F.col("term").alias("of"), "entity").crossJoin(F.broadcast(base.where("term = 'words'").select(F.col("n").alias("words"))))  # four rows
    proposed = by_term.where("kind IN ('form', 'number') AND entity > 0").withColumn("of", F.when(F.col("kind") == "number", "phone").otherwise(F.split("term", ":")[0]))
    against = proposed.join(F.broadcast(rates.withColumnRenamed("entity", "contexts")), "of").withColumn("bits", F.log2(share / (F.col("contexts") / F.col("words"))))
    enough = (F.col("kind") == "form") | (F.col("entity") >= PHONE_SEEN) & (share >= 0.5)
    disclosing = against.where((F.col("bits") >= DISCLOSURE_BITS) & enough).select(F.col("kind").alias("role"), "kind", "term", "bits")
    named = rates.where("of = 'id' AND entity > 0").select(F.lit("form").alias("role"), F.lit("form").alias("kind"), F.lit("id").alias("term"), F.log2(F.col("words") / F.col("entity")).alias("bits")).where(F.col("bits") >= DISCLOSURE_BITS)
    return found.unionByName(disclosing).unionByName(named)


def _terms_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for uid, text, proposed in zip(batch["uid"], batch["text"], batch["proposed"]):
            rows += [(uid, "name", w) for w in {word for _, _, word, _ in name_words(text) if len(word) > 1}]
            rows += [(uid, "shape", s) for s in {shape(m.group()) for m in ID_SHAPED.finditer(text) if sum(c.isdigit() for c in m.group()) >= 4}]
            rows += {(uid, "number" if kind == "number" else "form", form) for kind, _, _, form in _unpacked(proposed)}
            rows.append((uid, "form", "id"))
        yield pd.DataFrame(rows, columns=["uid", "kind", "term"])


_SPANS = "uid string, text string, spans array<struct<start:int,end:int,label:string>>"
ROLES = (("name", "names"), ("shape", "shapes"), ("possible", "possible"), ("form", "disclosing"), ("number", "numbers"))


def _find_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [name for _, name in ROLES] + ["cues"]
    for batch in batches:
        spans = []
        for text, proposed, *terms in zip(batch["text"], batch["proposed"], *(batch[c] for c in columns)):
            spans.append([{"start": s, "end": e, "label": label} for s, e, label in find(text, *map(_frozen, terms), _unpacked(proposed))])
        yield pd.DataFrame({"uid": batch["uid"], "text": batch["text"], "spans": spans})


def once(records: DataFrame) -> DataFrame:
    """uid and text of each record once: the delivery loaded last."""
    return records.where("uid IS NOT NULL AND text IS NOT NULL").groupBy("uid").agg(F.max(F.struct("loaded_at", "text")).alias("r")).select("uid", F.col("r.text").alias("text"))


def sanitise(records: DataFrame) -> DataFrame:
    """uid, text, spans of every record with a text."""
    plain = cut(once(records))
    texts = cut(with_cues(plain, cut(learn_cues(plain))))
    terms = cut(disclosure(texts))
    held = texts.mapInPandas(_terms_of, "uid string, kind string, term string").join(terms, ["kind", "term"]).groupBy("uid").agg(*[F.collect_list(F.when(F.col("role") == role, F.col("term"))).alias(name) for role, name in ROLES])
    return texts.join(held, "uid", "left").select("uid", "text", *[name for _, name in ROLES], "cues", "proposed").mapInPandas(_find_batches, _SPANS)


def occurrences(records: DataFrame) -> DataFrame:
    """uid, start, end, label: one row for each occurrence."""
    return sanitise(records).select("uid", F.explode("spans").alias("s")).select("uid", "s.start", "s.end", "s.label")


def redacted(records: DataFrame) -> DataFrame:
    """uid, text with typed placeholders, n_spans."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [redact(t, [(s["start"], s["end"], s["label"]) for s in spans]) for t, spans in zip(batch["text"], batch["spans"])]
            yield pd.DataFrame({"uid": batch["uid"], "text": texts, "n_spans": [len(s) for s in batch["spans"]]})

    return sanitise(records).mapInPandas(apply, "uid string, text string, n_spans int")
