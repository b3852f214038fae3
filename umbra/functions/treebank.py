"""Penn Treebank tokens with offsets, and text put together from them.

The rules are those of the published Penn Treebank tokeniser script: each spaces out a kind
of sign, and what is left between blanks is a token.  They are meant for one sentence at a
time; ``record_state`` applies them to every sentence of a text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from umbra.functions import text as T

# The published rules, in order, as pattern and replacement (\0 is the whole match).
RULES = (
    (r'^"', r"``"),
    (r"(``)", r" \1 "),
    (r'''([ (\[{<])("|'')''', r"\1 `` "),
    (r"([:,])([^0-9])", r" \1 \2"),
    (r"([:,])(\n?)$", r" \1 \2"),
    (r"\.\.\.", r" ... "),
    (r"[;@#$%&]", r" \0 "),
    (r"""([^.])(\.)([\])}>"']*)[ \t\n\r\f]*$""", r"\1 \2\3 "),
    (r"[?!]", r" \0 "),
    (r"([^'])' ", r"\1 ' "),
    (r"[\]\[(){}<>]", r" \0 "),
    (r"--", r" -- "),
    (r"^", " "),
    (r"$", " "),
    (r"''", r" '' "),
    (r'"', r" '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    (r"(?i)\b(can)(not)\b", r" \1 \2 "),
    (r"(?i)\b(d)('ye)\b", r" \1 \2 "),
    (r"(?i)\b(gim)(me)\b", r" \1 \2 "),
    (r"(?i)\b(gon)(na)\b", r" \1 \2 "),
    (r"(?i)\b(got)(ta)\b", r" \1 \2 "),
    (r"(?i)\b(lem)(me)\b", r" \1 \2 "),
    (r"(?i)\b(more)('n)\b", r" \1 \2 "),
    (r"(?i)\b(wan)(na)[ \t\n\r\f]", r" \1 \2 "),
    (r"(?i) ('t)(is)\b", r" \1 \2 "),
    (r"(?i) ('t)(was)\b", r" \1 \2 "),
)
_COMPILED = tuple((re.compile(p, re.ASCII), r.replace("\\0", "\\g<0>")) for p, r in RULES)
BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile("[" + BLANKS + "]+")


def split_sentence(sentence: str) -> list[str]:
    """Tokens of a sentence; double quotes come out as `` and ''."""
    for pattern, put in _COMPILED:
        sentence = pattern.sub(put, sentence)
    return [t for t in _CUT.split(sentence) if t]


def locate(sentence: str, tokens: list[str]) -> list[tuple[int, int]]:
    """Start and end of each token in the sentence; a quote token may stand for a double quote."""
    out, at = [], 0
    for token in tokens:
        found = [(place, len(form)) for form in ((token, '"') if token in ("``", "''") else (token,)) if (place := sentence.find(form, at)) >= 0]
        if not found:
            raise ValueError(f"token {token!r} is not in the sentence")
        place, size = min(found)
        out.append((place, place + size))
        at = place + size
    return out


_TERM = ST.StructType([ST.StructField(n, t) for n, t in (("sentence", ST.IntegerType()), ("start", ST.IntegerType()), ("end", ST.IntegerType()), ("text", ST.StringType()))])


@F.arrow_udf(ST.ArrayType(_TERM))
def _terms(sentences: pa.Array) -> pa.Array:
    """Reads one text's sentences at a time and keeps numbers and one string of all tokens: a batch of lists of rows takes a hundred times its text."""
    counts, numbers, starts, ends, said, stops = array("i", [0]), array("i"), array("i"), array("i"), [], array("q", [0])
    held = bytearray()
    for parts in sentences:
        if parts.is_valid:
            for number, part in enumerate(parts.as_py()):
                sentence, base = part["text"], part["start"]
                for a, b in locate(sentence, split_sentence(sentence)):
                    numbers.append(number)
                    starts.append(base + a)
                    ends.append(base + b)
                    said.append(sentence[a:b])
            for token in said:
                held += token.encode()
                stops.append(len(held))
            said.clear()
        counts.append(len(numbers))
    text = pa.LargeStringArray.from_buffers(len(numbers), pa.py_buffer(stops), pa.py_buffer(held)).cast(pa.string())
    found = pa.StructArray.from_arrays([pa.array(np.asarray(numbers, np.int32)), pa.array(np.asarray(starts, np.int32)), pa.array(np.asarray(ends, np.int32)), text], ["sentence", "start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(np.asarray(counts, np.int32)), found, mask=sentences.is_null())


def terms(text: Column) -> Column:
    """array<struct<sentence,start,end,text>>: Treebank tokens of every sentence, with offsets in the text; null for null."""
    return _terms(T.sentences(text))


def record_state(text: Column) -> Column:
    """struct<sentences, terms>: a text's sentences and the tokens of each, computed once for the operators that need both."""
    return F.struct(T.sentences(text).alias("sentences"), terms(text).alias("terms"))


# Signs that stand without a blank before or behind them.
_CLOSING, _OPENING = r"[.,:;?!%)\]}>]|''|n't|N'T|'(?:s|S|m|M|d|D|ll|LL|re|RE|ve|VE)?", r"[(\[{<$#]|``"


def detokenize(tokens: Column) -> Column:
    """Text of an array of tokens: blanks between them except around signs that lean on a neighbour, quotes as double quotes."""
    joined = F.array_join(tokens, " ")
    left = F.regexp_replace(joined, f" ({_CLOSING})(?= |$)", "$1")
    right = F.regexp_replace(left, f"(?<= |^)({_OPENING}) ", "$1")
    return F.regexp_replace(right, "``|''", '"')
