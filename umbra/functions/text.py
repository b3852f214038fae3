"""Text functions: splitting, tokens, chunks, recoding.  All are Column expressions.

Offsets are 0-based, half-open and count code points, as ``length`` and ``substring`` do.
Null text gives null; empty text gives what each docstring states.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

SENTENCE = r"(?s)(.*?[.!?]+\s+|.+$)"
_TOKEN = re.compile(r"\w+|[^\w \t\n\r\f]")
_STRETCH = re.compile(r"[^ \t\n\r\f\v]+")
WORD = r"[\p{L}\p{N}_]{2,}"
# ASCII punctuation, and the characters a token keeps when it is tested against the ignore set.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
KEPT = r"[^\nA-Za-z0-9À-ÖØ-öø-ÿЀ-ӿ/]"


def _slice(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(text, r"^[\s  - 　]+", ""), r"[\s  - 　]+$", "")


def recode(text: Column) -> Column:
    """Resolves written escapes in a fixed order, the doubled backslash last."""
    for written, meant in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"'), ("\\'", "'"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(written), F.lit(meant))
    return text


def with_offsets(parts: Column) -> Column:
    """array<struct<start,end,text>> of parts that follow each other without a gap."""
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))
    step = lambda acc, part: F.struct(
        (acc["at"] + F.length(part)).alias("at"),
        F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(part)).alias("end"), part.alias("text")))).alias("out"),
    )
    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def sentences(text: Column) -> Column:
    """array<struct<start,end,text>>: cut after each run of end marks and the blanks behind it; empty text is one empty sentence."""
    parts = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(1))
    return with_offsets(F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(parts))


_SPAN = ST.StructType([ST.StructField("start", ST.IntegerType()), ST.StructField("end", ST.IntegerType()), ST.StructField("text", ST.StringType())])


@F.pandas_udf(ST.ArrayType(_SPAN))
def tokens(texts: pd.Series) -> pd.Series:
    """Words and single other signs with their offsets; in time linear in the text, as higher-order functions are not."""
    return pd.Series([None if t is None else [{"start": m.start(), "end": m.end(), "text": m.group()} for m in _TOKEN.finditer(t)] for t in texts])


@F.pandas_udf(ST.ArrayType(_SPAN))
def blank_tokens(texts: pd.Series) -> pd.Series:
    """Stretches between blanks with their offsets."""
    return pd.Series([None if t is None else [{"start": m.start(), "end": m.end(), "text": m.group()} for m in _STRETCH.finditer(t)] for t in texts])


def words(text: Column) -> Column:
    """array<string> of words of two characters or more, in small letters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def truncate(text: Column, limit: int) -> Column:
    return F.left(text, F.lit(limit))


def windows(length: Column, size: int, overlap: int) -> Column:
    """array<struct<start,end>> of windows over 0..length; the last ends at the length.

    Raises ValueError if the overlap is not below the size.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be at least 0 and below the window's size")
    stride = size - overlap
    count = F.greatest(F.ceil((length - overlap) / F.lit(stride)), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((i * stride).alias("start"), F.least(i * stride + size, length).alias("end")))


def sliding(text: Column, size: int, overlap: int = 50) -> Column:
    """array<struct<start,end,text>> of sliding windows of a text."""
    return F.transform(windows(F.length(text), size, overlap), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), _slice(text, w["start"], w["end"]).alias("text")))


def training_windows(items: Column, size: int) -> Column:
    """array<array>: windows of items that overlap by a quarter, by one at least and by all but one at most."""
    overlap = max(1, min(size - 1, size // 4))
    return F.transform(windows(F.size(items), size, overlap), lambda w: F.slice(items, w["start"] + 1, w["end"] - w["start"]))


def token_chunks(found: Column, size: int) -> Column:
    """array<struct<start,end,n>>: every ``size`` tokens one chunk, with true offsets."""
    count = F.ceil(F.size(found) / F.lit(size)).cast("int")
    chunk = lambda i: F.slice(found, i * size + 1, size)
    made = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(chunk(i)[0]["start"].alias("start"), F.element_at(chunk(i), -1)["end"].alias("end"), F.size(chunk(i)).alias("n")))
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int,n:int>>"))


def is_punctuation(token: Column) -> Column:
    """Whether a token is a part of the punctuation string (an empty one is)."""
    return (token == "") | (F.instr(F.lit(PUNCTUATION), token) > 0)


def is_ignored(token: Column, ignored: Column) -> Column:
    """Whether a token is blank, holds no kept character, or is in the ignore set in small letters."""
    kept = F.regexp_replace(token, KEPT, "")
    return (strip(token) == "") | (kept == "") | F.array_contains(ignored, F.lower(kept))


def transfer_case(private: Column, original: Column) -> Column:
    """The private token in the case of the original: by character at equal length, else capitalised like it."""
    pairs = F.zip_with(F.split(private, ""), F.split(original, ""), lambda p, o: F.when((o == F.upper(o)) & (o != F.lower(o)), F.upper(p)).otherwise(F.lower(p)))
    first = F.left(original, F.lit(1))
    capital = F.concat(F.upper(F.left(private, F.lit(1))), F.lower(F.substring(private, F.lit(2), F.length(private))))
    return F.when(F.length(private) == F.length(original), F.array_join(pairs, "")).when((first == F.upper(first)) & (first != F.lower(first)), capital).otherwise(private)


def mask_first(text: Column, token: Column, mask: str = "[MASK]") -> Column:
    """The text with the first place where the token stands, even inside a word, masked."""
    at = F.position(token, text)
    return F.when((at > 0) & (F.length(token) > 0), F.concat(F.substring(text, F.lit(1), at - 1), F.lit(mask), F.substring(text, at + F.length(token), F.length(text)))).otherwise(text)


def mask_at(text: Column, start: Column, end: Column, mask: str = "[MASK]") -> Column:
    return F.concat(F.substring(text, F.lit(1), start), F.lit(mask), F.substring(text, end + 1, F.length(text)))


def age_group(age: Column) -> Column:
    """Name of the age group; null for null."""
    out = F.when(age < 18, "under_18")
    for low, high in ((18, 25), (25, 35), (35, 45), (45, 55), (55, 65)):
        out = out.when(age < high, f"{low}_{high - 1}")
    return out.when(age.isNotNull(), "65_plus")


def persona_hash(fields: list[tuple[str, Column]]) -> Column:
    """First 16 hex digits of SHA-256 over ``key=value`` pairs in key order; null is written None."""
    parts = [F.concat(F.lit(f"{key}="), F.coalesce(value.cast("string"), F.lit("None"))) for key, value in sorted(fields, key=lambda f: f[0])]
    joined = F.concat_ws("|", *parts) if parts else F.lit("unknown_persona")
    return F.substring(F.sha2(joined, 256), 1, 16)
