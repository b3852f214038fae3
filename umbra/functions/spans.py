"""Span algebra on array<struct<start,end,...>> columns, evaluated in the JVM.

A span is half-open and counts code points.  Sorts are stable: spans that tie keep their
order in the array.  Null arrays give null; empty ones give the text as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "[MASK]"


def numbered(spans: Column) -> Column:
    """The spans with their place in the array as ``ord``."""
    return F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("ord"), s.alias("span")))


def by_start(spans: Column, descending: bool = False) -> Column:
    """Numbered spans in order of their start, ties in order of the array."""
    sign = -1 if descending else 1
    keyed = F.transform(numbered(spans), lambda s: F.struct((s["start"] * sign).alias("k"), s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end"), s["span"].alias("span")))
    return F.array_sort(keyed)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return ~((a_end <= b_start) | (a_start >= b_end))


def is_valid(start: Column, end: Column, length: Column) -> Column:
    return (start >= 0) & (start < end) & (end <= length)


def valid(spans: Column, text: Column) -> Column:
    return F.filter(spans, lambda s: is_valid(s["start"], s["end"], F.length(text)))


def confident(spans: Column, threshold: float, keep_unknown: bool = True) -> Column:
    return F.filter(spans, lambda s: F.coalesce(s["confidence"] >= threshold, F.lit(keep_unknown)))


def splice(text: Column, start: Column, end: Column, put: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), start), put, F.substring(text, end + 1, F.length(text)))


def replace_spans(text: Column, spans: Column, put) -> Column:
    """Puts ``put(span)`` in place of each span, from the last start to the first.

    Each span is tested against the text as changed so far, and overlaps compound.
    """
    return F.aggregate(by_start(spans, descending=True), text, lambda acc, s: F.when(is_valid(s["start"], s["end"], F.length(acc)), splice(acc, s["start"], s["end"], put(s["span"]))).otherwise(acc))


def apply_annotations(text: Column, spans: Column, mask: str = MASK) -> Column:
    """Each span's replacement, or the mask where it has none."""
    return replace_spans(text, spans, lambda s: F.coalesce(F.nullif(s["replacement"], F.lit("")), F.lit(mask)))


def mask_spans(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The mask in place of each span, sorted by start and end; overlaps compound."""
    ordered = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(ordered, text, lambda acc, s: F.when(is_valid(s["start"], s["end"], F.length(acc)), splice(acc, s["start"], s["end"], F.lit(mask))).otherwise(acc))


def mask_by_label(text: Column, spans: Column) -> Column:
    """``[label]`` in place of each span, the mask where the label is empty."""
    return replace_spans(text, spans, lambda s: F.when(F.coalesce(s["label"], F.lit("")) == "", F.lit(MASK)).otherwise(F.concat(F.lit("["), s["label"], F.lit("]"))))


def keep_first(spans: Column) -> Column:
    """Spans in order of start, each kept if it begins at or after the end of the last one kept."""
    ordered = by_start(spans)
    zero = F.struct(F.lit(-1).alias("last"), F.filter(ordered, lambda s: F.lit(False)).alias("out"))
    step = lambda acc, s: F.when(s["start"] >= acc["last"], F.struct(s["end"].alias("last"), F.concat(acc["out"], F.array(s)).alias("out"))).otherwise(acc)
    return F.transform(F.aggregate(ordered, zero, step, lambda acc: acc["out"]), lambda s: s["span"])


def redact_disjoint(text: Column, spans: Column) -> Column:
    """``[label]`` in place of disjoint spans in order; a null label is written None."""
    put = lambda s: F.concat(F.lit("["), F.coalesce(s["label"], F.lit("None")), F.lit("]"))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), put(s)).alias("out"), s["end"].alias("at"))
    return F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def mask_original(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The mask in place of each span whose limits fit the original text; replacements are not used."""
    return F.aggregate(by_start(valid(spans, text), descending=True), text, lambda acc, s: splice(acc, s["start"], s["end"], F.lit(mask)))


def clip_to(spans: Column, start: Column, end: Column) -> Column:
    """The parts of spans inside a sentence, relative to its start."""
    inside = F.filter(spans, lambda s: overlaps(s["start"], s["end"], start, end))
    return F.transform(inside, lambda s: F.struct((F.greatest(s["start"], start) - start).alias("start"), (F.least(s["end"], end) - start).alias("end")))


def expand_to_tokens(start: Column, end: Column, tokens: Column) -> Column:
    """Hull of a span's overlapping tokens; the span itself if it meets none."""
    met = F.filter(tokens, lambda t: overlaps(t["start"], t["end"], start, end))
    low, high = F.array_min(F.transform(met, lambda t: t["start"])), F.array_max(F.transform(met, lambda t: t["end"]))
    return F.struct(F.coalesce(F.least(low, start), start).alias("start"), F.coalesce(F.greatest(high, end), end).alias("end"))


def align(spans: Column, tokens: Column, text: Column) -> Column:
    """Spans grown to token limits, each pair of limits once, sorted by start and end, with their text."""
    grown = F.array_sort(F.array_distinct(F.transform(spans, lambda s: expand_to_tokens(s["start"], s["end"], tokens))))
    return F.transform(grown, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.substring(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def to_pairs(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.array(s["start"], s["end"]))


def from_pairs(pairs: Column, text: Column) -> Column:
    fits = lambda p: (F.length(text) > 0) & (p[1] <= F.length(text))
    return F.transform(pairs, lambda p: F.struct(p[0].alias("start"), p[1].alias("end"), F.when(fits(p), F.substring(text, p[0] + 1, p[1] - p[0])).alias("text")))


def merge_chunks(spans: Column) -> Column:
    """Merges spans (start, end, label, confidence) of one text's chunks, already shifted to it.

    Sorted by start; a span joins the last one out if it begins at or before its end and
    has its label; the first one's confidence stays.
    """
    ordered = F.transform(by_start(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["span"]["label"].alias("label"), s["span"]["confidence"].alias("confidence")))

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"), last["confidence"].alias("confidence"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= last["end"]) & last["label"].eqNullSafe(s["label"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(ordered, F.filter(ordered, lambda s: F.lit(False)), step)
