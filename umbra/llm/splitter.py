"""Splitting oversized items at natural boundaries (problem 4).

Method: recursive separator hierarchy.  A text over its limit is cut at sections; a part
that is still too long at paragraphs, then sentences, words and at last characters.  The
parts are packed greedily up to the limit, and each piece begins with exactly as many code
points of the piece before it as the overlap asks for.

Offsets count code points.  Pieces cover the text without a gap: a piece starts at the
end of the piece before it less the overlap.

Defined results: a null or empty text has no piece; a text at or under its limit is one
piece; a null profile or limit leaves the text whole with kind null; an overlap of half
the limit or more is brought down below half, so that every piece brings new text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof St Jr Sr Hr Fr Mme Mlle No Nos Nr Art Abs vs etc cf approx Ltd Inc Bd Nº bzw ca usw Sra Srta Dra Lic núm pág".split()
_NO_END = r"(?<!\b[^\W\d_])" + "".join(rf"(?<!\b{a})" for a in ABBREVIATIONS)  # nor an initial

# Separators from the coarsest to the finest; a part keeps the separator that ends it.
SEPARATORS = (
    r"\n[ \t]*\n(?=[ \t]*(?:#{1,6} |[IVXLC]+\.[ \t]|\d+\.[ \t]|[A-Z][A-Z \d]{3,}\n))",
    r"\n[ \t]*\n\s*",
    r"\n",
    rf"(?:{_NO_END}\.|[!?…])[.!?…]*[\"”»’')\]]*\s+",
    r"[,;:]\s+",
    r"\s+",
)
GROUP = 64  # chunks of a document that come together
_PATTERNS = tuple(re.compile(p) for p in SEPARATORS)
BREAKS = (" ", "\t", "\n", "\r", " ")


def _cuts(text: str, start: int, end: int, limit: int, level: int = 0) -> list[int]:
    """Ends of parts of ``text[start:end]``, each at most ``limit`` long, cut as coarsely as possible."""
    out: list[int] = []
    stack = [(start, end, level)]
    while stack:
        low, high, depth = stack.pop()
        if high - low <= limit:
            out.append(high)
        elif depth == len(_PATTERNS):
            out += [*range(low + limit, high, limit), high]
        else:
            ends = [m.end() for m in _PATTERNS[depth].finditer(text, low, high) if low < m.end() < high]
            edges = [low, *ends, high]
            stack += [(a, b, depth + 1) for a, b in reversed(list(zip(edges, edges[1:])))]
    return sorted(out)


def pieces(text: str | None, limit: int | None, overlap: int | None) -> list[tuple[int, int]]:
    """Start and end of each piece."""
    if not text:
        return []
    if limit is None or limit < 1 or len(text) <= limit:
        return [(0, len(text))]
    overlap = max(0, min(overlap or 0, (limit - 1) // 2))
    # the first piece may use the whole limit; the others give the overlap of it to the piece before
    room = limit - overlap
    cuts = _cuts(text, 0, len(text), room)
    out: list[tuple[int, int]] = []
    start, begin, at = 0, 0, 0
    while at < len(cuts):
        end = cuts[at]
        while at + 1 < len(cuts) and cuts[at + 1] - begin <= limit:
            at += 1
            end = cuts[at]
        out.append((begin, end))
        at += 1
        start = end
        begin = max(start - overlap, 0)
    return out


def is_unbroken(text: str, limit: int) -> bool:
    """Whether the text holds a run of more than ``limit`` code points without blank, tab or line break."""
    return any(len(run) > limit for run in re.split(r"[ \t\r\n]+", text))


_SCHEMA = "chunk_id long, kind string, piece_no int, text string, start int, end int, n_pieces int"
_COLUMNS = ["chunk_id", "kind", "piece_no", "text", "start", "end", "n_pieces"]


def _place(document: str | None, text: str, claimed: float | None) -> int | None:
    """Where the chunk's text begins in its document: the true place nearest to the claimed one."""
    if not document:
        return None
    claimed = 0 if claimed is None or claimed != claimed else int(claimed)
    best = None
    at = document.find(text)
    while at >= 0:
        if best is None or abs(at - claimed) < abs(best - claimed):
            best = at
        if at > claimed:
            break
        at = document.find(text, at + 1)
    return best


def _split_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for document, held in zip(batch["document"], batch["held"]):
            for c in held:
                limit, overlap = c["max_length"], c["overlap"] or 0
                kind = "unbroken" if is_unbroken(c["text"], limit) else "splittable"
                base = _place(document, c["text"], c["start"]) or 0
                found = pieces(c["text"], limit, overlap)
                rows += [(c["chunk_id"], kind, no, c["text"][a:b], base + a, base + b, len(found)) for no, (a, b) in enumerate(found)]
        yield pd.DataFrame(rows, columns=_COLUMNS)


def split_chunks(chunks: DataFrame, profiles: DataFrame, documents: DataFrame) -> DataFrame:
    """Pieces of every chunk over the limit of its profile, with offsets in the chunk's document.

    Repeated rows of a chunk count once.  Only chunks over their limit meet the documents,
    and a document's text comes once to each GROUP or so of its chunks, not to every chunk.
    """
    limits = profiles.groupBy("profile").agg(F.max("max_length").alias("max_length"), F.max("overlap").alias("overlap"))
    over = chunks.select("chunk_id", "doc_id", "text", "start", "profile").join(limits, "profile").where(F.length("text") > F.col("max_length"))
    once = over.where("chunk_id is not null").groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.min(F.struct("text", "doc_id", "start", "max_length", "overlap")).alias("c")).select("chunk_id", "c.*")
    texts = documents.where("text is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("delivered_at", "text")).alias("d")).select("doc_id", F.col("d.text").alias("document"))
    numbers = once.groupBy("doc_id").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups")).where("doc_id is not null")
    held = once.join(numbers, "doc_id", "left").withColumn("part", F.expr("coalesce(pmod(xxhash64(chunk_id), groups), xxhash64(chunk_id))"))
    grouped = held.groupBy("doc_id", "part").agg(F.collect_list(F.struct("chunk_id", "text", "start", "max_length", "overlap")).alias("held"))
    return grouped.join(texts, "doc_id", "left").select("document", "held").mapInPandas(_split_batches, _SCHEMA)


def rebuilt(split: DataFrame) -> DataFrame:
    """chunk_id, n_chars and text_md5 of every split chunk, put together again from its pieces by their offsets."""
    held = split.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "text"))).alias("p"))
    whole = F.expr("array_join(transform(p, (piece, at) -> IF(at = 0, piece.text, substring(piece.text, p[at - 1].end - piece.start + 1))), '')")
    return held.select("chunk_id", whole.alias("whole")).select("chunk_id", F.length("whole").alias("n_chars"), F.md5("whole").alias("text_md5"))
