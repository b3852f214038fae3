"""Deeply nested semi-structured records as related flat tables (problem 5).

Method: each record is stream-parsed into path-value-ordinal triples: the parser walks
objects and arrays in the text and decodes one repeated element at a time.  The triples are
grouped by their repeated ancestor (an array, or an object whose keys are data), and each
group is pivoted into one table (``pivot`` for columns known beforehand, ``flat_tables``
for every ancestor and leaf found).  A child row names its parents by key and ordinal:
``ordinals`` holds the place in each repeated ancestor from the outermost on, data keys
counted too, so two members of one key stay apart.

The triples of a record are made in one task, so the partial aggregation before the
shuffle already completes the pivot; what is shuffled is the result.

Shapes that mean the same are brought together while parsing: a single value or object
stands for an array of one, a list of objects that name their key stands for an object
with those keys, and fields wrapped one level deeper are lifted.

Defined results: text that is null or no valid JSON gives no triples; a null element
keeps its ordinal but gives no row; an empty array or object gives no child; of a key that
an object holds twice the last value counts; unknown keys are parsed and come out of
``flat_tables``; values that are not of a column's type become null.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIPLE = "path string, keys array<string>, ordinals array<int>, value string, kind string"


@dataclass(frozen=True)
class Shape:
    """What parsing must know of a document type.

    ``keyed``: paths whose keys are data, with the field that names the key where the same
    is delivered as a list.  ``arrays``: paths that are arrays even if a single value is
    delivered.  ``wrappers``: names of objects whose fields belong to the object around.
    """

    root: str
    keyed: dict[str, str] = field(default_factory=dict)
    arrays: frozenset[str] = frozenset()
    wrappers: frozenset[str] = frozenset()


Row = tuple[str, list[str], list[int], str | None, str]
_BLANK = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()


class _Stream:
    """Walks one JSON text; objects on the way to repeated elements are never held whole."""

    def __init__(self, text: str, shape: Shape):
        self.text, self.shape, self.at = text, shape, 0

    def rows(self) -> list[Row]:
        """Triples of the whole text; ValueError if it is no JSON."""
        self._blank()
        out = self._value(self.shape.root, [], [])
        self._blank()
        if self.at != len(self.text):
            raise ValueError("text after the end")
        return out

    def _blank(self) -> None:
        self.at = _BLANK.match(self.text, self.at).end()

    def _next(self) -> str:
        self._blank()
        return self.text[self.at : self.at + 1]

    def _take(self, sign: str) -> None:
        if self._next() != sign:
            raise ValueError(f"{sign} expected at {self.at}")
        self.at += 1

    def _decode(self):
        self._blank()
        value, self.at = _DECODER.raw_decode(self.text, self.at)
        return value

    def _members(self) -> Iterator[str]:
        """The keys of an object, standing at each one's value."""
        self._take("{")
        if self._next() == "}":
            self.at += 1
            return
        while True:
            if self._next() != '"':
                raise ValueError(f"key expected at {self.at}")
            key = self._decode()
            self._take(":")
            self._blank()
            yield key
            if self._next() == "}":
                self.at += 1
                return
            self._take(",")

    def _value(self, path: str, keys: list, ordinals: list[int]) -> list[Row]:
        first = self._next()
        if first == "{" and path in self.shape.keyed:
            return self._keyed(path, keys, ordinals)
        if first == "{" and path not in self.shape.arrays:
            held: dict[str, list[Row]] = {}
            for name in self._members():
                inner = path if name in self.shape.wrappers and self._next() == "{" else f"{path}.{name}"
                held.pop(name, None)
                held[name] = self._value(inner, keys, ordinals)
            return [(path, keys, ordinals, None, "object"), *(row for rows in held.values() for row in rows)]
        if first == "[" and path not in self.shape.keyed:
            self.at += 1
            out: list[Row] = []
            place = 0
            if self._next() == "]":
                self.at += 1
                return out
            while True:  # one element at a time
                out += decoded(self._decode(), f"{path}[]", keys, [*ordinals, place], self.shape)
                place += 1
                if self._next() == "]":
                    self.at += 1
                    return out
                self._take(",")
        return decoded(self._decode(), path, keys, ordinals, self.shape)

    def _keyed(self, path: str, keys: list, ordinals: list[int]) -> list[Row]:
        own = path.rsplit(".", 1)[-1]
        held: dict[str, list[Row]] = {}
        wrapped = None
        for place, key in enumerate(self._members()):
            if key == own:  # may hold what belongs one level higher
                start = self.at
                wrapped = self._decode()
                self.at, end = start, self.at
                end = _BLANK.match(self.text, end).end()
                if not held and self.text[end : end + 1] == "}":
                    self.at = end + 1
                    return decoded(wrapped, path, keys, ordinals, self.shape)
            held.pop(key, None)
            here = [*keys, key], [*ordinals, place]
            if self._next() == "n":
                self._decode()
                held[key] = decoded({}, f"{path}.*", *here, self.shape)
            else:
                held[key] = self._value(f"{path}.*", *here)
        return [row for rows in held.values() for row in rows]


def decoded(root: object, path: str, keys: list, ordinals: list[int], shape: Shape) -> list[Row]:
    """Triples of a decoded value that stands at ``path``."""
    out: list[Row] = []
    stack: list[tuple[str, list, list, object]] = [(path, keys, ordinals, root)]
    while stack:
        path, keys, ordinals, value = stack.pop()
        if value is None:
            continue
        if path in shape.keyed:
            name = shape.keyed[path]
            if isinstance(value, dict) and set(value) == {path.rsplit(".", 1)[-1]}:
                value = next(iter(value.values()))
            if isinstance(value, dict):
                members = [(at, k, v) for at, (k, v) in enumerate(value.items())]
            elif isinstance(value, list):
                members = [(at, v.get(name), {k: x for k, x in v.items() if k != name}) for at, v in enumerate(value) if isinstance(v, dict)]
            else:
                members = []
            for at, key, member in reversed(members):
                key = key if key is None or isinstance(key, str) else json.dumps(key)
                stack.append((path + ".*", [*keys, key], [*ordinals, at], {} if member is None else member))
            continue
        if path in shape.arrays and not isinstance(value, list):
            value = [value]
        if isinstance(value, list):
            for at, member in reversed(list(enumerate(value))):
                stack.append((path + "[]", keys, [*ordinals, at], member))
        elif isinstance(value, dict):
            out.append((path, keys, ordinals, None, "object"))
            for name, member in reversed(value.items()):
                stack.append((path if name in shape.wrappers and isinstance(member, dict) else f"{path}.{name}", keys, ordinals, member))
        elif isinstance(value, str):
            out.append((path, keys, ordinals, value, "string"))
        else:
            out.append((path, keys, ordinals, json.dumps(value), "boolean" if isinstance(value, bool) else "number"))
    return out


def triples(text: str | None, shape: Shape) -> list[Row]:
    """(path, data keys, ordinals, value, kind) of every leaf and object; none if the text is no JSON.

    ``kind`` is ``object`` (a marker for each object) or the type of the leaf.
    """
    if text is None:
        return []
    try:
        return _Stream(text, shape).rows()
    except (ValueError, RecursionError):
        return []


def parse(records: DataFrame, id_col: str, json_col: str, shape: Shape) -> DataFrame:
    """id_col and the triples of the JSON in ``json_col``, one row each."""
    kind = dict(records.dtypes)[id_col]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *t) for key, text in zip(batch[id_col], batch[json_col]) for t in triples(text, shape)]
            yield pd.DataFrame(rows, columns=[id_col, "path", "keys", "ordinals", "value", "kind"])

    return records.select(id_col, json_col).where(F.col(json_col).isNotNull()).mapInPandas(scan, f"{id_col} {kind}, {TRIPLE}")


def repeats(path: str) -> int:
    """Number of repeated ancestors of a path, itself included."""
    return path.count("[]") + path.count(".*")


def ancestor_of(path: str) -> tuple[str, str]:
    """The nearest repeated ancestor of a path (the root if there is none) and the leaf below it."""
    cut = max(path.rfind("[]"), path.rfind(".*"))
    if cut < 0:
        return path.split(".", 1)[0], path.partition(".")[2]
    return path[: cut + 2], path[cut + 2 :].lstrip(".")


def paths(parsed: DataFrame) -> DataFrame:
    """path, kind, n of all triples: the shape of the data as delivered."""
    return parsed.groupBy("path", "kind").agg(F.count("*").alias("n"))


def flat_tables(parsed: DataFrame, id_col: str, limit: int = 5_000) -> dict[str, DataFrame]:
    """A table for every repeated ancestor found, with a text column for every leaf found below it.

    The distinct paths, which make the schema, come to the driver; more than ``limit`` of
    them are an error, for then keys are data that the shape does not name.
    """
    found = [row["path"] for row in parsed.where("kind <> 'object'").select("path").distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} paths: name the objects whose keys are data in the shape")
    leaves: dict[str, dict[str, str]] = {}
    for path in sorted(found):
        ancestor, leaf = ancestor_of(path)
        leaves.setdefault(ancestor, {})[leaf] = "STRING"
    return {ancestor: pivot(parsed, id_col, ancestor, columns) for ancestor, columns in leaves.items()}


def pivot(parsed: DataFrame, id_col: str, ancestor: str, columns: dict[str, str]) -> DataFrame:
    """The table of one repeated ancestor: id_col, keys, ordinals and a column for each leaf.

    ``columns`` maps a leaf below the ancestor ("" for the element itself) to the SQL type
    of its column.
    """
    below = (F.col("path") == ancestor) | F.col("path").startswith(ancestor + ".")
    leaf = lambda name: ancestor + ("." + name if name else "")
    quoted = lambda path: path.replace("\\", "\\\\").replace("'", "\\'")
    values = [F.expr(f"try_cast(max(CASE WHEN path = '{quoted(leaf(name))}' THEN value END) AS {kind})").alias(name or "value") for name, kind in columns.items()]
    group = [id_col, "keys", "ordinals"]
    return parsed.where(below & (F.size("ordinals") == repeats(ancestor))).groupBy(*group).agg(*(values or [F.lit(1).alias("present")]))


ANNOTATIONS = Shape("annotations", keyed={"annotations": "annotator"}, arrays=frozenset({"annotations.*.entity_mentions"}), wrappers=frozenset({"metadata"}))
META = Shape("meta", arrays=frozenset({"meta.countries", "meta.years"}), wrappers=frozenset({"meta"}))
MENTION = "annotations.*.entity_mentions[]"
MENTION_COLUMNS = {"entity_mention_id": "STRING", "start_offset": "INT", "end_offset": "INT", "span_text": "STRING", "entity_type": "STRING", "identifier_type": "STRING", "confidential_status": "STRING"}


def latest(cases: DataFrame) -> DataFrame:
    """The delivery of each document that came last; repeated rows count once, ties go to the greatest row_id."""
    kept = ["delivered_at", "row_id", "text", "quality_checked", "task", "dataset_type", "meta", "annotations"]
    return cases.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct(*kept)).alias("d")).select("doc_id", "d.*")


def case_tables(cases: DataFrame) -> dict[str, DataFrame]:
    """documents, annotators, mentions, countries and years of the latest deliveries."""
    last = latest(cases)
    annotations = parse(last, "doc_id", "annotations", ANNOTATIONS)
    meta = parse(last, "doc_id", "meta", META)
    applicant = meta.where("path = 'meta.applicant'").select("doc_id", F.col("value").alias("applicant"))
    documents = last.select("doc_id", "row_id", "delivered_at", "quality_checked", "task", "dataset_type", F.length("text").cast("long").alias("n_chars"))
    mentions = pivot(annotations, "doc_id", MENTION, MENTION_COLUMNS)
    return {
        "documents": documents.join(applicant, "doc_id", "left"),
        "annotators": annotations.where("path = 'annotations.*'").select("doc_id", F.col("keys")[0].alias("annotator"), F.col("ordinals")[0].alias("annotator_pos")).distinct(),
        "mentions": mentions.select("doc_id", F.col("keys")[0].alias("annotator"), F.col("ordinals")[0].alias("annotator_pos"), F.col("ordinals")[1].alias("pos"), *MENTION_COLUMNS),
        "countries": pivot(meta, "doc_id", "meta.countries[]", {"": "STRING"}).select("doc_id", F.col("ordinals")[0].alias("pos"), F.col("value").alias("country")),
        "years": pivot(meta, "doc_id", "meta.years[]", {"": "INT"}).select("doc_id", F.col("ordinals")[0].alias("pos"), F.col("value").alias("year")),
    }


def children(cases: DataFrame) -> DataFrame:
    """doc_id, parent, child, pos: one row for each mention, country and year."""
    tables = case_tables(cases)
    meta = F.lit("meta").alias("parent")
    mentions = tables["mentions"].select("doc_id", F.col("annotator").alias("parent"), F.lit("mention").alias("child"), "pos")
    countries = tables["countries"].select("doc_id", meta, F.lit("country").alias("child"), "pos")
    years = tables["years"].select("doc_id", meta, F.lit("year").alias("child"), "pos")
    return mentions.unionByName(countries).unionByName(years)
