"""Sinks: run outputs, annotation files, reports."""

from __future__ import annotations

import json
import math
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_run(results: DataFrame, folder: str, resume: bool = False) -> None:
    """JSON lines of idx, text and, where they are not empty, spans and metadata.

    One part file for each partition: the folder is the run.  Null and empty fields are left
    out.  With ``resume`` what the folder holds stays, and only records that it does not
    hold are worked off and appended.
    """
    columns = ["idx", "text"]
    out = results
    if "spans" in results.columns:
        fields = [f.name for f in results.schema["spans"].dataType.elementType]
        slim = F.transform("spans", lambda s: F.struct(*[(F.nullif(s[f], F.lit("")) if f in ("label", "text", "replacement", "annotator") else s[f]).alias(f) for f in fields]))
        out = out.withColumn("spans", F.when(F.size("spans") > 0, slim))
        columns.append("spans")
    if "metadata" in results.columns:
        out = out.withColumn("metadata", F.when(F.size("metadata") > 0, F.col("metadata")))
        columns.append("metadata")
    if resume:
        spark = results.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            out = out.join(spark.read.schema("idx long").json(folder).distinct(), "idx", "left_anti")
    out.select(*columns).write.mode("append" if resume else "overwrite").option("ignoreNullFields", "true").json(folder)


def print_records(results: DataFrame, most: int = 20) -> None:
    """Prints text, number of spans and metadata of the first records by index."""
    for row in results.orderBy("idx").limit(most).toLocalIterator():
        held = row.asDict(recursive=True)
        print(f"[{held['idx']}] {held['text']}")
        print(f"    spans: {len(held.get('spans') or [])}" + (f"  metadata: {held['metadata']}" if held.get("metadata") else ""))


def annotation_lines(records: DataFrame) -> DataFrame:
    """value: one ``"uid": [spans]`` line for each record, nulls kept; what an annotation file is made of."""
    return records.select(F.concat(F.concat(F.lit('"'), F.replace(F.replace("uid", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit(": "), F.to_json("spans", {"ignoreNullFields": "false"})).alias("value"))


def write_annotations(records: DataFrame, path: str) -> None:
    """An annotation file, streamed to the driver line by line."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write("{")
        for n, row in enumerate(annotation_lines(records).toLocalIterator()):
            out.write((",\n  " if n else "\n  ") + row["value"])
        out.write("\n}\n")


def report(summary: DataFrame, entries: DataFrame | None = None, form: str = "text", order: str = "dataset", entry_order: str = "index") -> str:
    """A report as text, json or jsonl: summaries by dataset, entries in order of their index.

    Reports are read by people; entries come to the driver row by row.
    """
    heads = [row.asDict() for row in summary.orderBy(order).toLocalIterator()]
    rows = [row.asDict() for row in entries.orderBy(entry_order).toLocalIterator()] if entries is not None else []
    if form == "json":
        return json.dumps({"summaries": heads, "entries": rows}, indent=2, ensure_ascii=False, default=str)
    if form == "jsonl":
        return "\n".join(json.dumps({"type": kind} | row, ensure_ascii=False, default=str) for kind, part in (("summary", heads), ("entry", rows)) for row in part)
    if form != "text":
        raise ValueError(f"unknown report form {form!r}; known: text, json, jsonl")

    def shown(key: str, value: object) -> str:
        if key == "delta" and isinstance(value, int):
            return f"{key}={value:+d}"
        return f"{key}={value:.4f}" if isinstance(value, float) else f"{key}={value}"

    return "\n".join([*("  ".join(shown(k, v) for k, v in row.items()) for row in heads), *("    " + "  ".join(shown(k, v) for k, v in row.items()) for row in rows)])


def score_table(rows: list[dict], kinds: tuple[str, ...], temperature: float = 1.0) -> str:
    """Words of one text with each score and its soft-max at a temperature; a missing score is n/a."""
    if temperature <= 0:
        raise ValueError("the temperature must be above 0")
    lines = ["idx  word" + "".join(f"  {k}  p({k})" for k in kinds)]
    shares: dict[str, list[float | None]] = {}
    for kind in kinds:
        known = [r[kind] for r in rows if r[kind] is not None]
        top = max(known, default=0.0)
        exps = [math.exp((r[kind] - top) / temperature) if r[kind] is not None else None for r in rows]
        total = sum(e for e in exps if e is not None)
        shares[kind] = [None if e is None else e / total if total > 0 and math.isfinite(total) else 1 / len(known) for e in exps]
    shown = lambda x: "n/a" if x is None else f"{x:.6f}"
    lines += [f"{n:>3}  {row['word']}" + "".join(f"  {shown(row[k])}  {shown(shares[k][n])}" for k in kinds) for n, row in enumerate(rows)]
    return "\n".join(lines)


def put(text: str, path: str | None) -> None:
    """Prints a report, or writes it to a file with a line end."""
    if path is None:
        print(text)
        return
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        out.write(text + "\n")
