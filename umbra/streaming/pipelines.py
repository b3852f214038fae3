"""Structured Streaming: record-at-a-time redaction, resumable by checkpoint.

The span operators keep no state, so the same column expressions serve batch and stream.
Extensions beyond that: event-time windows with a watermark.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.operators import recognise
from umbra.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema)
    local = folder.removeprefix("file://")
    if os.path.isfile(f"{local}/{name}.parquet"):
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return stream.parquet(f"{folder}/{name}.parquet")


def redact_stream(stream: DataFrame, first: int | None = None, key: str = "doc_id") -> DataFrame:
    """The stream with masked texts; ``first`` leaves out records before a number (resume)."""
    rows = stream if first is None else stream.where(F.col(key) >= first)
    return recognise.redact(rows.where("text IS NOT NULL"))


def run_to_folder(rows: DataFrame, out: str, checkpoint: str, form: str = "parquet") -> None:
    """Works off what is there and ends; a second call with the same checkpoint goes on from it."""
    query = rows.writeStream.format(form).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def redacted(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    """doc_id, masked, n_spans of a table, by way of a stream, read back from the shared folder."""
    import uuid

    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = redact_stream(read_table(spark, folder, name)).select("doc_id", "masked", F.size("spans").cast("long").alias("n_spans"))
    run_to_folder(stream, f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out")


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "10 minutes", size: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Extension: rows by event-time window and kind, with late rows dropped after the watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, size).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
