"""Records and their gold spans, in the shape the other operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbra.session import cut, parallelism


def once(records: DataFrame) -> DataFrame:
    """uid, idx, name, source, text of each record with a text, once: the delivery loaded last."""
    rows = records.where("uid IS NOT NULL AND text IS NOT NULL").withColumn("lang", F.element_at("metadata", F.lit("lang")))
    kept = F.max(F.struct("loaded_at", "idx", "name", "source", "split", "text", "lang")).alias("r")
    return rows.groupBy("uid").agg(kept).select("uid", "r.idx", "r.name", "r.source", "r.split", "r.text", "r.lang")


def spelt(label):
    """A label in capitals, words joined by underscores; null stays null."""
    return F.upper(F.regexp_replace(F.regexp_replace(label, r"^[\s_\-]+|[\s_\-]+$", ""), r"[\s_\-]+", "_"))


def annotations_once(annotations: DataFrame) -> DataFrame:
    """ann_id, uid, annotator, start, end, label, confidence of each mark once, the one received last."""
    kept = F.max(F.struct("received_at", "uid", "annotator", "start", "end", "label", "confidence")).alias("r")
    rows = annotations.where("ann_id IS NOT NULL AND uid IS NOT NULL").groupBy("ann_id").agg(kept)
    return rows.select("ann_id", "r.uid", "r.annotator", "r.start", "r.end", spelt(F.col("r.label")).alias("label"), "r.confidence")


def with_spans(records: DataFrame, annotations: DataFrame) -> DataFrame:
    """Records that were annotated, with ``spans`` in order of ann_id (offsets as given, usable or not)."""
    marks = annotations_once(annotations)
    span = F.struct("ann_id", "start", "end", "label", F.lit(None).cast("string").alias("replacement"), "confidence", "annotator")
    grouped = marks.where("start IS NOT NULL AND `end` IS NOT NULL").groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return once(records).join(grouped, "uid")


def stats(records: DataFrame) -> DataFrame:
    """By source: rows, uids, names, distinct metadata keys, mean and greatest text length."""
    keys = F.size(F.array_distinct(F.flatten(F.collect_set(F.coalesce(F.map_keys("metadata"), F.array().cast("array<string>"))))))
    return records.groupBy("source").agg(
        F.count("*").alias("n_records"), F.countDistinct("uid").alias("n_uids"), F.countDistinct("name").alias("n_names"),
        keys.cast("long").alias("n_keys"), F.round(F.avg(F.length("text")), 6).alias("avg_length"), F.max(F.length("text")).cast("long").alias("max_length"),
    )


def by_indices(records: DataFrame, indices: list[int], key: str = "idx") -> DataFrame:
    """The records of the given indices; ValueError names one that is not among them."""
    wanted = records.sparkSession.createDataFrame([(int(i),) for i in dict.fromkeys(indices)], f"{key} long")
    missing = wanted.join(records.select(key), key, "left_anti").agg(F.min(key).alias("i")).first()["i"]
    if missing is not None:
        raise ValueError(f"index {missing} is out of range")
    return records.join(wanted, key, "left_semi")


def with_index(records: DataFrame, order: list[str], metadata: str = "metadata") -> DataFrame:
    """The records with ``index``: their metadata's record_index, or else their place in the order, from 1."""
    placed = numbered(records, order, "_place")
    given = F.expr(f"try_cast({metadata}['record_index'] AS long)") if metadata in records.columns else F.lit(None).cast("long")
    return placed.withColumn("index", F.coalesce(given, F.col("_place") + 1)).drop("_place")


def numbered(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """The rows numbered from 0 in the given order, without bringing them into one task.

    Rows are range-partitioned and sorted; each partition's numbers begin after the rows of
    the partitions before it.  Rows that tie in the order are numbered in no fixed order.
    """
    ranged = cut(rows.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row for each partition
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(before, "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")
