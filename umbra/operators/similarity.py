"""Semantic divergence: TF-IDF cosine of original and rewritten texts, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.operators.scoring import word_counts


def inverse_frequencies(records: DataFrame, key: str) -> DataFrame:
    """word, idf over the originals: ln((1 + n) / (1 + df)) + 1."""
    counted = word_counts(records.select(key, "text"), [key])
    n = records.agg(F.count("*").alias("n_docs"))
    df = counted.groupBy("word").agg(F.count("*").alias("df"))
    return df.crossJoin(n).select("word", (F.log((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_cosine(records: DataFrame, key: str, original: str = "text", rewritten: str = "masked") -> DataFrame:
    """key, similarity of each record's two texts; 0 where one has no known word.

    One shuffle by word for both texts, one by record.
    """
    both = word_counts(records.select(key, F.col(original).alias("text")), [key]).withColumn("side", F.lit(0)).unionByName(word_counts(records.select(key, F.col(rewritten).alias("text")), [key]).withColumn("side", F.lit(1)))
    pivoted = both.groupBy(key, "word").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"))
    weighted = pivoted.join(inverse_frequencies(records.select(key, F.col(original).alias("text")), key), "word")
    square = F.col("idf") * F.col("idf")
    sums = weighted.groupBy(key).agg(F.sum(F.col("a") * F.col("b") * square).alias("ab"), F.sum(F.col("a") * F.col("a") * square).alias("aa"), F.sum(F.col("b") * F.col("b") * square).alias("bb"))
    cosine = F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).otherwise(0.0)
    return records.select(key).join(sums.select(key, cosine.alias("similarity")), key, "left").select(key, F.round(F.coalesce("similarity", F.lit(0.0)), 6).alias("similarity"))


def overlap_f1(records: DataFrame, key: str, original: str = "text", rewritten: str = "masked") -> DataFrame:
    """key, f1 of matched words: a lexical stand-in where no vectors of words are plugged in."""
    both = word_counts(records.select(key, F.col(original).alias("text")), [key]).withColumn("side", F.lit(0)).unionByName(word_counts(records.select(key, F.col(rewritten).alias("text")), [key]).withColumn("side", F.lit(1)))
    pivoted = both.groupBy(key, "word").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("b"))
    sums = pivoted.groupBy(key).agg(F.sum(F.least("a", "b")).alias("m"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    return sums.select(key, F.round(2 * F.col("m") / (F.col("a") + F.col("b")), 6).alias("f1"))


def macro(summary: DataFrame, value: str = "mean") -> DataFrame:
    """Unweighted mean over datasets of their mean."""
    return summary.agg(F.round(F.avg(value), 6).alias("macro"), F.count("*").alias("n_datasets"))
