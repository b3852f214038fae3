"""Scores of span detection: strict, exact and partial precision, recall and F1, and by character."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans as S


def _ratio(a, b):
    return F.round(F.coalesce(a / F.nullif(b, F.lit(0.0)), F.lit(0.0)), 6)


def matches(gold: DataFrame, found: DataFrame, key: str = "uid") -> DataFrame:
    """label, outcome, n: each found span is correct, typed (limits right), partial or spurious; each unmet gold span is missed.

    Both sides have key, start, end, label, one row for each span.
    """
    met = S.overlaps(F.col("g.start"), F.col("g.end"), F.col("f.start"), F.col("f.end"))
    pairs = found.alias("f").join(gold.alias("g"), (F.col(f"f.{key}") == F.col(f"g.{key}")) & met, "left")
    limits = (F.col("f.start") == F.col("g.start")) & (F.col("f.end") == F.col("g.end"))
    order = F.when(F.col("g.start").isNull(), 0).when(limits & (F.col("f.label") == F.col("g.label")), 3).when(limits, 2).otherwise(1)
    best = pairs.groupBy(f"f.{key}", "f.start", "f.end", "f.label").agg(F.max(order).alias("o"))
    names = F.element_at(F.array(F.lit("spurious"), F.lit("partial"), F.lit("typed"), F.lit("correct")), F.col("o") + 1)
    missed = gold.alias("g").join(found.alias("f"), (F.col(f"f.{key}") == F.col(f"g.{key}")) & met, "left_anti")
    rows = best.select("label", names.alias("outcome")).unionByName(missed.select("label", F.lit("missed").alias("outcome")))
    return rows.groupBy("label", "outcome").agg(F.count("*").alias("n"))


def prf(gold: DataFrame, found: DataFrame, key: str = "uid") -> DataFrame:
    """mode, precision, recall, f1, possible, actual over all labels."""
    n = lambda *names: F.sum(F.when(F.col("outcome").isin(*names), F.col("n")).otherwise(0)).cast("double")
    counted = matches(gold, found, key).agg(n("correct").alias("correct"), n("typed").alias("typed"), n("partial").alias("partial"), n("correct", "typed", "partial", "spurious").alias("actual"), n("missed").alias("missed"))
    total = gold.agg(F.count("*").cast("double").alias("possible"))
    hits = {"strict": F.col("correct"), "exact": F.col("correct") + F.col("typed"), "partial": F.col("correct") + F.col("typed") + 0.5 * F.col("partial")}
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), h.alias("hit")) for m, h in hits.items()])).alias("m")
    rows = counted.crossJoin(total).select("actual", "possible", modes).select("m.mode", "m.hit", "actual", "possible")
    p, r = F.col("hit") / F.nullif(F.col("actual"), F.lit(0.0)), F.col("hit") / F.nullif(F.col("possible"), F.lit(0.0))
    return rows.select("mode", _ratio(F.col("hit"), F.col("actual")).alias("precision"), _ratio(F.col("hit"), F.col("possible")).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"), F.col("possible").cast("long").alias("possible"), F.col("actual").cast("long").alias("actual"))


def char_prf(gold_tags: DataFrame, found_tags: DataFrame, key: str = "uid") -> DataFrame:
    """precision, recall, f1 over characters whose tag is not O (key, pos, tag on both sides)."""
    met = gold_tags.select(key, "pos", F.col("tag").alias("g")).join(found_tags.select(key, "pos", F.col("tag").alias("f")), [key, "pos"], "full")
    counted = met.agg(F.count_if(F.col("g") == F.col("f")).cast("double").alias("hit"), F.count("g").cast("double").alias("gold"), F.count("f").cast("double").alias("found"))
    p, r = F.col("hit") / F.nullif(F.col("found"), F.lit(0.0)), F.col("hit") / F.nullif(F.col("gold"), F.lit(0.0))
    return counted.select(_ratio(F.col("hit"), F.col("found")).alias("precision"), _ratio(F.col("hit"), F.col("gold")).alias("recall"), F.round(F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)), 6).alias("f1"))
