"""Relational forms of the span operators: joins between spans, tokens and records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans as S
from umbra.functions import text as T


def tokens_of(records: DataFrame, id_col: str = "uid") -> DataFrame:
    """id_col, pos, start, end, text of every token."""
    return records.select(id_col, F.posexplode(T.tokens("text")).alias("pos", "t")).select(id_col, "pos", "t.start", "t.end", "t.text")


def token_overlaps(spans: DataFrame, tokens: DataFrame, id_col: str = "uid") -> DataFrame:
    """Pairs of a span and a token of one record that overlap (an interval join inside the record's key)."""
    met = S.overlaps(F.col("s.start"), F.col("s.end"), F.col("t.start"), F.col("t.end"))
    return spans.alias("s").join(tokens.alias("t"), (F.col(f"s.{id_col}") == F.col(f"t.{id_col}")) & met)


def free_tokens(tokens: DataFrame, spans: DataFrame, id_col: str = "uid") -> DataFrame:
    """Tokens that no span overlaps."""
    met = S.overlaps(F.col("s.start"), F.col("s.end"), F.col("t.start"), F.col("t.end"))
    return tokens.alias("t").join(spans.alias("s"), (F.col(f"s.{id_col}") == F.col(f"t.{id_col}")) & met, "left_anti")


def all_instances(picked: DataFrame, tokens: DataFrame, spans: DataFrame, id_col: str = "uid") -> DataFrame:
    """Every token with the text of a picked token in the same record that no span covers yet."""
    same = tokens.join(picked.select(id_col, "text").distinct(), [id_col, "text"])
    return free_tokens(same, spans, id_col)


def char_labels(records: DataFrame, id_col: str = "uid") -> DataFrame:
    """id_col, pos, tag of every character inside a span: B- at a span's start, I- after it.

    Spans are taken in order of their start, later ones overwrite earlier ones; a label
    gives up its own B- or I- prefix; a span without label is an ENTITY.
    """
    spans = records.select(id_col, F.length("text").alias("n"), F.posexplode(S.by_start(F.col("spans"))).alias("rank", "s"))
    label = F.coalesce(F.nullif(F.regexp_replace(F.col("s.span.label"), "^[BI]-", ""), F.lit("")), F.lit("ENTITY"))
    rows = spans.where("s.start < n AND s.start >= 0").select(id_col, "rank", F.col("s.start").alias("start"), F.least("s.end", "n").alias("end"), label.alias("label")).where("start < `end`")
    marked = rows.select(id_col, "rank", "start", "label", F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    last = F.max(F.struct("rank", F.concat(F.when(F.col("pos") == F.col("start"), "B-").otherwise("I-"), "label").alias("tag"))).alias("last")
    return marked.groupBy(id_col, "pos").agg(last).select(id_col, "pos", "last.tag")


def token_labels(records: DataFrame, id_col: str = "uid") -> DataFrame:
    """id_col, pos, token, tag of every token between blanks: the tag of the first span in order that overlaps it.

    B- on the first token of a span, I- on the others, O where no span overlaps; labels as
    in ``char_labels``.
    """
    rows = records.select(id_col, F.coalesce(S.by_start(F.col("spans")), F.array()).alias("s"), T.blank_tokens(F.col("text")).alias("t"))
    label = lambda s: F.coalesce(F.nullif(F.regexp_replace(s["span"]["label"], "^[BI]-", ""), F.lit("")), F.lit("ENTITY"))
    tag = lambda t: F.when(F.size(F.filter("s", lambda s: S.overlaps(s["start"], s["end"], t["start"], t["end"]))) == 0, "O").otherwise(_first_tag(t, label))
    tagged = F.transform("t", lambda t: F.struct(t["text"].alias("token"), tag(t).alias("tag")))
    return rows.select(id_col, F.posexplode(tagged).alias("pos", "p")).select(id_col, "pos", "p.token", "p.tag")


def _first_tag(token, label):
    met = F.filter("s", lambda s: S.overlaps(s["start"], s["end"], token["start"], token["end"]))[0]
    earlier = F.exists("t", lambda other: (other["end"] <= token["start"]) & S.overlaps(met["start"], met["end"], other["start"], other["end"]))
    return F.concat(F.when(earlier, "I-").otherwise("B-"), label(met))


def ignore_set(spark, stop_words: list[str], masks: list[str], labels: DataFrame | None = None) -> DataFrame:
    """term: stop words, masks and (of a detector's runs) annotation labels, each as it is and in small letters."""
    held = spark.createDataFrame([(w,) for w in [*stop_words, *masks]], "term string")
    if labels is not None:
        held = held.unionByName(labels.select(F.col("label").alias("term")).where("label IS NOT NULL").distinct())
    return held.select(F.explode(F.array("term", F.lower("term"))).alias("term")).distinct()


def label_set(records: DataFrame) -> DataFrame:
    """One row: O and the B- and I- tags of every label, sorted."""
    labels = records.select(F.explode("spans.label").alias("label")).where("label IS NOT NULL").select(F.regexp_replace("label", "^[BI]-", "").alias("label")).distinct()
    tags = labels.select(F.explode(F.array(F.concat(F.lit("B-"), "label"), F.concat(F.lit("I-"), "label"))).alias("tag"))
    return tags.agg(F.concat(F.array(F.lit("O")), F.array_sort(F.collect_set("tag"))).alias("tags"))


def last_by_index(rows: DataFrame, value: str, order: str, key: str = "idx") -> DataFrame:
    """One row for each index from 0 to the greatest: its last value, null in gaps."""
    last = rows.where(F.col(key).isNotNull() & (F.col(key) >= 0)).groupBy(key).agg(F.max_by(value, order).alias(value))
    top = last.agg(F.max(key).alias("top")).where("top IS NOT NULL")
    dense = top.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("top").cast("long"))).alias(key))
    return dense.join(last, key, "left")


def merge_sources(sources: list[DataFrame]) -> DataFrame:
    """uid and spans of several annotation tables (uid, spans) appended in order of the tables."""
    parts = [s.select("uid", F.lit(n).alias("source_ord"), F.posexplode("spans").alias("span_ord", "span")) for n, s in enumerate(sources)]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    ordered = F.array_sort(F.collect_list(F.struct("source_ord", "span_ord", "span")))
    return both.groupBy("uid").agg(ordered.alias("s")).select("uid", F.col("s.span").alias("spans"))


def merge_by(rows: DataFrame, source: str, order: str, id_col: str = "uid") -> DataFrame:
    """id_col and spans of all sources of one annotation table, appended in order of the source, then of ``order``."""
    rest = [c for c in rows.columns if c not in (id_col, source, order)]
    ordered = F.array_sort(F.collect_list(F.struct(source, order, *rest)))
    return rows.groupBy(id_col).agg(ordered.alias("spans"))


def named_sources(paths: DataFrame) -> DataFrame:
    """path, name: ``{method}_{dataset}_{n}`` from the two folders above a file, numbered by path; each path once."""
    from pyspark.sql import Window

    parts = paths.select("path").distinct().withColumn("p", F.split("path", "/"))
    named = parts.select("path", F.element_at("p", -2).alias("method"), F.element_at("p", -3).alias("dataset"))
    number = F.row_number().over(Window.partitionBy("method", "dataset").orderBy("path")) - 1
    return named.select("path", F.concat_ws("_", "method", "dataset", number.cast("string")).alias("name"))


def latest_by_model(paths: DataFrame) -> DataFrame:
    """model, path: the lexicographically last file of each model's folder."""
    return paths.withColumn("model", F.element_at(F.split("path", "/"), -2)).groupBy("model").agg(F.max("path").alias("path"))
