"""A trainable span detector: naive Bayes over features of tokens, in chunks, merged to spans.

A token's features are its word, its ends, its shape and its neighbours; its label is the
BIO tag of the gold spans.  Counting and scoring are those of ``scoring.NaiveBayes``, so
training is a group-by and prediction streams the tokens past the counts.

Defined results: texts that are null or blank have no tokens and get no span; a span's
confidence is the mean chance of its tokens' tags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans as S
from umbra.functions import text as T
from umbra.operators import spans as OS
from umbra.operators.scoring import NaiveBayes

SPAN = "struct<start:int,end:int,label:string,confidence:double>"


def features(tokens: Column) -> Column:
    """array<string>: the features of each token of an array, as words of one string."""
    at = lambda i: F.lower(F.coalesce(F.try_element_at(tokens, i)["text"], F.lit("edge")))
    clean = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "q")

    def of(token: Column, i: Column) -> Column:
        word = clean(F.lower(token["text"]))
        kind = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(token["text"], r"\p{Lu}", "u"), r"\p{Ll}", "l"), r"\p{N}", "9"), r"[^ul9]", "x")
        shape = F.regexp_replace(F.substring(kind, 1, 12), r"(.)\1+", "$1$1")
        before, after = F.when(i > 0, at(F.greatest(i, F.lit(1)))).otherwise("edge"), at(i + 2)
        return F.concat_ws(" ", F.concat(F.lit("w_"), word), F.concat(F.lit("s_"), shape), F.concat(F.lit("b_"), F.left(word, F.lit(3))), F.concat(F.lit("e_"), F.right(word, F.lit(3))), F.concat(F.lit("p_"), clean(before)), F.concat(F.lit("n_"), clean(after)), F.concat(F.lit("ps_"), shape, F.lit("_"), clean(before)))

    return F.transform(tokens, of)


def examples(records: DataFrame, key: str = "uid") -> DataFrame:
    """key, pos, start, end, name (the tag, where there are spans) and text (features) of every token."""
    found = records.withColumn("_t", T.tokens("text")).withColumn("_f", features(F.col("_t")))
    rows = found.select(key, F.posexplode(F.arrays_zip(F.col("_t").alias("t"), F.col("_f").alias("f"))).alias("pos", "z"))
    return rows.select(key, "pos", F.col("z.t.start").alias("start"), F.col("z.t.end").alias("end"), F.col("z.f").alias("text"))


def tagged(records: DataFrame, key: str = "uid") -> DataFrame:
    """The examples of records with gold ``spans`` (usable ones), with their tags under ``name``."""
    rows = examples(records, key)
    first = F.col("s.start")
    spans = records.select(key, F.explode(S.valid(F.col("spans"), F.col("text"))).alias("s")).select(key, first.alias("s_start"), F.col("s.end").alias("s_end"), F.regexp_replace("s.label", "^[BI]-", "").alias("label"))
    met = rows.join(spans, key).where(S.overlaps(F.col("start"), F.col("end"), F.col("s_start"), F.col("s_end")))
    best = met.groupBy(key, "pos").agg(F.min(F.struct("s_start", "s_end", "label")).alias("m"))
    marked = rows.join(best, [key, "pos"], "left")
    return marked.withColumn("name", F.when(F.col("m").isNull(), "O").otherwise(F.concat(F.when(F.col("start") <= F.col("m.s_start"), "B-").otherwise("I-"), F.coalesce("m.label", F.lit("ENTITY"))))).drop("m")


def train(records: DataFrame, key: str = "uid") -> NaiveBayes:
    """The detector: counts of features by tag."""
    return NaiveBayes(tagged(records, key))


def predict(model: NaiveBayes, records: DataFrame, key: str = "uid", threshold: float = 0.0) -> DataFrame:
    """The records with ``spans`` (start, end, label, confidence) that the detector finds."""
    rows = examples(records, key).withColumn("place", F.struct(F.col(key).alias("k"), "pos", "start", "end"))
    told = model.best(rows.withColumn("place", F.to_json("place")), "place")
    shape = f"k {dict(records.dtypes)[key]}, pos int, start int, end int"
    tags = told.withColumn("p", F.from_json("place", shape)).where("predicted <> 'O'").select(F.col("p.k").alias(key), "p.pos", "p.start", "p.end", F.substring("predicted", 3, 100).alias("label"), F.left("predicted", F.lit(2)).alias("tag"), F.col("chance").alias("confidence"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "label", "tag", "confidence")))
    grown = tags.groupBy(key).agg(_islands(ordered).alias("spans"))
    out = records.drop("spans").join(grown, key, "left")
    kept = F.filter("spans", lambda s: s["confidence"] >= threshold)
    return out.withColumn("spans", F.coalesce(kept, F.array().cast(f"array<{SPAN}>")))


def _islands(tags: Column) -> Column:
    """Spans of tags that follow each other with one label; a B- begins a new one."""
    zero = F.array().cast("array<struct<start:int,end:int,label:string,confidence:double,pos:int,n:int>>")

    def step(acc: Column, t: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        goes_on = (F.size(acc) > 0) & (t["tag"] == "I-") & (last["label"] == t["label"]) & (last["pos"] + 1 == t["pos"])
        n = last["n"] + 1
        longer = F.struct(last["start"].alias("start"), t["end"].alias("end"), t["label"].alias("label"), ((last["confidence"] * last["n"] + t["confidence"]) / n).alias("confidence"), t["pos"].alias("pos"), n.alias("n"))
        fresh = F.struct(t["start"].alias("start"), t["end"].alias("end"), t["label"].alias("label"), t["confidence"].alias("confidence"), t["pos"].alias("pos"), F.lit(1).alias("n"))
        return F.when(goes_on, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(fresh)))

    return F.transform(F.aggregate(tags, zero, step), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["confidence"].alias("confidence")))


def in_chunks(records: DataFrame, find: Callable[[DataFrame], DataFrame], size: int, overlap: int = 0, key: str = "uid") -> DataFrame:
    """key, spans: ``find`` (records of ``chunk`` and text to records with spans) applied to windows of a text, shifted to the text and merged.

    Spans found in several chunks are merged as ``spans.merge_chunks`` states.
    """
    held = records.where(F.length("text") > 0).select(key, F.posexplode(T.sliding(F.col("text"), size, overlap)).alias("no", "c"))
    chunks = held.select(F.to_json(F.struct(F.col(key).alias("k"), "no", F.col("c.start").alias("at"))).alias("chunk"), F.col("c.text").alias("text"))
    found = find(chunks).select("chunk", F.explode("spans").alias("s")).withColumn("p", F.from_json("chunk", f"k {dict(records.dtypes)[key]}, no int, at int"))
    confidence = F.col("s.confidence") if "confidence" in str(found.schema["s"].dataType) else F.lit(None).cast("double")
    moved = found.select(F.col("p.k").alias(key), "p.no", (F.col("s.start") + F.col("p.at")).alias("start"), (F.col("s.end") + F.col("p.at")).alias("end"), F.col("s.label").alias("label"), confidence.alias("confidence"))
    grouped = moved.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("no", "start", "end", "label", "confidence"))).alias("all"))
    return grouped.select(key, S.merge_chunks(F.col("all")).alias("spans"))


def gazetteer(records: DataFrame, names: DataFrame, key: str = "uid") -> DataFrame:
    """key, spans of tokens that are names (columns name, label), joined by word; a run of names of one label is one span."""
    tokens = OS.tokens_of(records, key)
    met = tokens.join(names.where("name IS NOT NULL").groupBy(F.col("name").alias("text")).agg(F.min("label").alias("label")), "text")
    rows = met.select(key, "pos", "start", "end", "label", F.lit("I-").alias("tag"), F.lit(1.0).alias("confidence"))
    return rows.groupBy(key).agg(_islands(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "label", "tag", "confidence")))).alias("spans"))
