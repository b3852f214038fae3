"""Differentially private token perturbation by the exponential mechanism.

A token is redrawn from the words that follow its left neighbour in a public corpus (from
all its words where the neighbour is not known there).  A word's score is the logarithm of
how often it does, rounded down to quarter nats and clipped, so a neighbour has at most
``LEVELS`` different scores; a word is drawn with probability proportional to
exp(score / T), T = 2 * range / epsilon.  The corpus is a parameter: only counts of a corpus
other than the protected texts give a token's epsilon its meaning.

A token's budget is epsilon * ratio / (weight * n) over the n tokens of its record that may
be redrawn: those that overlap sensitive spans, or all where the record has no such span.

Draws come from hashes of the token's place, so they do not depend on partitioning.  A draw
picks a score first (a neighbour's scores are one short array), then a place among the
words of that score; words are numbered over all neighbours by range partition, so neither
a frequent neighbour nor a frequent word fills a task.

Defined results: null and blank texts give no tokens; punctuation stays; the last token is
never deleted; an empty corpus leaves tokens as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import sampling
from umbra.functions import text as T
from umbra.functions.spans import overlaps
from umbra.operators.records import numbered
from umbra.session import cut

SCORE_CLIP = (0.0, 8.0)
STEP = 0.25
LEVELS = int((SCORE_CLIP[1] - SCORE_CLIP[0]) / STEP) + 1
ANY = "*"  # stands for a neighbour that the corpus does not know; no word


def tokens_with_left(records: DataFrame, key: str, *keep: str) -> DataFrame:
    """key, pos, start, end, token, left, n_all and kept columns: tokens with the word before them in small letters."""
    found = records.select(key, *keep, T.tokens("text").alias("t"))
    left = lambda i: F.when(i > 0, F.lower(F.col("t")[i - 1]["text"])).otherwise("")
    # the neighbour is looked up before the rows are made, so no row carries the whole text's tokens
    paired = F.transform("t", lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("token"), left(i).alias("left")))
    return found.select(key, *keep, F.size("t").alias("n_all"), F.posexplode(paired).alias("pos", "p")).select(key, *keep, "n_all", "pos", "p.start", "p.end", "p.token", "p.left")


def candidates(public: DataFrame) -> DataFrame:
    """left, word, level: the words seen after each word of a corpus (column text), and all words after ANY."""
    words = tokens_with_left(public.select(F.lit(0).alias("k"), "text"), "k").where(~T.is_punctuation(F.col("token")))
    counted = words.groupBy("left", F.lower("token").alias("word")).agg(F.count("*").alias("n"))
    every = counted.groupBy("word").agg(F.sum("n").alias("n")).select(F.lit(ANY).alias("left"), "word", "n")
    score = sampling.clamp(F.log("n"), *SCORE_CLIP)
    return counted.unionByName(every).select("left", "word", F.floor(score / STEP + 1e-9).cast("int").alias("level"))


class Candidates:
    """``words``: place and word, numbered in order of neighbour, level and word; ``levels``: for each neighbour its levels with their first place and size."""

    def __init__(self, public: DataFrame):
        placed = cut(numbered(candidates(public), ["left", "level", "word"], "place"))
        self.words = placed.select("place", "word")
        groups = placed.groupBy("left", "level").agg(F.min("place").alias("first"), F.count("*").alias("size"))
        self.levels = cut(groups.groupBy("left").agg(F.array_sort(F.collect_list(F.struct("level", "first", "size"))).alias("levels")))

    def draw(self, rows: DataFrame, heat: Column, place: Column, seed: int, name: str) -> DataFrame:
        """``rows`` (with a column left) and a drawn word under ``name``; null where there is no candidate.

        ``heat`` is the temperature, ``place`` the text that the draw is hashed from.
        """
        known = rows.join(self.levels, "left", "left")
        anyone = self.levels.where(F.col("left") == ANY).select(F.col("levels").alias("_any"))  # one row
        known = known.crossJoin(F.broadcast(anyone)) if not anyone.isEmpty() else known.withColumn("_any", F.col("levels"))
        held = known.withColumn("_l", F.coalesce("levels", "_any")).drop("levels", "_any")
        held = held.withColumn("_heat", heat).withColumn("_u", sampling.uniform(place, seed)).withColumn("_v", sampling.uniform(place, seed + 1))
        top = F.element_at("_l", -1)["level"]  # taken off before the exponential
        weights = F.transform("_l", lambda x: x["size"] * F.exp((x["level"] - top) * STEP / F.col("_heat")))
        held = held.withColumn("_w", weights).withColumn("_cut", F.col("_u") * F.aggregate("_w", F.lit(0.0), lambda a, w: a + w))
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
        step = lambda a, w: F.when(a["sum"] + w <= F.col("_cut"), F.struct((a["sum"] + w).alias("sum"), (a["n"] + 1).alias("n"))).otherwise(F.struct((a["sum"] + F.lit(1e300)).alias("sum"), a["n"].alias("n")))
        at = F.aggregate("_w", zero, step)["n"]
        chosen = F.try_element_at("_l", F.least(at, F.size("_l") - 1) + 1)
        wanted = held.withColumn("_c", chosen).withColumn("_place", F.col("_c.first") + F.least(F.floor(F.col("_v") * F.col("_c.size")), F.col("_c.size") - 1))
        drawn = wanted.drop("_l", "_heat", "_u", "_v", "_w", "_cut", "_c")
        return drawn.join(self.words.select(F.col("place").alias("_place"), F.col("word").alias(name)), "_place", "left").drop("_place")


def budgets(records: DataFrame, key: str, epsilon: float, sensitive: str | None = None, weights: Column | None = None, heat: float = 1.0, compensate: bool = False) -> DataFrame:
    """Tokens (as ``tokens_with_left``) with ``free`` (may be redrawn) and ``epsilon`` of each.

    ``sensitive`` names an array of spans; only tokens that overlap one are free, all if it
    is null or empty.  Punctuation is never free.  ``weights`` is a score of a token (an
    expression over token, left, pos), made to weights by a soft-max at ``heat`` over the
    free tokens of the record; without it all weigh the same, and each has epsilon times
    the ratio.  The ratio is 1, or with ``compensate`` free over all tokens that are no
    punctuation (at least 1e-6).
    """
    keep = [sensitive] if sensitive else []
    found = tokens_with_left(records, key, *keep)
    plain = ~T.is_punctuation(F.col("token"))
    met = F.exists(sensitive, lambda s: overlaps(F.col("start"), F.col("end"), s["start"], s["end"])) | (F.size(sensitive) == 0) | F.col(sensitive).isNull() if sensitive else F.lit(True)
    marked = found.withColumn("free", plain & met).drop(*keep)
    if weights is None and not compensate:
        return marked.withColumn("epsilon", F.when(F.col("free"), F.lit(float(epsilon))))
    # sums by record, aggregated before the shuffle; the greatest score is taken off first
    scored = marked.withColumn("_s", F.when(F.col("free"), (weights if weights is not None else F.lit(0.0)) / heat))
    tops = scored.groupBy(key).agg(F.max("_s").alias("_top"), F.count_if("free").alias("_n"), F.count_if(plain).alias("_all"))
    shifted = scored.join(tops, key).withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    sums = shifted.groupBy(key).agg(F.sum("_e").alias("_z"))
    ratio = F.greatest(F.col("_n") / F.col("_all"), F.lit(1e-6)) if compensate else F.lit(1.0)
    return shifted.join(sums, key).withColumn("epsilon", F.when(F.col("free"), epsilon * ratio / (F.col("_e") / F.col("_z") * F.col("_n")))).drop("_s", "_top", "_n", "_all", "_e", "_z")


def perturb(
    records: DataFrame, key: str, epsilon: float, public: DataFrame, seed: int = 7, sensitive: str | None = None, weights: Column | None = None, heat: float = 1.0, compensate: bool = False, add: float = 0.0, delete: float = 0.0
) -> DataFrame:
    """key, pos, start, end, token, private, added, free: what stands in each token's place.

    ``private`` is the drawn word in the case of the original, null where the token is
    deleted; ``added`` a word put behind it, drawn after the private word.  ``add`` and
    ``delete`` are probabilities of free tokens; the last token is not deleted.
    """
    found = budgets(records, key, epsilon, sensitive, weights, heat, compensate)
    corpus = Candidates(public)
    place = F.concat_ws(":", F.col(key).cast("string"), "pos")
    span = 2 * (SCORE_CLIP[1] - SCORE_CLIP[0])
    drawn = corpus.draw(found.where("free"), F.lit(span) / F.col("epsilon"), place, seed, "word")
    private = F.when(F.col("word").isNull(), F.col("token")).otherwise(T.transfer_case(F.col("word"), F.col("token")))
    gone = (sampling.uniform(place, seed + 2) < delete) & (F.col("pos") < F.col("n_all") - 1)
    changed = drawn.select(key, "pos", "epsilon", "n_all", F.when(~gone, private).alias("_private"), (sampling.uniform(place, seed + 3) < add).alias("_more"))
    if add > 0:
        more = corpus.draw(changed.where("_more").withColumn("left", F.lower(F.coalesce("_private", F.lit("")))), F.lit(span) / F.col("epsilon"), place, seed + 4, "_added").select(key, "pos", "_added")
        changed = changed.join(more, [key, "pos"], "left")
    else:
        changed = changed.withColumn("_added", F.lit(None).cast("string"))
    joined = found.join(changed.select(key, "pos", "_private", "_added"), [key, "pos"], "left")
    return joined.select(key, "pos", "start", "end", "token", F.when(F.col("free"), F.col("_private")).otherwise(F.col("token")).alias("private"), F.col("_added").alias("added"), "free")


def rewrite(records: DataFrame, perturbed: DataFrame, key: str) -> DataFrame:
    """key, text put together from the original's gaps and the private tokens, and the counts of perturbed, total (deleted ones left out), added and deleted tokens.

    A deleted token takes the gap before it along; an added one stands behind a blank.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "start", "end", "private", "added")))
    counts = [F.count_if(F.col("private").isNotNull()).alias("n_tokens"), F.count_if(F.col("token") != F.col("private")).alias("n_perturbed"), F.count("added").alias("n_added"), F.count_if(F.col("private").isNull()).alias("n_deleted")]
    by_record = perturbed.groupBy(key).agg(ordered.alias("t"), *counts)
    rows = records.select(key, "text").join(by_record, key, "left")
    gap = lambda i: F.substring(F.col("text"), F.when(i > 0, F.col("t")[i - 1]["end"]).otherwise(0) + 1, F.col("t")[i]["start"] - F.when(i > 0, F.col("t")[i - 1]["end"]).otherwise(0))
    more = lambda x: F.when(x["added"].isNotNull(), F.concat(F.lit(" "), x["added"])).otherwise("")
    pieces = F.transform("t", lambda x, i: F.concat(F.when(x["private"].isNotNull(), F.concat(gap(i), x["private"])).otherwise(""), more(x)))
    tail = F.substring(F.col("text"), F.element_at("t", -1)["end"] + 1, F.length("text"))
    text = F.when(F.col("t").isNull(), F.when(F.trim("text") == "", "").otherwise(F.col("text"))).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return rows.select(key, text.alias("text"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_tokens", "n_perturbed", "n_added", "n_deleted")])
