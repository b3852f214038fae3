"""Attack model, ranks and explanations.

The attack model is multinomial naive Bayes over words with one label for each identity.
Its word counts come in blocks of labels of at most ``BLOCK_CELLS`` cells, which is what is
sent to a worker at a time; records are streamed past a block without a shuffle, and only
what is asked of the scores (the best label, a rank, sums) becomes rows, never a row for
each record and label.  More blocks mean more passes over the records.

Ties in a rank go to the greater label, everywhere; scores that differ by less than
``TIE`` are a tie, for sums of logarithms depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.operators.records import numbered
from umbra.session import cut

ALPHA = 1.0
BLOCK_CELLS = 4_000_000  # label and word pairs of a block
TIE = 1e-9


def label_ids(records: DataFrame, name: str = "name") -> DataFrame:
    """name, id: distinct names in order, numbered from 0."""
    names = records.where(F.col(name).isNotNull()).select(F.col(name).alias("name")).distinct()
    return numbered(names, ["name"], "id").withColumn("id", F.col("id").cast("int"))


def label_number(label):
    """The number after the last underscore of a label; null if there is none."""
    return F.try_to_number(F.nullif(F.regexp_extract(label, r"_([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("int")


def mapping_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Labels that only one of two mappings has, with the side that has them."""
    left, right = a.select("name").distinct(), b.select("name").distinct()
    return left.exceptAll(right).withColumn("side", F.lit("first")).unionByName(right.exceptAll(left).withColumn("side", F.lit("second")))


def word_counts(records: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, word, n: the words of each record with their counts (made in the record, without a shuffle of single words)."""
    return records.select(*keep, F.explode(T.words(F.col(text))).alias("word")).groupBy(*keep, "word").agg(F.count("*").alias("n"))


class Block:
    """Labels in order with their log gains by word hash, as compressed sparse rows."""

    def __init__(self, labels: list[str], prior: np.ndarray, unseen: np.ndarray, cells: pd.DataFrame):
        self.labels, self.prior, self.unseen = labels, prior, unseen
        order = np.argsort(cells["word"].to_numpy(), kind="stable")
        words = cells["word"].to_numpy()[order]
        self.words, first = np.unique(words, return_index=True)
        self.bounds = np.append(first, len(words))
        self.label_at = cells["label"].to_numpy()[order]
        self.gain = np.log(cells["c"].to_numpy(float)[order] + ALPHA) - np.log(ALPHA)

    def cells(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``words``, label, gain) of every cell of distinct words."""
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        held = np.flatnonzero(self.words[at] == words) if len(self.words) else np.zeros(0, int)
        low, high = self.bounds[at[held]], self.bounds[at[held] + 1]
        sizes = high - low
        places = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.repeat(held, sizes), self.label_at[places], self.gain[places]

    def scores(self, words: np.ndarray) -> np.ndarray:
        """Score of each label for the word hashes of a text."""
        distinct, counts = np.unique(words, return_counts=True)
        word, label, gain = self.cells(distinct)
        return self.prior + len(words) * self.unseen + np.bincount(label, weights=counts[word] * gain, minlength=len(self.labels))

    def better(self, scores: np.ndarray, own: float, name: str) -> int:
        """Labels other than ``name`` that stand before it."""
        ahead = scores > own + TIE
        ties = np.flatnonzero(np.abs(scores - own) <= TIE)
        return int(ahead.sum()) - (name in self.place and bool(ahead[self.place[name]])) + sum(self.labels[at] > name for at in ties)

    @property
    def place(self) -> dict[str, int]:
        if not hasattr(self, "_place"):
            self._place = {name: at for at, name in enumerate(self.labels)}
        return self._place


def hashed(text: Column) -> Column:
    """array<long>: hashes of a text's words."""
    return F.coalesce(F.transform(T.words(text), lambda w: F.xxhash64(w)), F.array().cast("array<bigint>"))


def _array(value) -> np.ndarray:
    return np.zeros(0, np.int64) if value is None else np.asarray(value, dtype=np.int64)


class NaiveBayes:
    """Counts of words by label, and what scoring needs of them."""

    def __init__(self, records: DataFrame, label: str = "name", text: str = "text"):
        known = records.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("text"))
        self.by_label = known.select("label", F.explode(T.words(F.col("text"))).alias("word")).groupBy("label", "word").agg(F.count("*").alias("c"))
        totals = self.by_label.groupBy("label").agg(F.sum("c").alias("total"), F.count("*").alias("cells"))
        size = self.by_label.agg(F.countDistinct("word").alias("v"))
        documents = known.groupBy("label").agg(F.count("*").alias("docs"))
        whole = documents.agg(F.sum("docs").alias("all_docs"))
        # one row for each label: as many as there are identities
        self.labels = documents.join(totals, "label").crossJoin(size).crossJoin(whole).select(
            "label", F.log(F.col("docs") / F.col("all_docs")).alias("prior"), (F.log(F.lit(ALPHA)) - F.log(F.col("total") + ALPHA * F.col("v"))).alias("unseen"), "cells"
        )
        self._blocks: list | None = None

    def save(self, folder: str) -> None:
        """Writes the counts and the labels."""
        self.by_label.write.mode("overwrite").parquet(f"{folder}/counts")
        self.labels.write.mode("overwrite").parquet(f"{folder}/labels")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "NaiveBayes":
        """A model that ``save`` wrote."""
        made = cls.__new__(cls)
        made.by_label, made.labels, made._blocks = spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/labels"), None
        return made

    def blocks(self) -> list:
        """Broadcasts of the blocks; labels in order, as many to a block as fit."""
        if self._blocks is None:
            counts = cut(self.by_label.select("label", F.xxhash64("word").alias("word"), "c"))
            rows = self.labels.orderBy("label").toPandas()  # one row for each identity
            part = ((rows["cells"].cumsum() - rows["cells"]) // BLOCK_CELLS).to_numpy(int) if len(rows) else np.zeros(0, int)
            self._blocks = []
            for number in np.unique(part):
                own = rows[part == number].reset_index(drop=True)
                held = counts.where((F.col("label") >= own["label"].iloc[0]) & (F.col("label") <= own["label"].iloc[-1])).toPandas()
                held["label"] = np.searchsorted(own["label"].to_numpy(str), held["label"].to_numpy(str)) if len(held) else held["label"]
                held["label"] = held["label"].astype(int)
                self._blocks.append(counts.sparkSession.sparkContext.broadcast(Block(own["label"].tolist(), own["prior"].to_numpy(), own["unseen"].to_numpy(), held)))
        return self._blocks

    def _each(self, rows: DataFrame, use, schema: str) -> DataFrame:
        """``use(block, batch)`` of every block, as one DataFrame."""
        out = None
        for sent in self.blocks():

            def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    yield use(sent.value, batch)

            part = rows.mapInPandas(scan, schema)
            out = part if out is None else out.unionByName(part)
        return out if out is not None else rows.sparkSession.createDataFrame([], schema)

    def scores(self, records: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, label, score of every record and label: for small sets; the other methods need no such rows."""
        kind = dict(records.dtypes)[key]

        def use(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
            n = len(block.labels)
            found = [block.scores(_array(w)) for w in batch["words"]]
            return pd.DataFrame({key: np.repeat(batch[key].to_numpy(), n), "label": block.labels * len(batch), "score": np.concatenate(found) if found else np.zeros(0)})

        return self._each(records.select(key, hashed(F.col(text)).alias("words")), use, f"{key} {kind}, label string, score double")

    def best(self, records: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, predicted, score, chance: each record's best label (ties to the greater) and its share of the soft-max."""
        kind = dict(records.dtypes)[key]

        def use(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for uid, held in zip(batch[key], batch["words"]):
                found = block.scores(_array(held))
                at = int(np.flatnonzero(found >= found.max() - TIE)[-1])
                rows.append((uid, block.labels[at], float(found[at]), float(np.exp(found - found[at]).sum())))
            return pd.DataFrame(rows, columns=[key, "predicted", "score", "z"])

        each = self._each(records.select(key, hashed(F.col(text)).alias("words")), use, f"{key} {kind}, predicted string, score double, z double")
        if len(self.blocks()) > 1:
            held = each.groupBy(key).agg(F.max(F.struct("score", "predicted")).alias("b"), F.collect_list(F.struct("score", "z")).alias("all"))
            z = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["z"] * F.exp(x["score"] - F.col("b.score")))
            each = held.select(key, F.col("b.predicted").alias("predicted"), F.col("b.score").alias("score"), z.alias("z"))
        return each.select(key, "predicted", "score", (1 / F.col("z")).alias("chance"))

    def ranks(self, records: DataFrame, key: str, label: str = "name", text: str = "text") -> DataFrame:
        """key, rank of the record's own label, 1 the best.  Records without a label, or with one unknown to the model, are left out."""
        kind = dict(records.dtypes)[key]
        rows = records.where(F.col(label).isNotNull()).select(key, F.col(label).alias("label"), hashed(F.col(text)).alias("words"))
        alone = len(self.blocks()) == 1

        def own(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
            out = []
            for uid, name, held in zip(batch[key], batch["label"], batch["words"]):
                if name in block.place:
                    found = block.scores(_array(held))
                    score = float(found[block.place[name]])
                    out.append((uid, score, block.better(found, score, name) if alone else 0))
            return pd.DataFrame(out, columns=[key, "own", "ahead"])

        first = self._each(rows, own, f"{key} {kind}, own double, ahead long")
        if alone:
            return first.select(key, (F.col("ahead") + 1).alias("rank"))

        def count(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
            ahead = [block.better(block.scores(_array(w)), score, name) for w, score, name in zip(batch["words"], batch["own"], batch["label"])]
            return pd.DataFrame({key: batch[key], "ahead": ahead})

        counted = self._each(rows.join(first.select(key, "own"), key), count, f"{key} {kind}, ahead long")
        return counted.groupBy(key).agg((F.sum("ahead") + 1).alias("rank"))

    def summed(self, records: DataFrame, label: str = "name", text: str = "text") -> DataFrame:
        """true_label, label, score: scores summed over the records of each true label, before the shuffle in each batch."""
        rows = records.where(F.col(label).isNotNull()).select(F.col(label).alias("true_label"), hashed(F.col(text)).alias("words"))

        def use(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
            held: dict[str, np.ndarray] = {}
            for name, words in zip(batch["true_label"], batch["words"]):
                found = block.scores(_array(words))
                held[name] = held[name] + found if name in held else found
            n = len(block.labels)
            return pd.DataFrame({"true_label": np.repeat(list(held), n), "label": block.labels * len(held), "score": np.concatenate([*held.values()]) if held else np.zeros(0)})

        return self._each(rows, use, "true_label string, label string, score double").groupBy("true_label", "label").agg(F.sum("score").alias("score"))


def ranks(scores: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """key, rank of the true label among given scores, 1 the best.  Records without their label in the scores are left out.

    Counted against the true label's score, so nothing is sorted.
    """
    own = scores.join(truth.select(key, F.col("label")), [key, "label"]).select(key, F.col("label").alias("true_label"), F.col("score").alias("true_score"))
    better = (F.col("score") > F.col("true_score")) | (F.col("score") == F.col("true_score")) & (F.col("label") > F.col("true_label"))
    return scores.join(own, key).groupBy(key).agg((F.sum(better.cast("long")) + 1).alias("rank"))


def rank_deltas(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, rank before and after, and the difference; above 0 is better hidden."""
    return before.select(key, F.col("rank").alias("before")).join(after.select(key, F.col("rank").alias("after")), key).withColumn("delta", F.col("after") - F.col("before"))


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """count, mean, median, min, max, and how many rose, fell and stayed."""
    x = F.col(value)
    aggs = [F.count(value).alias("count"), F.round(F.avg(value), 6).alias("mean"), F.median(value).alias("median"), F.min(value).alias("min"), F.max(value).alias("max"),
            F.count_if(x > 0).alias("improved"), F.count_if(x < 0).alias("degraded"), F.count_if(x == 0).alias("unchanged")]
    return rows.groupBy(*(by or [])).agg(*aggs)


def top_labels(scores: DataFrame, key: str) -> DataFrame:
    """key and its best label."""
    return scores.groupBy(key).agg(F.max(F.struct("score", "label")).alias("b")).select(key, F.col("b.label").alias("predicted"), F.col("b.score").alias("score"))


def accuracy(predicted: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """accuracy, correct, total over records with a known label and a score."""
    met = predicted.join(truth.where("label IS NOT NULL"), key)
    correct = F.count_if(F.col("predicted") == F.col("label"))
    return met.agg(F.coalesce(F.round(correct / F.nullif(F.count("*"), F.lit(0)), 6), F.lit(0.0)).alias("accuracy"), correct.alias("correct"), F.count("*").alias("total"))


def individual_accuracy(summed: DataFrame) -> DataFrame:
    """true_label, predicted: the best label of the scores summed over the records of each true label."""
    return summed.groupBy("true_label").agg(F.max(F.struct("score", "label")).alias("b")).select("true_label", F.col("b.label").alias("predicted"))


def merge_max(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The greatest chance for each label over the chunks of a record; 0 where none is given."""
    return rows.groupBy(*keys).agg(F.coalesce(F.max(value), F.lit(0.0)).alias(value))


def merge_mean(rows: DataFrame, key: str, label: str, value: str, chunk: str) -> DataFrame:
    """The sum of a label's chances over the number of the record's chunks, so a missing label counts as 0."""
    chunks = rows.groupBy(key).agg(F.countDistinct(chunk).alias("n_chunks"))
    return rows.groupBy(key, label).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("s")).join(chunks, key).select(key, label, F.round(F.col("s") / F.col("n_chunks"), 6).alias(value))


def exact_mean(value: str) -> Column:
    """The mean of numbers as they are written, summed as decimals so that it is the same in any order; the mean of the doubles where one is NaN, infinite or above 1e10."""
    written = F.col(value).try_cast("decimal(28,18)")
    return F.when(F.count(written) == F.count(value), F.avg(written).cast("double")).otherwise(F.avg(value))


def rounded(number: Column, places: int) -> Column:
    """Rounded by way of the scaled double, as SQL engines do; ``round`` goes by the shortest decimal form."""
    return F.round(number * F.lit(10.0**places)) / F.lit(10.0**places)


def top_k(found: DataFrame, ks: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Extension: share of records whose true label is among the best k, and the mean reciprocal rank."""
    return found.agg(*[F.round(F.avg((F.col("rank") <= k).cast("double")), 6).alias(f"top_{k}") for k in ks], F.round(F.avg(1 / F.col("rank")), 6).alias("mrr"))


def _masked_chances(block: Block, words: np.ndarray, target: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By distinct word with one occurrence of it masked: greatest score, sum of exp below it, and the target's score (-inf if elsewhere)."""
    found = block.scores(words)
    distinct = np.unique(words)
    lost = np.tile(block.unseen, (len(distinct), 1))
    word, label, gain = block.cells(distinct)
    np.add.at(lost, (word, label), gain)
    left = found[None, :] - lost
    top = left.max(axis=1)
    own = left[:, block.place[target]] if target in block.place else np.full(len(distinct), -np.inf)
    return top, np.exp(left - top[:, None]).sum(axis=1), own


def explain(model: NaiveBayes, records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, score: chance of the best label less its chance with one occurrence of the word masked."""
    kind = dict(records.dtypes)[key]
    best = model.best(records, key, text).select(key, "predicted", "chance")
    rows = records.select(key, T.words(F.col(text)).alias("plain"), hashed(F.col(text)).alias("words")).join(best, key)

    def use(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for uid, plain, held, target, chance in zip(batch[key], batch["plain"], batch["words"], batch["predicted"], batch["chance"]):
            words = _array(held)
            if not len(words):
                continue
            _, first = np.unique(words, return_index=True)
            top, z, own = _masked_chances(block, words, target)
            out += [(uid, plain[at], chance, *x) for at, *x in zip(first, top.tolist(), z.tolist(), own.tolist())]
        return pd.DataFrame(out, columns=[key, "word", "chance", "top", "z", "own"])

    each = model._each(rows, use, f"{key} {kind}, word string, chance double, top double, z double, own double")
    if len(model.blocks()) > 1:
        held = each.groupBy(key, "word", "chance").agg(F.max("top").alias("m"), F.max("own").alias("own"), F.collect_list(F.struct("top", "z")).alias("all"))
        each = held.select(key, "word", "chance", F.col("m").alias("top"), F.aggregate("all", F.lit(0.0), lambda a, x: a + x["z"] * F.exp(x["top"] - F.col("m"))).alias("z"), "own")
    masked = F.exp(F.col("own") - F.col("top")) / F.col("z")
    return each.select(key, "word", F.round(F.col("chance") - masked, 9).alias("score"))


def shapley(model: NaiveBayes, records: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, score: Shapley values of the words for the log-odds of the best label against the mean of all.

    The scores are linear in the word counts, so a word's value is closed: its count times
    its gain for the label, less the mean gain over labels, less the same of its expected
    count in the records (each word of the model at its mean count of all records).
    """
    kind = dict(records.dtypes)[key]
    n_labels = sum(len(sent.value.labels) for sent in model.blocks())
    n_records = records.count()
    expected = model.by_label.groupBy(F.xxhash64("word").alias("hash")).agg((F.sum("c") / F.lit(float(max(n_records, 1)))).alias("expected"))
    best = model.best(records, key, text).select(key, "predicted")
    rows = records.select(key, T.words(F.col(text)).alias("plain"), hashed(F.col(text)).alias("words")).join(best, key)

    def use(block: Block, batch: pd.DataFrame) -> pd.DataFrame:
        out = []
        for uid, plain, held, target in zip(batch[key], batch["plain"], batch["words"], batch["predicted"]):
            distinct, first, counts = np.unique(_array(held), return_index=True, return_counts=True)
            word, label, gain = block.cells(distinct)
            total = np.bincount(word, weights=gain, minlength=len(distinct))
            own = np.bincount(word[label == block.place.get(target, -1)], weights=gain[label == block.place.get(target, -1)], minlength=len(distinct))
            out += [(uid, plain[at], int(h), int(n), float(o), float(t)) for at, h, n, o, t in zip(first, distinct, counts, own, total)]
        return pd.DataFrame(out, columns=[key, "word", "hash", "n", "own", "total"])

    each = model._each(rows, use, f"{key} {kind}, word string, hash long, n long, own double, total double")
    whole = each.groupBy(key, "word", "hash", "n").agg(F.sum("own").alias("own"), F.sum("total").alias("total"))
    contrast = F.col("own") - F.col("total") / F.lit(float(max(n_labels, 1)))
    return whole.join(expected, "hash", "left").select(key, "word", F.round(contrast * (F.col("n") - F.coalesce("expected", F.lit(0.0))), 6).alias("score"))
