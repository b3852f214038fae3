"""Greedy k-anonymous masking against the attack model.

Masking never looks at k: k only says when to stop.  So one trace of steps is computed for
each record up to the greatest k, and every k reads off its own stop.  A step masks the
term whose masking (all its instances) lowers the chance of the true label most; a term
replaces the best so far only if its drop is greater by more than 1e-12, so the first one
in the text wins ties.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.operators.scoring import NaiveBayes, hashed


def greedy(scores: np.ndarray, target: int, loss: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(term masked, rank after it) of each step; the first entry is (-1, rank before any).

    ``scores`` by label in order of the labels, ``loss`` [term, label] what masking a term
    takes from each score.
    """

    def rank(s: np.ndarray) -> int:
        return int(1 + (s > s[target]).sum() + ((s == s[target]) & (np.arange(len(s)) > target)).sum())

    def chance(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=-1, keepdims=True))
        return e[..., target] / e.sum(axis=-1)

    trace = [(-1, rank(scores))]
    left = list(range(len(loss)))
    current = scores.astype(float)
    while trace[-1][1] < most and left:
        drops = chance(current) - chance(current - loss[left])
        best, at = -np.inf, 0
        for place in np.flatnonzero(drops >= drops.max() - 1e-11):  # only these can win
            if drops[place] > best + 1e-12:
                best, at = drops[place], place
        term = left.pop(int(at))
        current = current - loss[term]
        trace.append((term, rank(current)))
    return trace


MAX_BLOCKS = 16
_TRACE = "step int, word string, rank int"


def trace(model: NaiveBayes, records: DataFrame, key: str, label: str, most: int, ignored: tuple[str, ...] = ()) -> DataFrame:
    """key, step, word, rank: the greedy trace of every record with a known label, up to rank ``most``.

    The blocks of the model are sent to the workers; a record is handled where it lies,
    nothing is shuffled.  A trace needs every label at once, so all blocks together must
    fit a worker: more than ``MAX_BLOCKS`` are an error.
    """
    blocks = model.blocks()
    if len(blocks) > MAX_BLOCKS:
        raise ValueError(f"a trace needs the whole model on a worker; it has {len(blocks)} blocks, {MAX_BLOCKS} are allowed")
    kind = dict(records.dtypes)[key]
    rows = records.where(F.col(label).isNotNull()).select(key, F.col(label).alias("label"), T.words(F.col("text")).alias("words"), hashed(F.col("text")).alias("hashes"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [sent.value for sent in blocks]
        labels = [name for part in parts for name in part.labels]
        place = {name: at for at, name in enumerate(labels)}
        unseen = np.concatenate([part.unseen for part in parts]) if parts else np.zeros(0)
        priors = np.concatenate([part.prior for part in parts]) if parts else np.zeros(0)
        for batch in batches:
            out = []
            for uid, own, words, hashes in zip(batch[key], batch["label"], batch["words"], batch["hashes"]):
                if own not in place or words is None or not len(words):
                    continue
                distinct, first, counts = np.unique(np.asarray(hashes, dtype=np.int64), return_index=True, return_counts=True)
                order = np.argsort(first)
                loss = np.tile(unseen, (len(distinct), 1))
                begin = 0
                for part in parts:
                    word, at, gain = part.cells(distinct)
                    np.add.at(loss, (word, at + begin), gain)
                    begin += len(part.labels)
                loss = (loss * counts[:, None])[order]
                terms = [words[at] for at in first[order]]
                free = [at for at, term in enumerate(terms) if term not in ignored]
                steps = greedy(priors + loss.sum(axis=0), place[own], loss[free], most)
                out += [(uid, step, terms[free[term]] if term >= 0 else None, rank) for step, (term, rank) in enumerate(steps)]
            yield pd.DataFrame(out, columns=[key, "step", "word", "rank"])

    return rows.mapInPandas(scan, f"{key} {kind}, {_TRACE}")


def grid(traced: DataFrame, key: str, ks: tuple[int, ...]) -> DataFrame:
    """key, k, step, rank, words: for each k the first step whose rank reaches it, else the last one."""
    # a record's trace is one short array, so every k is read off in the same pass
    steps = traced.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "rank", "word"))).alias("t"))
    each = steps.select(key, "t", F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k"))
    reached = F.try_element_at(F.filter("t", lambda x: x["rank"] >= F.col("k")), F.lit(1))
    stopped = each.select(key, "k", "t", F.coalesce(reached, F.element_at("t", -1)).alias("s"))
    words = F.transform(F.filter("t", lambda x: (x["step"] <= F.col("s.step")) & x["word"].isNotNull()), lambda x: x["word"])
    return stopped.select(key, "k", F.col("s.step").alias("step"), F.col("s.rank").alias("rank"), words.alias("words"))
