"""Consensus from several annotators' marks (problem 1).

Method: regularised minimax conditional entropy.  The probability that annotator i gives
label c to mention j of true label k is a soft-max of an annotator tilting s_i(k, c) plus a
mention tilting t_j(k, c).  Both are fitted by regularised dual coordinate ascent in turn
with the posteriors of the true labels: one pass over the mentions forms the posteriors
from the current tilting, takes the mentions' steps, and sums what the annotators' steps
need (expected label counts and the part of them the mention tilting explains); the
annotators' concave problems are then solved one by one.  Agreement is reported separately
and does not enter the fit.

Usable rows have 0 <= start < end <= length of the text of an existing record; rows of one
``ann_id`` count once.  Overlapping usable spans of a record form one mention, which is a
case if more than half of the record's annotators marked it.  Its span is the one marked
most often (ties: the earlier start, then the later end).

Scale: marks are brought down to distinct spans before anything is ordered by record, and
mentions with the same marks to one pattern with a weight, so a record or an annotator
with many rows costs no single task.  The annotators' parameters are sent to the workers
while there are at most ``BROADCAST_ANNOTATORS`` of them; beyond that they are joined.

Defined results: null labels and unknown ones mark a mention without a vote; a mention
nobody labelled has a null label; rows without uid or annotator are not usable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.session import cut

# The labels in the spelling of the results.
LABELS = ("PERSON", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "ORG", "DATETIME", "QUANTITY", "CODE")
K = len(LABELS)

ROUNDS = 8
ANNOTATOR_PENALTY = 0.5
MENTION_PENALTY = 4.0
MENTION_STEPS = 2
FIRST_TRUST = 0.7  # chance of the right label before anything is known of an annotator
BROADCAST_ANNOTATORS = 50_000


def label_code(label: Column) -> Column:
    """Place of a label in LABELS whatever its spelling; null if it is none of them."""
    spelt = F.upper(F.regexp_replace(F.regexp_replace(label, r"^[\s_\-]+|[\s_\-]+$", ""), r"[\s_\-]+", "_"))
    at = F.array_position(F.array(*[F.lit(x) for x in LABELS]), spelt)
    return F.when(at > 0, (at - 1).cast("int"))


def spans(annotations: DataFrame, records: DataFrame) -> DataFrame:
    """uid, start, end, marks: the distinct usable spans with who gave them which label."""
    first = F.struct(F.col("received_at"), "uid", "annotator", "start", "end", label_code(F.col("label")).alias("label"))
    key = F.coalesce(F.col("ann_id").cast("long"), F.xxhash64("uid", "annotator", "start", "end", "label"))
    valid = annotations.where("uid IS NOT NULL AND annotator IS NOT NULL AND start >= 0 AND start < `end`")
    once = valid.groupBy(key.alias("ann")).agg(F.min(first).alias("r")).select("r.uid", "r.annotator", "r.start", "r.end", "r.label")
    marked = once.groupBy("uid", "start", "end").agg(F.collect_set(F.struct("annotator", F.coalesce("label", F.lit(-1)).alias("label"))).alias("marks"))
    lengths = records.where("uid IS NOT NULL AND text IS NOT NULL").groupBy("uid").agg(F.max(F.length("text")).alias("n"))
    return marked.join(lengths, "uid").where(F.col("end") <= F.col("n")).select("uid", "start", "end", "marks")


def mentions(found: DataFrame) -> DataFrame:
    """uid, mention, start, end, marks (annotator and label), n_marked, n_annotators, n_same_span of every mention."""
    annotators = found.select("uid", F.explode("marks.annotator").alias("annotator")).distinct().groupBy("uid").agg(F.count("*").alias("n_annotators"))
    ordered = Window.partitionBy("uid").orderBy("start", "end")
    reach = F.max("end").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    starts_new = F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0)
    numbered = found.withColumn("new", starts_new).withColumn("mention", F.sum("new").over(ordered))
    givers = F.size(F.array_distinct("marks.annotator"))
    # of the spans of a mention: most givers, then earlier start, then later end
    best = F.max(F.struct(givers.alias("n"), (-F.col("start")).alias("s"), F.col("end").alias("e")))
    grouped = numbered.groupBy("uid", "mention").agg(best.alias("best"), F.flatten(F.collect_list("marks")).alias("all"), F.sum((givers * (givers - 1)).cast("long")).alias("n_same_span"))
    voted = F.array_sort(F.array_distinct(F.filter("all", lambda m: m["label"] >= 0)))
    out = grouped.select("uid", "mention", (-F.col("best.s")).alias("start"), F.col("best.e").alias("end"), voted.alias("marks"), F.size(F.array_distinct("all.annotator")).alias("n_marked"), "n_same_span")
    return out.join(annotators, "uid")


def _log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def start_tilting() -> np.ndarray:
    """Annotator tilting before the first pass."""
    wrong = (1 - FIRST_TRUST) / (K - 1)
    return np.where(np.eye(K, dtype=bool), np.log(FIRST_TRUST), np.log(wrong)) - np.log(1 / K)


def posteriors(strength: np.ndarray, labels: np.ndarray, starts: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the true labels of each mention and probabilities [mark, true, given].

    ``strength`` is the exponential of each mark's annotator tilting, ``labels`` the given
    labels and ``starts`` the first mark of each mention.  The mention tilting starts at
    nothing and takes MENTION_STEPS damped Newton steps, each followed by new posteriors.
    """
    marks = np.arange(len(labels))
    sizes = np.diff(np.append(starts, len(labels)))
    mention_of = np.repeat(np.arange(len(starts)), sizes)
    given = np.bincount(mention_of * K + labels, minlength=len(starts) * K).reshape(-1, 1, K).astype(np.float32)
    tilt = np.zeros((len(starts), K, K), np.float32)
    prob = strength / strength.sum(axis=2, keepdims=True)
    for step in range(MENTION_STEPS + 1):
        said = np.log(np.maximum(prob[marks, :, labels], 1e-30))
        q = np.exp(_log_softmax(np.add.reduceat(said, starts, axis=0) + np.log(prior))).astype(np.float32)
        if step == MENTION_STEPS:
            return q, prob
        expected = np.add.reduceat(prob, starts, axis=0)
        spread = expected - np.add.reduceat(prob * prob, starts, axis=0)
        belief = q[:, :, None]
        tilt += (belief * (given - expected) - MENTION_PENALTY * tilt) / (belief * spread + MENTION_PENALTY)
        prob = strength * np.exp(tilt)[mention_of]
        prob /= prob.sum(axis=2, keepdims=True)


def solve_annotator(counts: np.ndarray, explained: np.ndarray, tilting: np.ndarray) -> np.ndarray:
    """Maximises the annotator's regularised dual: damped Newton steps on each row."""
    tilting = tilting.copy()
    total = counts.sum(axis=1, keepdims=True)
    for _ in range(25):
        prob = np.exp(_log_softmax(tilting))
        slope = counts - explained - total * prob - ANNOTATOR_PENALTY * tilting
        step = slope / (total * prob * (1 - prob) * 2 + ANNOTATOR_PENALTY)
        tilting += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-4:
            break
    return tilting


_STATS = "annotator string, counts array<double>, explained array<double>"
_POSTERIOR = "pattern long, label int, chance double"
_PACKED = "pattern long, weight double, who binary, labels binary"
_BATCH = 4_000


def _parts(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for at in range(0, len(batch), _BATCH):
        yield batch.iloc[at : at + _BATCH]


def _sum_by(keys: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of ``values`` by key."""
    out = np.zeros((size, *values.shape[1:]))
    if len(keys):
        order = np.argsort(keys, kind="stable")
        found, first = np.unique(keys[order], return_index=True)
        out[found] = np.add.reduceat(values[order], first, axis=0)
    return out


class Fit:
    """Tilting of every annotator, as a dictionary sent to the workers or as a table joined to the marks."""

    def __init__(self, patterns: DataFrame, limit: int = BROADCAST_ANNOTATORS):
        self.patterns = patterns
        self.spark = patterns.sparkSession
        names = patterns.select(F.explode("marks.annotator").alias("annotator")).distinct()
        few = [row["annotator"] for row in names.limit(limit + 1).collect()]
        self.sent = len(few) <= limit
        self.names = sorted(few) if self.sent else None
        self.tilting = np.repeat(start_tilting()[None], len(few), axis=0) if self.sent else None
        self.table = None if self.sent else names.withColumn("tilting", F.array(*[F.lit(float(x)) for x in start_tilting().ravel()]))
        self.prior = np.full(K, 1 / K)
        if self.sent:
            self.packed = cut(self._pack())

    def _pack(self) -> DataFrame:
        """The patterns with annotators and labels as arrays of numbers."""
        sent = self.spark.sparkContext.broadcast(self.names)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place = {name: at for at, name in enumerate(sent.value)}
            for batch in batches:
                who = [np.array([place[n] for n in names], np.int32).tobytes() for names in batch["names"]]
                labels = [np.array(x, np.int8).tobytes() for x in batch["given"]]
                yield pd.DataFrame({"pattern": batch["pattern"], "weight": batch["weight"], "who": who, "labels": labels})

        given = self.patterns.select("pattern", "weight", F.col("marks.annotator").alias("names"), F.col("marks.label").alias("given"))
        return given.mapInPandas(scan, _PACKED)

    def _input(self) -> DataFrame:
        if self.sent:
            return self.packed
        marks = self.patterns.select("pattern", "weight", F.posexplode("marks").alias("at", "mark"))
        met = marks.withColumn("annotator", F.col("mark.annotator")).join(self.table, "annotator")
        met = met.groupBy("pattern", "weight").agg(F.array_sort(F.collect_list(F.struct("at", "mark", "tilting"))).alias("m"))
        return met.select("pattern", "weight", F.col("m.mark.annotator").alias("names"), F.col("m.mark.label").alias("labels"), F.flatten("m.tilting").alias("tilting"))

    def _scan(self, use):
        """Calls ``use`` with each part: rows, annotators' names, their place in them and strength by mark, labels, starts."""
        sent = self.spark.sparkContext.broadcast((self.names, np.exp(self.tilting).astype(np.float32))) if self.sent else None

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def parts():
                names, strength = sent.value if sent else (None, None)
                for batch in batches:
                    for part in _parts(batch):
                        if sent:
                            sizes = np.array([len(x) for x in part["labels"]])
                            who = np.frombuffer(b"".join(part["who"]), np.int32)
                            labels = np.frombuffer(b"".join(part["labels"]), np.int8).astype(np.int64)
                            own, known = strength[who], names
                        else:
                            sizes = np.array([len(x) for x in part["labels"]])
                            known, who = np.unique(np.concatenate([np.asarray(x, dtype=str) for x in part["names"]]), return_inverse=True)
                            labels = np.concatenate([np.asarray(x, dtype=np.int64) for x in part["labels"]])
                            own = np.exp(np.concatenate([np.asarray(x, dtype=np.float32) for x in part["tilting"]])).reshape(-1, K, K)
                        yield part, known, who, own, labels, np.append(0, np.cumsum(sizes)[:-1])

            yield from use(parts())

        return scan

    def round(self) -> None:
        """One pass over the patterns and one step of every annotator."""
        prior, sent = self.prior, self.sent

        def use(parts):
            counts = explained = names = None
            for part, known, who, own, labels, starts in parts:
                q, prob = posteriors(own, labels, starts, prior)
                sizes = np.diff(np.append(starts, len(labels)))
                belief = np.repeat(q * part["weight"].to_numpy(np.float32)[:, None], sizes, axis=0)
                size = len(known)
                said = np.stack([np.bincount(who * K + labels, weights=belief[:, k], minlength=size * K).reshape(size, K) for k in range(K)], axis=1)
                alone = own / own.sum(axis=2, keepdims=True)
                more = _sum_by(who, belief[:, :, None] * (prob - alone), size)
                if not sent:
                    yield _stats(known, said, more)
                elif counts is None:
                    names, counts, explained = known, said, more
                else:
                    counts, explained = counts + said, explained + more
            if counts is not None:
                yield _stats(names, counts, explained)

        parts = self._input().mapInPandas(self._scan(use), _STATS)
        add = lambda name: F.array(*[F.sum(F.col(name)[at]) for at in range(K * K)]).alias(name)
        summed = parts.groupBy("annotator").agg(add("counts"), add("explained"))
        if self.sent:
            place = {name: at for at, name in enumerate(self.names)}
            mass = np.full(K, 1.0)
            for row in summed.toLocalIterator():
                at = place[row["annotator"]]
                counts, explained = np.array(row["counts"]).reshape(K, K), np.array(row["explained"]).reshape(K, K)
                self.tilting[at] = solve_annotator(counts, explained, self.tilting[at])
                mass += counts.sum(axis=1)
            self.prior = mass / mass.sum()
            return

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch["tilting"] = [solve_annotator(np.reshape(c, (K, K)), np.reshape(e, (K, K)), np.reshape(t, (K, K))).ravel().tolist() for c, e, t in zip(batch["counts"], batch["explained"], batch["tilting"])]
                batch["mass"] = [np.reshape(c, (K, K)).sum(axis=1).tolist() for c in batch["counts"]]
                yield batch[["annotator", "tilting", "mass"]]

        self.table = cut(summed.join(self.table, "annotator").mapInPandas(solve, "annotator string, tilting array<double>, mass array<double>"))
        mass = np.array(self.table.agg(*[F.sum(F.col("mass")[k]) for k in range(K)]).first(), float) + 1.0
        self.table = self.table.select("annotator", "tilting")
        self.prior = mass / mass.sum()

    def labels(self) -> DataFrame:
        """pattern, label (its place in LABELS) and its posterior chance."""

        prior = self.prior

        def use(parts):
            for part, _, _, own, labels, starts in parts:
                q, _ = posteriors(own, labels, starts, prior)
                yield pd.DataFrame({"pattern": part["pattern"].to_numpy(), "label": q.argmax(axis=1), "chance": q.max(axis=1)})

        return self._input().mapInPandas(self._scan(use), _POSTERIOR)

    def reliability(self) -> DataFrame:
        """annotator and the chance that their label is the right one."""
        spark, prior = self.spark, self.prior

        def trust(tilting: np.ndarray) -> float:
            return float((np.exp(_log_softmax(tilting)).diagonal() * prior).sum())

        if self.sent:
            return spark.createDataFrame([(n, trust(t)) for n, t in zip(self.names, self.tilting)], "annotator string, reliability double")

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"annotator": batch["annotator"], "reliability": [trust(np.reshape(t, (K, K))) for t in batch["tilting"]]})

        return self.table.mapInPandas(scan, "annotator string, reliability double")


def _stats(names, counts: np.ndarray, explained: np.ndarray) -> pd.DataFrame:
    held = np.flatnonzero(counts.sum(axis=(1, 2)))
    return pd.DataFrame({"annotator": [names[at] for at in held], "counts": [counts[at].ravel().tolist() for at in held], "explained": [explained[at].ravel().tolist() for at in held]})


class Consensus:
    """Mentions, the fit over them, and the results."""

    def __init__(self, annotations: DataFrame, records: DataFrame, rounds: int = ROUNDS, limit: int = BROADCAST_ANNOTATORS):
        self.mentions = cut(mentions(cut(spans(annotations, records))).withColumn("pattern", F.xxhash64("marks")))
        patterns = self.mentions.where(F.size("marks") > 0).groupBy("pattern").agg(F.first("marks").alias("marks"), F.count("*").cast("double").alias("weight"))
        self.fit = Fit(cut(patterns), limit)
        for _ in range(rounds):
            self.fit.round()

    def cases(self) -> DataFrame:
        """uid, start, end, label, chance, n_marked, n_annotators of the mentions most annotators marked."""
        names = F.array(*[F.lit(x) for x in LABELS])
        kept = self.mentions.where(F.col("n_marked") * 2 > F.col("n_annotators")).drop("marks")
        out = kept.join(self.fit.labels(), "pattern", "left")
        return out.select("uid", "start", "end", F.when(F.col("label").isNotNull(), F.element_at(names, F.col("label") + 1)).alias("label"), F.round("chance", 6).alias("chance"), "n_marked", "n_annotators")

    def agreement(self) -> DataFrame:
        """By record: share of annotator pairs that give a mention the same label, the same span, and of annotators that mark it.

        ``label_agreement_corrected`` takes off what the frequencies of the labels in the
        whole table would give by chance: (observed - expected) / (1 - expected); null where
        only one label occurs at all.
        """
        counted = self.mentions.select(F.explode("marks.label").alias("label")).groupBy("label").agg(F.count("*").alias("n"))  # one row for each label
        chance = counted.agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("expected"))
        votes = F.transform(F.array_distinct("marks.label"), lambda l: F.size(F.filter("marks", lambda m: m["label"] == l)))
        same = F.aggregate(votes, F.lit(0).cast("long"), lambda a, n: a + n * (n - 1))
        voted, marked = F.size("marks").cast("long"), F.col("n_marked").cast("long")
        sums = self.mentions.select("uid", "n_annotators", "n_marked", same.alias("same"), (voted * (voted - 1)).alias("pairs"), F.col("n_same_span").alias("same_span"), (marked * (marked - 1)).alias("span_pairs"))
        rate = lambda a, b: F.round(F.sum(a) / F.nullif(F.sum(b), F.lit(0)), 6)
        found = sums.groupBy("uid").agg(F.count("*").alias("n_mentions"), F.max("n_annotators").alias("n_annotators"), rate("same", "pairs").alias("label_agreement"), rate("same_span", "span_pairs").alias("span_agreement"), rate("n_marked", "n_annotators").alias("marking_agreement"))
        corrected = (F.col("label_agreement") - F.col("expected")) / F.nullif(1 - F.col("expected"), F.lit(0.0))
        return found.crossJoin(F.broadcast(chance)).withColumn("label_agreement_corrected", F.round(corrected, 6)).drop("expected")

    def annotators(self) -> DataFrame:
        """By annotator: reliability, marks with a label, and the share of them equal to the consensus."""
        given = self.mentions.join(self.fit.labels(), "pattern").select("label", F.explode("marks").alias("m"))
        counted = given.groupBy(F.col("m.annotator").alias("annotator")).agg(F.count("*").alias("n_labels"), F.round(F.avg((F.col("m.label") == F.col("label")).cast("double")), 6).alias("share_of_consensus"))
        return counted.join(self.fit.reliability(), "annotator").withColumn("reliability", F.round("reliability", 6))
