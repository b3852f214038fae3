"""Mixing sources to target weights (problem 8).

Method: every document gets a hash-random key; documents are range-sorted by source and
key, so a large source spreads over many tasks; prefix sums of token counts are formed
from the sums of the range partitions (one number for each partition and source) and the
running sums inside them; each source is cut at its exact budget, after as many whole
epochs as the budget holds.  Tokens are those of a public tokenizer file, whose path is a
parameter.

The total is the largest for which every source that has documents reaches its share
within its repeats, unless ``total_tokens`` asks for another; then a source whose repeats
do not suffice gives all it may and its reached share shows the lack.

Defined results: source names are compared without case and outer blanks; documents
without source, text or target give nothing; a target without documents is reported with
nothing reached; repeated targets of one source count together; an empty corpus gives an
empty mix.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbra.session import cut, parallelism

TOKENIZER = "byte_bpe_50k.tiktoken"
SEED = 20_240_501


@lru_cache(maxsize=4)
def _encoding(path: str | None):
    import tiktoken

    try:
        import public_tokenizers as public

        pattern, path = public.PATTERN, path or public.path(TOKENIZER)
    except ImportError:
        pattern, path = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", path or f"/opt/tokenizers/{TOKENIZER}"
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _counter(path: str | None):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for batch in batches:
            yield pd.DataFrame({"source": batch["source"], "key": batch["key"], "doc_id": batch["doc_id"], "n_tokens": [len(encode(t)) for t in batch["text"]]})

    return count


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and repeats by source name; a parameter table of one row for each source."""
    rows = targets.where("source is not null and target_share > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("repeats"))
    return {r["source"]: (r["share"], max(r["repeats"] if r["repeats"] is not None else 1, 0)) for r in rows.toLocalIterator()}


_RUNNING = "source string, doc_id long, n_tokens long, repeats int, tokens_used long"


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = None, seed: int = SEED) -> DataFrame:
    """source, doc_id, n_tokens, repeats (times the document begins in the mix), tokens_used."""
    spark = documents.sparkSession
    wanted = _targets(targets)
    names = targets.select(F.lower(F.trim("source")).alias("source")).where("source is not null").distinct()
    keyed = documents.select(F.lower(F.trim("source")).alias("source"), F.xxhash64(F.col("doc_id"), F.lit(seed)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = keyed.where("text is not null and source is not null and doc_id is not null").join(names, "source", "left_semi").mapInPandas(_counter(tokenizer), "source string, key long, doc_id long, n_tokens long")
    counted = cut(counted)  # the range partitioning samples its input; the tokens must not be counted twice
    ranged = cut(counted.repartitionByRange(parallelism(spark), "source", "key", "doc_id").sortWithinPartitions("source", "key", "doc_id"))

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        held: dict[str, int] = {}
        for batch in batches:
            for source, n in batch.groupby("source")["n_tokens"].sum().items():
                held[source] = held.get(source, 0) + int(n)
        yield pd.DataFrame([(part, s, n) for s, n in held.items()], columns=["part", "source", "n"])

    # one row for each range partition and source in it: at most partitions plus sources
    offsets: dict[tuple[int, str], int] = {}
    totals: dict[str, int] = {}
    for row in ranged.select("source", "n_tokens").mapInPandas(sums, "part int, source string, n long").orderBy("part", "source").toLocalIterator():
        offsets[row["part"], row["source"]] = totals.get(row["source"], 0)
        totals[row["source"]] = totals.get(row["source"], 0) + row["n"]
    held = {s: n for s, n in totals.items() if n and s in wanted and wanted[s][1]}
    total = total_tokens if total_tokens is not None else min((int(n * wanted[s][1] / wanted[s][0]) for s, n in held.items()), default=0)
    budgets = {s: min(int(round(total * wanted[s][0])), n * wanted[s][1]) for s, n in held.items()}
    sent = spark.sparkContext.broadcast((offsets, totals, budgets))

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offset, size, budget = sent.value
        part = TaskContext.get().partitionId()
        running: dict[str, int] = {}
        for batch in batches:
            rows = []
            for source, doc, n in zip(batch["source"], batch["doc_id"], batch["n_tokens"]):
                before = running.get(source, offset.get((part, source), 0))
                running[source] = before + n
                if source not in budget or not n:
                    continue
                epochs, rest = divmod(budget[source], size[source])
                part_used = max(0, min(n, rest - before))
                repeats = epochs + (part_used > 0)
                if repeats:
                    rows.append((source, doc, n, repeats, epochs * n + part_used))
            yield pd.DataFrame(rows, columns=["source", "doc_id", "n_tokens", "repeats", "tokens_used"])

    return ranged.mapInPandas(take, _RUNNING)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and reached share of each source of the targets."""
    used = mixed.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("tokens_used").alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    wanted = targets.where("source is not null").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    out = wanted.join(used, "source", "left").na.fill(0, ["n_documents", "tokens_used", "most_repeats"])
    total = out.agg(F.sum("tokens_used").alias("total"))
    reached = F.when(F.col("total") > 0, F.col("tokens_used") / F.col("total")).otherwise(0.0)
    return out.crossJoin(total).select("source", "target_share", "max_repeats", "n_documents", "tokens_used", "most_repeats", F.round(reached, 6).alias("reached_share"))
