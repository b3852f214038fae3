"""Queries and SQL of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.llm import consensus, encoding, leakage, mixing, overlap, pairs, sanitise, splitter
from umbra.sources.tables import table


def _consensus(spark: SparkSession, folder: str) -> consensus.Consensus:
    return consensus.Consensus(table(spark, folder, "text_annotation"), table(spark, folder, "dataset_record"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).cases().select("uid", "start", "end", "label")


def p1_agreement(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).agreement()


def p1_annotators(spark: SparkSession, folder: str) -> DataFrame:
    return _consensus(spark, folder).annotators()


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.occurrences(table(spark, folder, "dataset_record"))


def p2_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.redacted(table(spark, folder, "dataset_record"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defects(table(spark, folder, "reddit"))


def _pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.split_chunks(table(spark, folder, "chunk"), table(spark, folder, "chunk_profile"), table(spark, folder, "tab"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder).where("piece_no = 0").select("chunk_id", "kind")


def p4_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _pieces(spark, folder)


def p4_rebuilt(spark: SparkSession, folder: str) -> DataFrame:
    return splitter.rebuilt(_pieces(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs_of = overlap.record_pairs(table(spark, folder, "dataset_record"))
    return pairs_of.select(F.least("train_uid", "eval_uid").alias("uid_a"), F.greatest("train_uid", "eval_uid").alias("uid_b"))


def p6_counts(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, folder, "dataset_record"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p7_removed(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.removed(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.shares(mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target")), table(spark, folder, "mix_target"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_target"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair_documents(table(spark, folder, "documents")).select("doc_id")


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.repair_documents(table(spark, folder, "documents")).select("doc_id", "restored", "readings", "n_spans", "lossy", "escaped")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_agreement": p1_agreement,
    "p1_annotators": p1_annotators,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_pieces": p4_pieces,
    "p4_rebuilt": p4_rebuilt,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p7_removed": p7_removed,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}

SQL: dict[str, str] = {
    "p4_rebuilt": """
        WITH once AS (
            SELECT c.chunk_id, min(struct_pack(t := c.text, m := p.max_length)) AS c
            FROM chunk c JOIN chunk_profile p USING (profile)
            WHERE length(c.text) > p.max_length AND c.chunk_id IS NOT NULL
            GROUP BY c.chunk_id
        )
        SELECT chunk_id, length(c.t)::INT AS n_chars, md5(c.t) AS text_md5 FROM once
    """,
    "p4_found": """
        WITH once AS (
            SELECT c.chunk_id, min(struct_pack(t := c.text, m := p.max_length)) AS c
            FROM chunk c JOIN chunk_profile p USING (profile)
            WHERE length(c.text) > p.max_length AND c.chunk_id IS NOT NULL
            GROUP BY c.chunk_id
        )
        SELECT chunk_id,
               CASE WHEN list_max(list_transform(regexp_split_to_array(c.t, '[ \\t\\r\\n]+'), lambda x: length(x))) > c.m
                    THEN 'unbroken' ELSE 'splittable' END AS kind
        FROM once
    """,
}
