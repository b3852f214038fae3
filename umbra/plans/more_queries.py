"""Treebank tokens, token labels, indices, detection in chunks, gazetteers and event windows as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.functions import treebank
from umbra.operators import detection, detector, recognise, records
from umbra.operators import spans as OS
from umbra.plans import span_queries, text_queries
from umbra.session import ensure_checkpoint_dir, spread
from umbra.sources.tables import table
from umbra.streaming import pipelines

STOP_WORDS = ("the", "of", "and", "to", "in", "no", "The", "OF")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text"))


def treebank_tokens(spark, folder):
    rows = _docs(spark, folder).select("doc_id", F.explode(treebank.terms(F.col("text"))).alias("t"))
    shown = F.when(F.col("t.text").isin("``", "''"), '"').otherwise(F.col("t.text"))
    held = rows.groupBy("doc_id", F.col("t.sentence").alias("sentence")).agg(F.array_sort(F.collect_list(F.struct(F.col("t.start").alias("start"), shown.alias("text")))).alias("s"))
    return held.select("doc_id", "sentence", F.size("s").cast("long").alias("n_tokens"), F.md5(F.array_join("s.text", " ")).alias("digest"))


def record_state(spark, folder):
    rows = _docs(spark, folder).select("doc_id", treebank.record_state(F.col("text")).alias("r"))
    return rows.select("doc_id", F.size("r.sentences").cast("long").alias("n_sentences"), F.size("r.terms").cast("long").alias("n_terms"))


def bio_tokens(spark, folder):
    marked = records.with_spans(table(spark, folder, "dataset_record"), table(spark, folder, "text_annotation"))
    return OS.token_labels(marked).where("tag <> 'O'").groupBy("uid", "tag").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("positions"))


def ignore_terms(spark, folder):
    return OS.ignore_set(spark, list(STOP_WORDS), ["[MASK]"], table(spark, folder, "text_annotation").select("label"))


def indexed_records(spark, folder):
    rows = records.once(table(spark, folder, "dataset_record")).select("uid", "text")
    return records.with_index(rows, ["uid"]).select("uid", "index")


def chosen_records(spark, folder):
    rows = records.numbered(records.once(table(spark, folder, "dataset_record")).select("uid"), ["uid"])
    return records.by_indices(rows, [0, 7, 7, 20, 41]).select("idx", "uid")


def chunked_detection(spark, folder):
    found = detector.in_chunks(_docs(spark, folder), lambda chunks: recognise.redact(chunks), 100_000, 100, "doc_id")
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label")


def detector_scores(spark, folder):
    """A detector learnt from half of the annotated records, scored on the other half."""
    marked = records.with_spans(table(spark, folder, "dataset_record"), table(spark, folder, "text_annotation")).select("uid", "text", "spans")
    half = F.pmod(F.crc32(F.col("uid")), F.lit(2))
    model = detector.train(marked.where(half == 0))
    asked = marked.where(half == 1)
    spans = lambda rows: rows.select("uid", F.explode("spans").alias("s")).select("uid", "s.start", "s.end", "s.label").where("label IS NOT NULL AND start >= 0 AND start < `end`").distinct()
    return detection.prf(spans(asked), spans(detector.predict(model, asked)))


def gazetteer_names(spark, folder):
    marks = table(spark, folder, "text_annotation").select(F.col("text").alias("name"), records.spelt(F.col("label")).alias("label")).where(r"label IN ('PERSON', 'ORG') AND name RLIKE '^[A-Za-z]+$'").distinct()
    texts = records.once(table(spark, folder, "dataset_record")).select("uid", "text")
    return detector.gazetteer(texts, marks).select("uid", F.explode("spans").alias("s")).groupBy("uid", "s.label").agg(F.count("*").alias("n"), F.sum("s.start").cast("long").alias("starts"))


def windowed_events(spark, folder):
    """Events by hour and kind, through a stream with a watermark."""
    base = f"{ensure_checkpoint_dir(spark)}/windows-{uuid.uuid4().hex}"
    counted = pipelines.windowed_counts(pipelines.read_table(spark, folder, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out")


QUERIES = {f.__name__: f for f in (treebank_tokens, record_state, bio_tokens, ignore_terms, indexed_records, chosen_records, chunked_detection, detector_scores, gazetteer_names, windowed_events)}


def _spaced(column: str) -> str:
    for pattern, put in treebank.RULES:
        quote = lambda s: s.replace("'", "''")
        column = f"regexp_replace({column}, '{quote(pattern)}', '{quote(put)}', 'g')"
    return column


_TREEBANK = f"""WITH {text_queries._SENTENCES}, p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts)))::INT AS sentence FROM s),
    t AS (SELECT doc_id, sentence, list_filter(regexp_split_to_array({_spaced('part')}, '[{treebank.BLANKS}]+'), lambda x: x <> '') AS t FROM p)"""
_QUOTED = "list_transform(t, lambda x: CASE WHEN x IN ('``', '''''') THEN '\"' ELSE x END)"
_STRETCHES = r"""
    b0 AS (SELECT uid, regexp_extract_all(text, '[^ \t\n\r\f\v]+') AS t, regexp_split_to_array(text, '[^ \t\n\r\f\v]+') AS g FROM rec WHERE uid IN (SELECT uid FROM sp)),
    b1 AS (SELECT uid, unnest(t) AS v, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS pos FROM b0),
    b2 AS (SELECT uid, pos, v, sum(length(v) + length(gap)) OVER (PARTITION BY uid ORDER BY pos) AS stop FROM b1),
    b3 AS (SELECT uid, pos, v, stop - length(v) AS start, stop AS "end" FROM b2)
"""

SQL = {
    "treebank_tokens": f"{_TREEBANK} SELECT doc_id, sentence, len(t)::BIGINT AS n_tokens, md5(array_to_string({_QUOTED}, ' ')) AS digest FROM t WHERE len(t) > 0",
    "record_state": f"{_TREEBANK} SELECT doc_id, count(*) AS n_sentences, sum(len(t))::BIGINT AS n_terms FROM t GROUP BY doc_id",
    "bio_tokens": f"""{span_queries.WITH}, {_STRETCHES},
        m AS (SELECT b3.uid, b3.pos, b3.start, min(struct_pack(s := sp.start, a := sp.ann_id, l := coalesce(nullif(regexp_replace(sp.label, '^[BI]-', ''), ''), 'ENTITY'), e := sp."end")) AS f
              FROM b3 JOIN sp ON sp.uid = b3.uid AND NOT (sp."end" <= b3.start OR sp.start >= b3."end") GROUP BY b3.uid, b3.pos, b3.start),
        x AS (SELECT uid, pos, CASE WHEN EXISTS (SELECT 1 FROM b3 o WHERE o.uid = m.uid AND o."end" <= m.start AND NOT (o."end" <= m.f.s OR o.start >= m.f.e)) THEN 'I-' ELSE 'B-' END || m.f.l AS tag FROM m)
        SELECT uid, tag, count(*) AS n, sum(pos)::BIGINT AS positions FROM x GROUP BY uid, tag""",
    "ignore_terms": "WITH t AS (SELECT unnest([" + ", ".join(f"'{w}'" for w in (*STOP_WORDS, "[MASK]")) + "]) AS term UNION ALL SELECT label FROM text_annotation WHERE label IS NOT NULL) SELECT term FROM t UNION SELECT lower(term) FROM t",
    "indexed_records": f"WITH {span_queries._REC} SELECT uid, row_number() OVER (ORDER BY uid) AS index FROM rec",
    "chosen_records": f"WITH {span_queries._REC}, n AS (SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS idx FROM rec) SELECT idx, uid FROM n WHERE idx IN (0, 7, 20, 41)",
    "chunked_detection": f"WITH {text_queries.FOUND} SELECT doc_id, start::INT AS start, (start + length(v))::INT AS \"end\", label FROM o",
    "gazetteer_names": rf"""{span_queries.WITH},
        gz AS (SELECT text AS v, min(l) AS label FROM (SELECT text, upper(regexp_replace(regexp_replace(label, '^[\s_\-]+|[\s_\-]+$', '', 'g'), '[\s_\-]+', '_', 'g')) AS l FROM text_annotation) WHERE l IN ('PERSON', 'ORG') AND regexp_full_match(text, '[A-Za-z]+') GROUP BY text),
        g0 AS (SELECT uid, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS t, regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]') AS g FROM rec),
        g1 AS (SELECT uid, unnest(t) AS v, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS pos FROM g0),
        g2 AS (SELECT uid, pos, v, sum(length(v) + length(gap)) OVER (PARTITION BY uid ORDER BY pos) - length(v) AS start FROM g1),
        g3 AS (SELECT g2.uid, g2.pos, g2.start, gz.label, lag(g2.pos) OVER w AS before, lag(gz.label) OVER w AS label_before FROM g2 JOIN gz USING (v) WINDOW w AS (PARTITION BY g2.uid ORDER BY g2.pos))
        SELECT uid, label, count(*) AS n, sum(start)::BIGINT AS starts FROM g3 WHERE before IS NULL OR before + 1 <> pos OR label_before <> label GROUP BY uid, label""",
    "windowed_events": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
