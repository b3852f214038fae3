"""Span operators as queries over the annotators' marks of the records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import spans as S
from umbra.operators import records as R
from umbra.operators import spans as OS
from umbra.sources.tables import table


def _marked(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_spans(table(spark, folder, "dataset_record"), table(spark, folder, "text_annotation"))


def _text(column, name="digest"):
    return F.md5(column).alias(name)


def apply_annotations(spark, folder):
    return _marked(spark, folder).select("uid", _text(S.apply_annotations(F.col("text"), F.col("spans"))))


def mask_spans(spark, folder):
    return _marked(spark, folder).select("uid", _text(S.mask_spans(F.col("text"), F.col("spans"))))


def category_mask(spark, folder):
    sure = S.confident(F.col("spans"), 0.7, keep_unknown=False)
    return _marked(spark, folder).select("uid", _text(S.mask_by_label(F.col("text"), sure)), F.size(sure).cast("long").alias("pii_detected"))


def confidence_filter(spark, folder):
    return _marked(spark, folder).select("uid", F.size(S.confident(F.col("spans"), 0.7)).cast("long").alias("n_kept"), F.size(S.valid(F.col("spans"), F.col("text"))).cast("long").alias("n_valid"))


def dedupe_spans(spark, folder):
    kept = _marked(spark, folder).select("uid", F.posexplode(S.keep_first(F.col("spans"))).alias("n", "s"))
    return kept.select("uid", "n", "s.ann_id", "s.start", "s.end")


def manual_redaction(spark, folder):
    usable = S.valid(F.col("spans"), F.col("text"))
    return _marked(spark, folder).select("uid", _text(S.redact_disjoint(F.col("text"), S.keep_first(usable))))


def mask_original(spark, folder):
    return _marked(spark, folder).select("uid", _text(S.mask_original(F.col("text"), S.keep_first(F.col("spans")))))


def spans_as_pairs(spark, folder):
    pairs = S.from_pairs(S.to_pairs(S.valid(F.col("spans"), F.col("text"))), F.col("text"))
    return _marked(spark, folder).select("uid", F.posexplode(pairs).alias("n", "p")).select("uid", "n", "p.start", "p.end", "p.text")


def expand_spans(spark, folder):
    from umbra.functions import text as T

    rows = _marked(spark, folder).select("uid", S.valid(F.col("spans"), F.col("text")).alias("spans"), T.tokens("text").alias("tokens"))
    grown = F.transform("spans", lambda s: F.struct(s["ann_id"].alias("ann_id"), S.expand_to_tokens(s["start"], s["end"], F.col("tokens")).alias("g")))
    return rows.select(F.explode(grown).alias("s")).select("s.ann_id", "s.g.start", "s.g.end")


def align_annotations(spark, folder):
    from umbra.functions import text as T

    rows = _marked(spark, folder).select("uid", "text", S.valid(F.col("spans"), F.col("text")).alias("spans"), T.tokens("text").alias("tokens"))
    return rows.select("uid", F.posexplode(S.align(F.col("spans"), F.col("tokens"), F.col("text"))).alias("n", "s")).select("uid", "n", "s.start", "s.end", "s.text")


def sentence_clips(spark, folder):
    from umbra.functions import text as T

    rows = _marked(spark, folder).select("uid", S.valid(F.col("spans"), F.col("text")).alias("spans"), F.posexplode(T.sentences(F.col("text"))).alias("sentence", "t"))
    clipped = rows.select("uid", "sentence", F.explode(S.clip_to(F.col("spans"), F.col("t.start"), F.col("t.end"))).alias("c"))
    return clipped.groupBy("uid", "sentence").agg(F.count("*").alias("n"), F.sum("c.start").alias("starts"), F.sum("c.end").alias("ends"))


def _parts(spark, folder):
    marked = _marked(spark, folder)
    spans = marked.select("uid", F.explode(S.valid(F.col("spans"), F.col("text"))).alias("s")).select("uid", "s.ann_id", "s.start", "s.end", "s.label")
    return marked, spans, OS.tokens_of(marked)


def token_map(spark, folder):
    _, spans, tokens = _parts(spark, folder)
    return OS.token_overlaps(spans, tokens).groupBy("s.ann_id").agg(F.min("t.pos").alias("first"), F.max("t.pos").alias("last"), F.count("*").alias("n"))


def candidate_tokens(spark, folder):
    _, spans, tokens = _parts(spark, folder)
    return OS.free_tokens(tokens, spans).groupBy("uid").agg(F.count("*").alias("n"), F.sum("pos").alias("positions"))


def all_instances(spark, folder):
    _, spans, tokens = _parts(spark, folder)
    return OS.all_instances(tokens, tokens, spans).groupBy("uid", "text").agg(F.count("*").alias("n"))


def term_index(spark, folder):
    _, _, tokens = _parts(spark, folder)
    return tokens.groupBy("uid", F.col("text").alias("term")).agg(F.to_json(F.array_sort(F.collect_list("pos"))).alias("positions"))


def bio_labels(spark, folder):
    return OS.char_labels(_marked(spark, folder)).groupBy("uid", "tag").agg(F.count("*").alias("n"), F.sum("pos").cast("long").alias("positions"))


def label_set(spark, folder):
    return OS.label_set(_marked(spark, folder)).select(F.array_join("tags", " ").alias("tags"))


def span_merge(spark, folder):
    sorted_spans = F.transform(S.valid(F.col("spans"), F.col("text")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), s["confidence"].alias("confidence")))
    return _marked(spark, folder).select("uid", F.posexplode(S.merge_chunks(sorted_spans)).alias("n", "s")).select("uid", "n", "s.start", "s.end", "s.label", "s.confidence")


def last_wins(spark, folder):
    rows = table(spark, folder, "dataset_record").where("text IS NOT NULL").select("idx", F.md5("text").alias("text"), "loaded_at")
    return OS.last_by_index(rows, "text", "loaded_at")


def merged_annotations(spark, folder):
    marks = R.annotations_once(table(spark, folder, "text_annotation")).where("start IS NOT NULL AND `end` IS NOT NULL AND annotator IS NOT NULL")
    merged = OS.merge_by(marks.select("uid", "annotator", "ann_id", "start", "end"), "annotator", "ann_id")
    return merged.select("uid", F.posexplode("spans").alias("n", "s")).select("uid", "n", "s.ann_id")


def _paths(spark, folder):
    marks = table(spark, folder, "text_annotation").where("annotator IS NOT NULL AND uid IS NOT NULL AND made_at IS NOT NULL")
    return marks.select(F.concat_ws("/", F.lit("outputs"), F.regexp_extract("uid", "^([a-z_]+)_", 1), "annotator", F.concat(F.date_format("made_at", "yyyyMMdd_HHmmss"), F.lit(".jsonl"))).alias("path"))


def source_naming(spark, folder):
    return OS.named_sources(_paths(spark, folder))


def latest_per_model(spark, folder):
    return OS.latest_by_model(_paths(spark, folder))


QUERIES = {f.__name__: f for f in (apply_annotations, mask_spans, category_mask, confidence_filter, dedupe_spans, manual_redaction, mask_original, spans_as_pairs, expand_spans, align_annotations, sentence_clips, token_map, candidate_tokens, all_instances, term_index, bio_labels, label_set, span_merge, last_wins, merged_annotations, source_naming, latest_per_model)}

_REC = "rec AS (SELECT uid, max_by(text, loaded_at) AS text FROM dataset_record WHERE uid IS NOT NULL AND text IS NOT NULL GROUP BY uid)"
_SPELT = r"upper(regexp_replace(regexp_replace(r.label, '^[\s_\-]+|[\s_\-]+$', '', 'g'), '[\s_\-]+', '_', 'g'))"
_ANN = f"""
    ann AS (SELECT ann_id, r.uid AS uid, r.annotator AS annotator, r.start AS start, r."end" AS "end", {_SPELT} AS label, r.confidence AS confidence
            FROM (SELECT ann_id, max(struct_pack(t := received_at, uid := uid, annotator := annotator, start := start, "end" := "end", label := label, confidence := confidence)) AS r
                  FROM text_annotation WHERE ann_id IS NOT NULL AND uid IS NOT NULL GROUP BY ann_id)),
    sp AS (SELECT ann.*, rec.text AS doc FROM ann JOIN rec USING (uid) WHERE start IS NOT NULL AND "end" IS NOT NULL)
"""
WITH = f"WITH RECURSIVE {_REC}, {_ANN}"


def _fold(order: str, put: str, where: str = "true") -> str:
    """A recursive query that replaces spans one after another in a given order."""
    return f"""{WITH},
        q AS (SELECT uid, start, "end", label, row_number() OVER (PARTITION BY uid ORDER BY {order}) AS k FROM sp WHERE {where}),
        step AS (
            SELECT uid, 0::BIGINT AS k, text AS t FROM rec WHERE uid IN (SELECT uid FROM sp)
            UNION ALL
            SELECT s.uid, q.k, CASE WHEN q.start >= 0 AND q.start < q."end" AND q."end" <= length(s.t) THEN substring(s.t, 1, q.start) || {put} || substring(s.t, q."end" + 1) ELSE s.t END
            FROM step s JOIN q ON q.uid = s.uid AND q.k = s.k + 1
        ),
        done AS (SELECT uid, max_by(t, k) AS t FROM step GROUP BY uid)
    """


_VALID = 'start >= 0 AND start < "end" AND "end" <= length(doc)'
_FIRST = f"""{WITH},
    q AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY start, ann_id) AS k FROM sp WHERE {{where}}),
    keep AS (
        SELECT uid, 0::BIGINT AS k, -1 AS last, NULL::BIGINT AS ann_id FROM (SELECT DISTINCT uid FROM sp)
        UNION ALL
        SELECT c.uid, q.k, CASE WHEN q.start >= c.last THEN q."end" ELSE c.last END, CASE WHEN q.start >= c.last THEN q.ann_id END
        FROM keep c JOIN q ON q.uid = c.uid AND q.k = c.k + 1
    ),
    kept AS (SELECT q.*, row_number() OVER (PARTITION BY q.uid ORDER BY q.k) - 1 AS n FROM keep JOIN q USING (uid, k, ann_id))
"""
_TOKENS = r"""
    tok0 AS (SELECT uid, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t, regexp_split_to_array(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM rec WHERE uid IN (SELECT uid FROM sp)),
    tok1 AS (SELECT uid, unnest(t) AS text, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS pos FROM tok0),
    tok AS (SELECT uid, pos, text, (sum(length(text) + length(gap)) OVER (PARTITION BY uid ORDER BY pos) - length(text))::BIGINT AS start, (sum(length(text) + length(gap)) OVER (PARTITION BY uid ORDER BY pos))::BIGINT AS "end" FROM tok1),
    vs AS (SELECT * FROM sp WHERE start >= 0 AND start < "end" AND "end" <= length(doc))
"""
_OVER = 't.start < s."end" AND t."end" > s.start'
_PATHS = """
    p AS (SELECT DISTINCT concat_ws('/', 'outputs', regexp_extract(uid, '^([a-z_]+)_', 1), annotator, strftime(made_at AT TIME ZONE 'UTC', '%Y%m%d_%H%M%S') || '.jsonl') AS path
          FROM text_annotation WHERE annotator IS NOT NULL AND uid IS NOT NULL AND made_at IS NOT NULL)
"""
_GROWN = f"""{WITH}, {_TOKENS},
    g AS (SELECT s.uid, s.ann_id, least(min(s.start), min(t.start))::INT AS start, greatest(max(s."end"), max(t."end"))::INT AS "end", any_value(s.doc) AS doc
          FROM vs s LEFT JOIN tok t ON t.uid = s.uid AND {_OVER} GROUP BY s.uid, s.ann_id)
"""

SQL = {
    "apply_annotations": _fold("start DESC, ann_id", "'[MASK]'") + "SELECT uid, md5(t) AS digest FROM done",
    "mask_spans": _fold('start DESC, "end" DESC', "'[MASK]'") + "SELECT uid, md5(t) AS digest FROM done",
    "category_mask": _fold("start DESC, ann_id", "CASE WHEN coalesce(q.label, '') = '' THEN '[MASK]' ELSE '[' || q.label || ']' END", "confidence >= 0.7")
    + "SELECT uid, md5(t) AS digest, (SELECT count(*) FROM sp WHERE sp.uid = done.uid AND confidence >= 0.7) AS pii_detected FROM done",
    "confidence_filter": f"{WITH} SELECT uid, count(*) FILTER (confidence IS NULL OR confidence >= 0.7) AS n_kept, count(*) FILTER ({_VALID}) AS n_valid FROM sp GROUP BY uid",
    "dedupe_spans": _FIRST.format(where="true") + 'SELECT uid, n::INT AS n, ann_id, start, "end" FROM kept',
    "manual_redaction": _FIRST.format(where=_VALID)
    + """, g AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY uid ORDER BY n), 0) AS prev FROM kept),
        r AS (SELECT uid, string_agg(substring(doc, prev + 1, start - prev) || '[' || coalesce(label, 'None') || ']', '' ORDER BY n) AS t, max("end") AS last FROM g GROUP BY uid)
        SELECT rec.uid, md5(coalesce(r.t, '') || substring(rec.text, coalesce(r.last, 0) + 1)) AS digest FROM rec LEFT JOIN r USING (uid) WHERE rec.uid IN (SELECT uid FROM sp)""",
    "mask_original": _FIRST.format(where="true")
    + f""", v AS (SELECT * FROM kept WHERE {_VALID}),
        g AS (SELECT *, coalesce(lag("end") OVER (PARTITION BY uid ORDER BY n), 0) AS prev FROM v),
        r AS (SELECT uid, string_agg(substring(doc, prev + 1, start - prev) || '[MASK]', '' ORDER BY n) AS t, max("end") AS last FROM g GROUP BY uid)
        SELECT rec.uid, md5(coalesce(r.t, '') || substring(rec.text, coalesce(r.last, 0) + 1)) AS digest FROM rec LEFT JOIN r USING (uid) WHERE rec.uid IN (SELECT uid FROM sp)""",
    "spans_as_pairs": f"{WITH} SELECT uid, (row_number() OVER (PARTITION BY uid ORDER BY ann_id) - 1)::INT AS n, start, \"end\", substring(doc, start + 1, \"end\" - start) AS text FROM sp WHERE {_VALID}",
    "expand_spans": _GROWN + 'SELECT ann_id, start, "end" FROM g',
    "align_annotations": _GROWN
    + ', d AS (SELECT uid, start, "end", any_value(doc) AS doc FROM g GROUP BY uid, start, "end") SELECT uid, (row_number() OVER (PARTITION BY uid ORDER BY start, "end") - 1)::INT AS n, start, "end", substring(doc, start + 1, "end" - start) AS text FROM d',
    "sentence_clips": rf"""{WITH},
        s0 AS (SELECT uid, regexp_extract_all(text, '(?s)(.*?[.!?]+\s+|.+$)', 1) AS parts FROM rec WHERE length(text) > 0 AND uid IN (SELECT uid FROM sp)),
        s1 AS (SELECT uid, unnest(parts) AS part, unnest(range(len(parts)))::INT AS sentence FROM s0),
        t AS (SELECT uid, sentence, sum(length(part)) OVER w - length(part) AS start, sum(length(part)) OVER w AS "end" FROM s1 WINDOW w AS (PARTITION BY uid ORDER BY sentence))
        SELECT t.uid, t.sentence, count(*) AS n, sum(greatest(s.start, t.start) - t.start)::BIGINT AS starts, sum(least(s."end", t."end") - t.start)::BIGINT AS ends
        FROM t JOIN sp s ON s.uid = t.uid AND {_OVER} WHERE s.start >= 0 AND s.start < s."end" AND s."end" <= length(s.doc) GROUP BY t.uid, t.sentence""",
    "token_map": f"{WITH}, {_TOKENS} SELECT s.ann_id, min(t.pos)::INT AS first, max(t.pos)::INT AS last, count(*) AS n FROM vs s JOIN tok t ON t.uid = s.uid AND {_OVER} GROUP BY s.ann_id",
    "candidate_tokens": f"{WITH}, {_TOKENS} SELECT uid, count(*) AS n, sum(pos)::BIGINT AS positions FROM tok t WHERE NOT EXISTS (SELECT 1 FROM vs s WHERE s.uid = t.uid AND {_OVER}) GROUP BY uid",
    "all_instances": f"{WITH}, {_TOKENS} SELECT uid, text, count(*) AS n FROM tok t WHERE NOT EXISTS (SELECT 1 FROM vs s WHERE s.uid = t.uid AND {_OVER}) GROUP BY uid, text",
    "term_index": f"{WITH}, {_TOKENS} SELECT uid, text AS term, '[' || string_agg(pos::VARCHAR, ',' ORDER BY pos) || ']' AS positions FROM tok GROUP BY uid, text",
    "bio_labels": f"""{WITH},
        k AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY start, ann_id) AS rank, start, least("end", length(doc)) AS stop, coalesce(nullif(regexp_replace(label, '^[BI]-', ''), ''), 'ENTITY') AS label, length(doc) AS n FROM sp),
        c AS (SELECT uid, rank, start, label, unnest(range(start, stop)) AS pos FROM k WHERE start >= 0 AND start < n AND start < stop),
        m AS (SELECT uid, pos, max_by(CASE WHEN pos = start THEN 'B-' ELSE 'I-' END || label, rank) AS tag FROM c GROUP BY uid, pos)
        SELECT uid, tag, count(*) AS n, sum(pos)::BIGINT AS positions FROM m GROUP BY uid, tag""",
    "label_set": f"{WITH} SELECT 'O ' || string_agg(tag, ' ' ORDER BY tag) AS tags FROM (SELECT DISTINCT unnest(['B-' || l, 'I-' || l]) AS tag FROM (SELECT regexp_replace(label, '^[BI]-', '') AS l FROM sp WHERE label IS NOT NULL))",
    "last_wins": """
        WITH l AS (SELECT idx, max_by(md5(text), loaded_at) AS text FROM dataset_record WHERE text IS NOT NULL AND idx >= 0 GROUP BY idx)
        SELECT r.idx, l.text FROM (SELECT unnest(range((SELECT max(idx) + 1 FROM l))) AS idx) r LEFT JOIN l USING (idx)
    """,
    "merged_annotations": f"{WITH} SELECT uid, (row_number() OVER (PARTITION BY uid ORDER BY annotator, ann_id) - 1)::INT AS n, ann_id FROM ann WHERE start IS NOT NULL AND \"end\" IS NOT NULL AND annotator IS NOT NULL",
    "span_merge": f"""{WITH},
        k AS (SELECT uid, row_number() OVER (PARTITION BY uid ORDER BY start, ann_id) AS k, start, "end", label, confidence FROM sp WHERE start >= 0 AND start < "end" AND "end" <= length(doc)),
        r AS (SELECT uid, k, 0 AS n, start, "end", label, confidence FROM k WHERE k = 1
              UNION ALL SELECT k.uid, k.k, CASE WHEN j THEN r.n ELSE r.n + 1 END, CASE WHEN j THEN r.start ELSE k.start END, CASE WHEN j THEN greatest(r."end", k."end") ELSE k."end" END, CASE WHEN j THEN r.label ELSE k.label END, CASE WHEN j THEN r.confidence ELSE k.confidence END
              FROM r JOIN k ON k.uid = r.uid AND k.k = r.k + 1, LATERAL (SELECT k.start <= r."end" AND k.label IS NOT DISTINCT FROM r.label AS j))
        SELECT uid, n::INT AS n, max_by(start, k) AS start, max_by("end", k) AS "end", max_by(struct_pack(v := label), k).v AS label, max_by(struct_pack(v := confidence), k).v AS confidence FROM r GROUP BY uid, n""",
    "source_naming": f"WITH {_PATHS} SELECT path, split_part(path, '/', 3) || '_' || split_part(path, '/', 2) || '_' || (row_number() OVER (PARTITION BY split_part(path, '/', 3), split_part(path, '/', 2) ORDER BY path) - 1) AS name FROM p",
    "latest_per_model": f"WITH {_PATHS} SELECT split_part(path, '/', 3) AS model, max(path) AS path FROM p GROUP BY 1",
}
