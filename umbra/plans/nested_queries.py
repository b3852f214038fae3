"""Flat tables of nested court cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from umbra.operators import nested
from umbra.sources.tables import table


def _part(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nested.case_tables(table(spark, folder, "tab"))[name]

    return query


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.children(table(spark, folder, "tab"))


QUERIES = {"p5_found": p5_found} | {f"p5_{name}": _part(name) for name in ("documents", "annotators", "mentions", "countries", "years")}

_LATEST = """
    WITH latest AS (
        SELECT doc_id,
               max_by(row_id, (delivered_at, row_id)) AS row_id,
               max(delivered_at) AS delivered_at,
               max_by(quality_checked, (delivered_at, row_id)) AS quality_checked,
               max_by(task, (delivered_at, row_id)) AS task,
               max_by(dataset_type, (delivered_at, row_id)) AS dataset_type,
               max_by(length(text), (delivered_at, row_id)) AS n_chars,
               max_by(coalesce(meta, ''), (delivered_at, row_id)) AS meta,
               max_by(coalesce(annotations, ''), (delivered_at, row_id)) AS annotations
        FROM tab WHERE doc_id IS NOT NULL GROUP BY doc_id
    ),
    valid AS (SELECT * REPLACE (CASE WHEN json_valid(meta) THEN meta::JSON END AS meta, CASE WHEN json_valid(annotations) THEN annotations::JSON END AS annotations) FROM latest),
    keyed AS (
        SELECT doc_id, k AS annotator, annotator_pos, json_extract(annotations, '$."' || k || '"') AS member
        FROM (SELECT doc_id, annotations, unnest(json_keys(annotations)) AS k, unnest(range(len(json_keys(annotations)))) AS annotator_pos FROM valid WHERE json_type(annotations) = 'OBJECT')
        UNION ALL
        SELECT doc_id, json_extract_string(member, '$.annotator') AS annotator, annotator_pos, member
        FROM (SELECT doc_id, json_extract(annotations, '$[' || annotator_pos || ']') AS member, annotator_pos
              FROM (SELECT doc_id, annotations, unnest(range(json_array_length(annotations)::BIGINT)) AS annotator_pos FROM valid WHERE json_type(annotations) = 'ARRAY'))
        WHERE json_type(member) = 'OBJECT'
    ),
    held AS (SELECT doc_id, annotator, annotator_pos, json_extract(member, '$.entity_mentions') AS m FROM keyed),
    mention AS (
        SELECT doc_id, annotator, annotator_pos, pos, json_extract(m, '$[' || pos || ']') AS x
        FROM (SELECT *, unnest(range(json_array_length(m)::BIGINT)) AS pos FROM held WHERE json_type(m) = 'ARRAY')
        UNION ALL SELECT doc_id, annotator, annotator_pos, 0, m FROM held WHERE json_type(m) NOT IN ('ARRAY', 'NULL')
    ),
    value AS (
        SELECT doc_id, child, pos, json_extract(v, '$[' || pos || ']') AS x
        FROM (
            SELECT *, unnest(range(json_array_length(v)::BIGINT)) AS pos
            FROM (SELECT doc_id, 'country' AS child, json_extract(meta, '$.countries') AS v FROM valid
                  UNION ALL SELECT doc_id, 'year', json_extract(meta, '$.years') FROM valid)
            WHERE json_type(v) = 'ARRAY'
        )
        UNION ALL
        SELECT doc_id, child, 0, v
        FROM (SELECT doc_id, 'country' AS child, json_extract(meta, '$.countries') AS v FROM valid
              UNION ALL SELECT doc_id, 'year', json_extract(meta, '$.years') FROM valid)
        WHERE json_type(v) NOT IN ('ARRAY', 'NULL')
    )
"""

_FIELD = "coalesce(json_extract_string(x, '$.{0}'), json_extract_string(x, '$.metadata.{0}'))"

SQL = {
    "p5_found": _LATEST
    + """
    SELECT doc_id, annotator AS parent, 'mention' AS child, pos::INT AS pos FROM mention WHERE json_type(x) <> 'NULL'
    UNION ALL SELECT doc_id, 'meta', child, pos::INT FROM value WHERE json_type(x) <> 'NULL'
    """,
    "p5_documents": _LATEST
    + "SELECT doc_id, row_id, delivered_at::TIMESTAMP AS delivered_at, quality_checked, task, dataset_type, n_chars, json_extract_string(meta, '$.applicant') AS applicant FROM valid",
    "p5_annotators": _LATEST + "SELECT doc_id, annotator, annotator_pos::INT AS annotator_pos FROM keyed",
    "p5_mentions": _LATEST
    + "SELECT doc_id, annotator, annotator_pos::INT AS annotator_pos, pos::INT AS pos, "
    + ", ".join(
        (f"try_cast({_FIELD.format(c)} AS INT)" if c.endswith("offset") else _FIELD.format(c)) + f" AS {c}"
        for c in ("entity_mention_id", "start_offset", "end_offset", "span_text", "entity_type", "identifier_type", "confidential_status")
    )
    + " FROM mention WHERE json_type(x) <> 'NULL'",
    "p5_countries": _LATEST + "SELECT doc_id, pos::INT AS pos, json_extract_string(x, '$') AS country FROM value WHERE child = 'country' AND json_type(x) <> 'NULL'",
    "p5_years": _LATEST + "SELECT doc_id, pos::INT AS pos, try_cast(json_extract_string(x, '$') AS INT) AS year FROM value WHERE child = 'year' AND json_type(x) <> 'NULL'",
}
