"""Text operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.operators import recognise, records
from umbra.session import spread
from umbra.sources.tables import table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", "source", "name", "lang", "category"))


def dataset_stats(spark, folder):
    return records.stats(table(spark, folder, "dataset_record"))


def recode_text(spark, folder):
    written = F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\\n")), F.lit("\""), F.lit('\\"'))
    return _docs(spark, folder).select("doc_id", F.md5(T.recode(written)).alias("recoded"), F.length(written).cast("long").alias("written_length"))


def sentence_split(spark, folder):
    rows = _docs(spark, folder).where("text IS NOT NULL").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s"))
    return rows.select("doc_id", "n", "s.start", "s.end", F.md5("s.text").alias("digest"))


def sentence_counts(spark, folder):
    return _docs(spark, folder).where("text IS NOT NULL").select("source", F.size(T.sentences(F.col("text"))).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("n_sentences"), F.max("n").alias("most"))


def token_counts(spark, folder):
    return _docs(spark, folder).select(F.explode(T.words(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def sliding_chunks(spark, folder):
    rows = _docs(spark, folder).where("length(text) > 0").select("doc_id", F.posexplode(T.sliding(F.col("text"), 512, 50)).alias("n", "c"))
    return rows.select("doc_id", "n", "c.start", "c.end", F.md5("c.text").alias("digest"))


def truncate_chunks(spark, folder):
    return _docs(spark, folder).select("doc_id", F.md5(T.truncate(F.col("text"), 512)).alias("digest"), F.least(F.length("text"), F.lit(512)).alias("end"))


def training_windows(spark, folder):
    rows = _docs(spark, folder).where("text IS NOT NULL").select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) > 0")
    return rows.select("doc_id", F.posexplode(T.training_windows(F.col("w"), 64)).alias("n", "w")).select("doc_id", "n", F.size("w").cast("long").alias("n_words"), F.element_at("w", 1).alias("first"), F.element_at("w", -1).alias("last"))


def token_chunks(spark, folder):
    rows = _docs(spark, folder).where("text IS NOT NULL").select("doc_id", T.tokens("text").alias("t"))
    return rows.select("doc_id", F.posexplode(T.token_chunks(F.col("t"), 128)).alias("no", "c")).select("doc_id", "no", "c.start", "c.end", F.col("c.n").alias("n_tokens"))


def token_spans(spark, folder):
    rows = _docs(spark, folder).where("text IS NOT NULL").select("doc_id", F.explode(T.tokens("text")).alias("t"))
    punctuation = T.is_punctuation(F.col("t.text")).cast("long")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.sum(punctuation).alias("n_punctuation"), F.sum(F.col("t.end") - F.col("t.start")).alias("n_chars"))


def ignored_tokens(spark, folder):
    words = _docs(spark, folder).where("text IS NOT NULL").select(F.explode(F.split("text", r"\s+")).alias("token")).distinct()
    return words.select("token", T.is_ignored(F.col("token"), F.array(*[F.lit(x) for x in IGNORED])).alias("ignored"))


# A short English stop list and the mask.
IGNORED = ("the", "of", "and", "a", "an", "to", "in", "on", "for", "with", "that", "this", "its", "their", "no", "some", "every", "[mask]", "mask")


def case_transfer(spark, folder):
    rows = _docs(spark, folder).where("name IS NOT NULL AND source IS NOT NULL")
    return rows.select("doc_id", T.transfer_case(F.lower("source"), F.col("name")).alias("by_name"), T.transfer_case(F.col("source"), F.upper("source")).alias("upper"))


def first_occurrence_mask(spark, folder):
    rows = _docs(spark, folder).where("text IS NOT NULL")
    return rows.select("doc_id", F.md5(T.mask_first(F.col("text"), F.lit("an"))).alias("digest"))


def age_group(spark, folder):
    posts = table(spark, folder, "reddit").select("post_id", "personality").distinct()
    return posts.select(T.age_group(F.col("personality.age")).alias("age_group")).groupBy("age_group").agg(F.count("*").alias("n"))


PERSONA = ("age", "sex", "city_country", "birth_city_country", "education", "occupation", "income", "income_level", "relationship_status")


def persona_hash(spark, folder):
    posts = table(spark, folder, "reddit").where("personality IS NOT NULL")
    return posts.select("post_id", T.persona_hash([(k, F.col(f"personality.{k}")) for k in PERSONA]).alias("name")).distinct()


def reddit_records(spark, folder):
    """Kept rows of the question and answer pairs: blank answers fall out, numbers count all rows."""
    posts = table(spark, folder, "reddit").groupBy("post_id").agg(F.max("response").alias("response"))
    numbered = posts.withColumn("row", F.col("post_id"))
    text = T.strip(F.col("response"))
    return numbered.where(F.length(text) > 0).select(F.concat(F.lit("reddit_"), F.col("row").cast("string")).alias("uid"), F.md5(text).alias("text"))


def recognise_pii(spark, folder):
    rows = _docs(spark, folder).where("text IS NOT NULL").select("doc_id", F.posexplode(recognise.recognise(F.col("text"))).alias("n", "s"))
    return rows.select("doc_id", "n", "s.start", "s.end", "s.label", "s.text")


def mask_pii(spark, folder):
    rows = recognise.redact(_docs(spark, folder).where("text IS NOT NULL").select("doc_id", "text"))
    return rows.select("doc_id", F.md5("masked").alias("digest"), F.size("spans").cast("long").alias("n_spans"))


def mask_summary(spark, folder):
    rows = recognise.redact(_docs(spark, folder).where("text IS NOT NULL").select("source", "text"))
    return rows.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.size("spans")).alias("n_spans"), F.sum(F.length("masked")).alias("masked_chars"), F.sum(F.length("text")).alias("chars"))


QUERIES = {f.__name__: f for f in (dataset_stats, recode_text, sentence_split, sentence_counts, token_counts, sliding_chunks, truncate_chunks, training_windows, token_chunks, token_spans, ignored_tokens, case_transfer, first_occurrence_mask, age_group, persona_hash, reddit_records, recognise_pii, mask_pii, mask_summary)}

_SENTENCES = r"""
    s AS (
        SELECT doc_id, source, list_filter(CASE WHEN length(text) = 0 THEN [''] ELSE regexp_extract_all(text, '(?s)(.*?[.!?]+\s+|.+$)', 1) END, lambda x: x IS NOT NULL) AS parts
        FROM documents WHERE text IS NOT NULL
    )
"""
_ANY = recognise.ANY.replace("'", "''")
_LABEL = "CASE " + " ".join(f"WHEN regexp_full_match(v, '{p}') THEN '{label}'" for label, p in recognise.RECOGNISERS.items()) + " END"
FOUND = f"""
    d AS (SELECT doc_id, source, text, regexp_extract_all(text, '{_ANY}') AS found, regexp_split_to_array(text, '{_ANY}') AS gaps FROM documents WHERE text IS NOT NULL),
    f AS (SELECT doc_id, unnest(found) AS v, unnest(range(len(found))) AS n, gaps FROM d),
    o AS (
        SELECT doc_id, n, v, {_LABEL} AS label,
               list_sum(list_transform(gaps[1:n + 1], lambda x: length(x))) + coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM f
    )
"""
MASKED = f"""
    {FOUND},
    m AS (SELECT doc_id, string_agg(gap || coalesce('[' || label || ']', ''), '' ORDER BY k) AS masked, count(label) AS n_spans
          FROM (SELECT d.doc_id, g.k, g.gap, o.label FROM d, LATERAL (SELECT unnest(d.gaps) AS gap, unnest(range(len(d.gaps))) AS k) g LEFT JOIN o ON o.doc_id = d.doc_id AND o.n = g.k) GROUP BY doc_id)
"""

SQL = {
    "dataset_stats": """
        SELECT source, count(*) AS n_records, count(DISTINCT uid) AS n_uids, count(DISTINCT name) AS n_names,
               len(list_distinct(flatten(list(coalesce(map_keys(metadata), []))))) AS n_keys, round(avg(length(text)), 6) AS avg_length, max(length(text)) AS max_length
        FROM dataset_record GROUP BY source
    """,
    "recode_text": r"""
        SELECT doc_id, md5(text) AS recoded, length(replace(replace(text, chr(10), '\n'), '"', '\"')) AS written_length FROM documents
    """,
    "sentence_split": f"""
        WITH {_SENTENCES}, p AS (SELECT doc_id, unnest(parts) AS part, unnest(range(len(parts)))::INT AS n FROM s)
        SELECT doc_id, n, (sum(length(part)) OVER w - length(part))::INT AS start, (sum(length(part)) OVER w)::INT AS "end", md5(part) AS digest
        FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY n)
    """,
    "sentence_counts": f"WITH {_SENTENCES} SELECT source, sum(len(parts))::BIGINT AS n_sentences, max(len(parts)) AS most FROM s GROUP BY source",
    "token_counts": r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents) GROUP BY word",
    "sliding_chunks": """
        WITH c AS (SELECT doc_id, text, unnest(range(greatest(ceil((length(text) - 50) / 462.0), 1)::BIGINT))::INT AS n FROM documents WHERE length(text) > 0)
        SELECT doc_id, n, n * 462 AS start, least(n * 462 + 512, length(text))::INT AS "end", md5(substring(text, n * 462 + 1, 512)) AS digest FROM c
    """,
    "truncate_chunks": "SELECT doc_id, md5(left(text, 512)) AS digest, least(length(text), 512)::INT AS \"end\" FROM documents",
    "training_windows": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, w, unnest(range(greatest(ceil((len(w) - 16) / 48.0), 1)::BIGINT))::INT AS n FROM w WHERE len(w) > 0)
        SELECT doc_id, n, len(w[n * 48 + 1:n * 48 + 64]) AS n_words, w[n * 48 + 1] AS first, w[least(n * 48 + 64, len(w))] AS last FROM c
    """,
    "token_chunks": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t, regexp_split_to_array(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM documents WHERE text IS NOT NULL),
        u AS (SELECT doc_id, unnest(t) AS v, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM t),
        o AS (SELECT doc_id, i, (sum(length(v) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i)) AS stop, length(v) AS n FROM u)
        SELECT doc_id, (i // 128)::INT AS no, min(stop - n)::INT AS start, max(stop)::INT AS "end", count(*)::INT AS n_tokens FROM o GROUP BY doc_id, i // 128
    """,
    "token_spans": r"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS v FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (instr('!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', v) > 0) AS n_punctuation, sum(length(v))::BIGINT AS n_chars FROM t GROUP BY doc_id
    """,
    "ignored_tokens": r"""
        WITH t AS (SELECT DISTINCT unnest(regexp_split_to_array(text, '[\t\n\x0b\f\r ]+')) AS token FROM documents WHERE text IS NOT NULL),
        k AS (SELECT token, regexp_replace(token, '[^\nA-Za-z0-9À-ÖØ-öø-ÿЀ-ӿ/]', '', 'g') AS kept FROM t)
        SELECT token, regexp_full_match(token, '[\s  - 　]*') OR kept = '' OR list_contains(['the','of','and','a','an','to','in','on','for','with','that','this','its','their','no','some','every','[mask]','mask'], lower(kept)) AS ignored FROM k
    """,
    "first_occurrence_mask": "SELECT doc_id, md5(CASE WHEN instr(text, 'an') > 0 THEN substring(text, 1, instr(text, 'an') - 1) || '[MASK]' || substring(text, instr(text, 'an') + 2) ELSE text END) AS digest FROM documents WHERE text IS NOT NULL",
    "case_transfer": """
        WITH d AS (SELECT doc_id, source, name, lower(source) AS p FROM documents WHERE name IS NOT NULL AND source IS NOT NULL)
        SELECT doc_id, CASE WHEN length(p) = length(name) THEN array_to_string(list_transform(range(1, length(p) + 1), lambda i: CASE WHEN substring(name, i, 1) = upper(substring(name, i, 1)) AND substring(name, i, 1) <> lower(substring(name, i, 1)) THEN upper(substring(p, i, 1)) ELSE lower(substring(p, i, 1)) END), '')
                            WHEN left(name, 1) = upper(left(name, 1)) AND left(name, 1) <> lower(left(name, 1)) THEN upper(left(p, 1)) || lower(substring(p, 2)) ELSE p END AS by_name,
               array_to_string(list_transform(range(1, length(source) + 1), lambda i: CASE WHEN upper(substring(source, i, 1)) <> lower(substring(source, i, 1)) THEN upper(substring(source, i, 1)) ELSE lower(substring(source, i, 1)) END), '') AS upper
        FROM d
    """,
    "age_group": """
        WITH p AS (SELECT DISTINCT post_id, personality FROM reddit)
        SELECT CASE WHEN personality.age < 18 THEN 'under_18' WHEN personality.age < 25 THEN '18_24' WHEN personality.age < 35 THEN '25_34' WHEN personality.age < 45 THEN '35_44' WHEN personality.age < 55 THEN '45_54' WHEN personality.age < 65 THEN '55_64' WHEN personality.age IS NOT NULL THEN '65_plus' END AS age_group, count(*) AS n
        FROM p GROUP BY 1
    """,
    "persona_hash": "SELECT DISTINCT post_id, substring(sha256(" + " || '|' || ".join(f"'{k}=' || coalesce(personality.{k}::VARCHAR, 'None')" for k in sorted(PERSONA)) + "), 1, 16) AS name FROM reddit WHERE personality IS NOT NULL",
    "reddit_records": r"""
        WITH p AS (SELECT post_id, max(response) AS response FROM reddit GROUP BY post_id),
        t AS (SELECT post_id, regexp_replace(regexp_replace(response, '^[\s  - 　]+', ''), '[\s  - 　]+$', '') AS text FROM p)
        SELECT 'reddit_' || post_id AS uid, md5(text) AS text FROM t WHERE length(text) > 0
    """,
    "recognise_pii": f"WITH {FOUND} SELECT doc_id, n::INT AS n, start::INT AS start, (start + length(v))::INT AS \"end\", label, v AS text FROM o",
    "mask_pii": f"WITH {MASKED} SELECT doc_id, md5(masked) AS digest, n_spans FROM m",
    "mask_summary": f"WITH {MASKED} SELECT d.source, count(*) AS n_documents, sum(n_spans)::BIGINT AS n_spans, sum(length(masked))::BIGINT AS masked_chars, sum(length(d.text))::BIGINT AS chars FROM m JOIN d USING (doc_id) GROUP BY d.source",
}
