"""Attack model, divergence, budgets, utility and detection scores as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import sampling
from umbra.functions import text as T
from umbra.functions import vectors as V
from umbra.operators import detection, dp, kanon, nested, recognise, records, scoring, similarity, utility
from umbra.operators import spans as OS
from umbra.plans import nested_queries, span_queries, text_queries
from umbra.session import spread
from umbra.sources.tables import table
from umbra.streaming import pipelines


def _identities(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a known source, which is the identity that the attack tells."""
    docs = table(spark, folder, "documents").where("text IS NOT NULL AND source IS NOT NULL")
    return spread(docs.select("doc_id", "text", F.lower(F.trim("source")).alias("name"), "lang", "category"))


def _masked(docs: DataFrame) -> DataFrame:
    return recognise.redact(docs).select("doc_id", "name", "masked")


def _truth(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("name").alias("label"))


def label_dictionary(spark, folder):
    return scoring.label_ids(_identities(spark, folder))


def label_mapping_check(spark, folder):
    docs = _identities(spark, folder)
    return scoring.mapping_difference(docs.select("name"), table(spark, folder, "mix_target").select(F.col("source").alias("name")))


def label_parse(spark, folder):
    return table(spark, folder, "dataset_record").select("uid", scoring.label_number(F.col("uid")).alias("n")).distinct()


def nb_scores(spark, folder):
    docs = _identities(spark, folder)
    return scoring.NaiveBayes(docs).best(docs, "doc_id").select("doc_id", "predicted", F.round("score", 4).alias("score"))


def _ranks(spark, folder):
    docs = _identities(spark, folder)
    model = scoring.NaiveBayes(docs)
    before, after = model.ranks(docs, "doc_id"), model.ranks(_masked(docs), "doc_id", text="masked")
    return docs, model, before, after


def reid_ranks(spark, folder):
    docs = _identities(spark, folder)
    return scoring.NaiveBayes(docs).ranks(docs, "doc_id")


def rank_deltas(spark, folder):
    _, _, before, after = _ranks(spark, folder)
    return scoring.rank_deltas(before, after, "doc_id")


def rank_delta_summary(spark, folder):
    _, _, before, after = _ranks(spark, folder)
    return scoring.summary(scoring.rank_deltas(before, after, "doc_id"), "delta").withColumn("score", F.lit(0.0))


def reid_accuracy(spark, folder):
    docs = _identities(spark, folder)
    return scoring.accuracy(scoring.NaiveBayes(docs).best(docs, "doc_id"), _truth(docs), "doc_id")


def individual_accuracy(spark, folder):
    docs = _identities(spark, folder)
    return scoring.individual_accuracy(scoring.NaiveBayes(docs).summed(docs))


def reid_top_k(spark, folder):
    docs = _identities(spark, folder)
    return scoring.top_k(scoring.NaiveBayes(docs).ranks(docs, "doc_id"))


def _chances(spark, folder):
    marks = records.annotations_once(table(spark, folder, "text_annotation"))
    return marks.where("label IS NOT NULL AND annotator IS NOT NULL").select("uid", "annotator", "label", "confidence")


def prob_max_merge(spark, folder):
    return scoring.merge_max(_chances(spark, folder), ["uid", "label"], "confidence")


def prob_mean_merge(spark, folder):
    return scoring.merge_mean(_chances(spark, folder), "uid", "label", "confidence", "annotator")


def score_average(spark, folder):
    return _chances(spark, folder).groupBy("uid").agg(scoring.rounded(F.coalesce(scoring.exact_mean("confidence"), F.lit(0.0)), 6).alias("average"), F.coalesce(F.max("confidence"), F.lit(0.0)).alias("greatest"))


def greedy_explain(spark, folder):
    docs = _identities(spark, folder)
    told = scoring.explain(scoring.NaiveBayes(docs), docs, "doc_id")
    return told.groupBy("doc_id").agg(F.max(F.struct("score", "word")).alias("b"), F.count("*").alias("n_words")).select("doc_id", "n_words", F.round("b.score", 6).alias("score"))


IGNORED = ("the", "of", "and", "to", "in", "no", "that", "this", "its", "their", "some", "every", "one", "another", "any")


def _trace(spark, folder, most):
    docs = _identities(spark, folder)
    return kanon.trace(scoring.NaiveBayes(docs), docs.withColumnRenamed("name", "label"), "doc_id", "label", most, IGNORED)


def petre_trace(spark, folder):
    return _trace(spark, folder, 5)


def petre_first(spark, folder):
    """The first word that a trace masks, and the rank after it."""
    return _trace(spark, folder, 5).where("step = 1").select("doc_id", "word", F.col("rank").cast("long").alias("rank"))


def petre_grid(spark, folder):
    grid = kanon.grid(_trace(spark, folder, 5), "doc_id", (2, 3, 5))
    return grid.select("doc_id", "k", "step", "rank", F.size("words").alias("n_masked"))


def uniform_budget(spark, folder):
    rows = _identities(spark, folder).select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) > 0")
    weights = sampling.let(F.size("w"), lambda n: F.transform("w", lambda w: F.lit(1.0) / n))
    grid = spark.createDataFrame([(10.0,), (25.0,), (100.0,), (250.0,)], "epsilon double")
    budgets = sampling.token_budgets(F.col("weights"), F.col("epsilon"), F.lit(1.0))
    every = rows.select("doc_id", weights.alias("weights")).crossJoin(grid).select("doc_id", "epsilon", budgets.alias("b"))
    return every.select("doc_id", "epsilon", F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 4).alias("spent"), F.round(sampling.temperature(F.col("epsilon")), 6).alias("temperature"))


def weighted_budget(spark, folder):
    rows = _identities(spark, folder).select("doc_id", T.words(F.col("text")).alias("w")).where("size(w) > 0")
    weights = sampling.softmax(F.transform("w", lambda w: F.length(w).cast("double")), 4.0)
    measure = lambda b: F.struct(F.array_min(b).alias("least"), (F.size(b) / F.aggregate(b, F.lit(0.0), lambda a, x: a + 1 / x)).alias("harmonic"))
    each = rows.select("doc_id", sampling.let(sampling.token_budgets(weights, F.lit(10.0), F.lit(1.0)), measure).alias("m"))
    return each.select("doc_id", F.round("m.least", 5).alias("least"), F.round("m.harmonic", 6).alias("harmonic_mean"))


def budget_compensation(spark, folder):
    rows = _identities(spark, folder).select("doc_id", T.tokens("text").alias("t"), recognise.recognise(F.col("text")).alias("spans"))
    free = F.filter("t", lambda t: ~T.is_punctuation(t["text"]))
    met = lambda held: F.size(F.filter(free, lambda t: (F.size(held) == 0) | F.exists(held, lambda s: (t["end"] > s["start"]) & (t["start"] < s["end"]))))
    counted = rows.select("doc_id", sampling.let(F.col("spans"), met).alias("n"), F.size(free).alias("all"))
    ratio = F.greatest(F.col("n") / F.nullif(F.col("all"), F.lit(0)), F.lit(1e-6))
    return counted.select("doc_id", F.col("n").cast("long").alias("n_critical"), F.round(F.coalesce(ratio, F.lit(1.0)), 6).alias("ratio"))


def _public(spark, folder):
    """A corpus other than the protected one: the texts of the court cases."""
    return spread(table(spark, folder, "tab").where("text IS NOT NULL").select("text").distinct())


def dp_candidates(spark, folder):
    held = dp.Candidates(_public(spark, folder)).levels
    return held.select("left", F.explode("levels").alias("l")).select("left", "l.level", "l.first", "l.size")


def dp_draws(spark, folder):
    docs = _identities(spark, folder)
    drawn = dp.Candidates(_public(spark, folder)).draw(dp.budgets(docs, "doc_id", 25.0).where("free"), F.lit(2 * 8.0 / 25.0), F.concat_ws(":", F.col("doc_id").cast("string"), "pos"), 7, "word")
    return drawn.groupBy("doc_id").agg(F.count("*").alias("n_drawn"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda t: t["word"]), " ")).alias("digest"))


def dp_token_budgets(spark, folder):
    docs = _identities(spark, folder).withColumn("spans", recognise.recognise(F.col("text")))
    each = dp.budgets(docs, "doc_id", 10.0, "spans", F.length("token").cast("double"), 4.0, True).where("free")
    return each.groupBy("doc_id").agg(F.count("*").alias("n_free"), F.round(F.min("epsilon"), 6).alias("least"), F.round(F.max("epsilon"), 4).alias("greatest"))


def dp_token_sample(spark, folder):
    return dp.perturb(_identities(spark, folder), "doc_id", 25.0, _public(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_if(F.col("token") != F.col("private")).alias("n_perturbed"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "private"))), lambda t: t["private"]), " ")).alias("digest"))


def dp_rewrite(spark, folder):
    docs = _identities(spark, folder)
    out = dp.rewrite(docs, dp.perturb(docs, "doc_id", 25.0, _public(spark, folder), add=0.05, delete=0.05), "doc_id")
    return out.select("doc_id", F.md5("text").alias("digest"), "n_tokens", "n_perturbed", "n_added", "n_deleted")


def gaussian_scale(spark, folder):
    rows = table(spark, folder, "embeddings")
    noisy = sampling.noisy_vector(F.col("embedding"), F.col("vec_id").cast("string"), 64, 10.0)
    return rows.select("vec_id", F.round(V.norm(noisy), 5).alias("norm"), F.round(V.cosine(F.col("embedding"), noisy), 5).alias("cosine"))


def tfidf_cosine(spark, folder):
    return similarity.tfidf_cosine(recognise.redact(_identities(spark, folder)), "doc_id")


def overlap_f1(spark, folder):
    return similarity.overlap_f1(recognise.redact(_identities(spark, folder)), "doc_id")


def _divergence(spark, folder):
    docs = _identities(spark, folder)
    similar = similarity.tfidf_cosine(recognise.redact(docs), "doc_id")
    return docs.select("doc_id", "category").join(similar, "doc_id").withColumn("divergence", F.round(1 - F.col("similarity"), 6))


def divergence_summary(spark, folder):
    return scoring.summary(_divergence(spark, folder), "divergence", ["category"]).drop("improved", "degraded", "unchanged")


def macro_divergence(spark, folder):
    return similarity.macro(divergence_summary(spark, folder))


def utility_labels(spark, folder):
    rows = table(spark, folder, "dataset_record").groupBy("uid").agg(F.max(F.struct("loaded_at", F.map_entries("metadata").alias("m"))).alias("r"))
    value = lambda name: F.element_at(F.map_from_entries("r.m"), F.lit(name))
    return rows.select("uid", utility.number_target(value("stars")).alias("stars"), utility.text_target(value("category")).alias("category"), utility.text_target(value("feature")).alias("feature"))


def reddit_targets(spark, folder):
    """The six targets of question and answer pairs."""
    rows = table(spark, folder, "reddit").where("post_id IS NOT NULL").groupBy("post_id").agg(F.max(F.struct("loaded_at", "label", "feature", "personality")).alias("r"))
    raw = {"reddit_feature": F.col("r.feature"), "reddit_label": F.col("r.label"), "reddit_age": F.col("r.personality.age"), "reddit_age_group": F.col("r.personality.age"), "reddit_sex": F.col("r.personality.sex"), "reddit_income_level": F.col("r.personality.income_level")}
    return rows.select("post_id", *[utility.target(name, value).alias(name.removeprefix("reddit_")) for name, value in raw.items()])


def tab_targets(spark, folder):
    """Country and first numeric year of court cases."""
    tables = nested.case_tables(table(spark, folder, "tab"))
    gather = lambda name, value: tables[name].groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value))), lambda x: x[value].cast("string")).alias(value))
    met = gather("countries", "country").join(gather("years", "year"), "doc_id", "full")
    return met.select("doc_id", utility.target("tab_country", F.col("country"), True).alias("country"), utility.target("tab_year", F.col("year"), True).alias("year"))


def utility_perceptron(spark, folder):
    docs = recognise.redact(_identities(spark, folder)).withColumn("size", F.length("text").cast("double"))
    return utility.Experiment(docs.select("doc_id", "text", "masked", "size"), "doc_id", "size", "perceptron_regressor", 2_000).drops("masked")

def stratified_split(spark, folder):
    return utility.split(_identities(spark, folder).select("doc_id", "category"), "doc_id", "category", 0.25).select("doc_id", "category", "is_test")


def macro_f1(spark, folder):
    docs = _identities(spark, folder)
    guessed = scoring.NaiveBayes(docs).best(docs, "doc_id")
    return utility.f1(guessed.join(_truth(docs), "doc_id"))


def utility_drops(spark, folder):
    docs = recognise.redact(_identities(spark, folder))
    return utility.Experiment(docs.select("doc_id", "text", "masked", "category"), "doc_id", "category", "logistic").drops("masked")


def utility_regression(spark, folder):
    docs = recognise.redact(_identities(spark, folder)).withColumn("size", F.length("text").cast("double"))
    return utility.Experiment(docs.select("doc_id", "text", "masked", "size"), "doc_id", "size", "linear").drops("masked")


def _two(spark, folder):
    """Marks of each annotator of a record against those of its first annotator; uid names record and annotator, doc the record."""
    marks = records.annotations_once(table(spark, folder, "text_annotation")).where("start IS NOT NULL AND `end` > start AND label IS NOT NULL")
    marks = marks.where("annotator IS NOT NULL").select("uid", "annotator", "start", "end", "label").distinct()
    givers = marks.groupBy("uid").agg(F.min("annotator").alias("first"), F.array_distinct(F.collect_set("annotator")).alias("all")).where("size(all) > 1")
    others = givers.select("uid", "first", F.explode(F.array_except("all", F.array("first"))).alias("other"))
    key = lambda who: F.concat_ws("|", "uid", who).alias("uid")
    gold = marks.join(others, (marks["uid"] == others["uid"]) & (marks["annotator"] == others["first"])).drop(others["uid"])
    found = marks.join(others, (marks["uid"] == others["uid"]) & (marks["annotator"] == others["other"])).drop(others["uid"])
    shown = lambda rows: rows.select(key("other"), F.col("uid").alias("doc"), "start", "end", "label")
    return shown(gold), shown(found)


def pii_prf(spark, folder):
    return detection.prf(*_two(spark, folder))


def pii_matches(spark, folder):
    return detection.matches(*_two(spark, folder))


def char_prf(spark, folder):
    texts = records.once(table(spark, folder, "dataset_record"))
    texts = texts.select(F.col("uid").alias("doc"), "text")
    tag = lambda rows: OS.char_labels(texts.join(rows.groupBy("uid", "doc").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans")), "doc"))
    a, b = _two(spark, folder)
    return detection.char_prf(tag(a), tag(b))


def batch_stream_equal(spark, folder):
    return pipelines.redacted(spark, folder).select("doc_id", F.md5("masked").alias("digest"), "n_spans")


QUERIES = {f.__name__: f for f in (label_dictionary, label_mapping_check, label_parse, nb_scores, reid_ranks, rank_deltas, rank_delta_summary, reid_accuracy, individual_accuracy, reid_top_k, prob_max_merge, prob_mean_merge, score_average, greedy_explain, petre_trace, petre_first, petre_grid, uniform_budget, weighted_budget, budget_compensation, dp_candidates, dp_draws, dp_token_budgets, dp_token_sample, dp_rewrite, gaussian_scale, tfidf_cosine, overlap_f1, divergence_summary, macro_divergence, utility_labels, reddit_targets, tab_targets, utility_perceptron, stratified_split, macro_f1, utility_drops, utility_regression, pii_prf, pii_matches, char_prf, batch_stream_equal)}

_ID = "idn AS (SELECT doc_id, text, lower(trim(source, ' ')) AS name, category FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"
_ORIGINAL = "ow AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS word FROM idn) GROUP BY doc_id, word)"
_REWRITTEN = f"""{text_queries.MASKED},
    mw AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(masked), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS word FROM m WHERE doc_id IN (SELECT doc_id FROM idn)) GROUP BY doc_id, word)"""
_MODEL = f"""{_ID}, {_ORIGINAL},
    bl AS (SELECT name AS label, word, sum(n) AS c FROM ow JOIN idn USING (doc_id) GROUP BY name, word),
    lb AS (SELECT d.label, ln(d.docs / (SELECT count(*) FROM idn)::DOUBLE) AS prior, ln(1.0) - ln(t.total + (SELECT count(DISTINCT word) FROM bl)) AS unseen
           FROM (SELECT name AS label, count(*) AS docs FROM idn GROUP BY name) d JOIN (SELECT label, sum(c) AS total FROM bl GROUP BY label) t USING (label))"""


def _score(words: str, name: str) -> str:
    return f"""
    {name}_len AS (SELECT idn.doc_id, coalesce(sum(w.n), 0) AS length FROM idn LEFT JOIN {words} w USING (doc_id) GROUP BY idn.doc_id),
    {name}_gain AS (SELECT w.doc_id, bl.label, sum(w.n * ln(bl.c + 1.0)) AS gain FROM {words} w JOIN bl USING (word) GROUP BY w.doc_id, bl.label),
    {name} AS (SELECT l.doc_id, lb.label, lb.prior + l.length * lb.unseen + coalesce(g.gain, 0) AS score FROM {name}_len l CROSS JOIN lb LEFT JOIN {name}_gain g USING (doc_id, label)),
    {name}_own AS (SELECT s.doc_id, s.label, s.score FROM {name} s JOIN idn ON idn.doc_id = s.doc_id AND idn.name = s.label),
    {name}_rank AS (SELECT s.doc_id, sum((s.score > o.score OR s.score = o.score AND s.label > o.label)::INT) + 1 AS rank FROM {name} s JOIN {name}_own o USING (doc_id) GROUP BY s.doc_id),
    {name}_top AS (SELECT doc_id, max(struct_pack(score := score, label := label)) AS b FROM {name} GROUP BY doc_id)"""


_SCORED = f"WITH {_MODEL}, {_score('ow', 's')}"
_BOTH = f"{_SCORED}, {_REWRITTEN}, {_score('mw', 'r')}, delta AS (SELECT doc_id, s_rank.rank::BIGINT AS before, r_rank.rank::BIGINT AS after, (r_rank.rank - s_rank.rank)::BIGINT AS delta FROM s_rank JOIN r_rank USING (doc_id))"
_SUMMARY = "count({0}) AS count, round(avg({0}), 6) AS mean, median({0})::DOUBLE AS median, min({0}) AS min, max({0}) AS max"
_CHANCES = f"{span_queries.WITH}, ch AS (SELECT uid, annotator, label, confidence FROM ann WHERE label IS NOT NULL AND annotator IS NOT NULL)"
_COSINE = f"""WITH {_ID}, {_ORIGINAL}, {_REWRITTEN},
    idf AS (SELECT word, ln((1 + (SELECT count(*) FROM idn)) / (1.0 + count(*))) + 1 AS idf FROM ow GROUP BY word),
    pv AS (SELECT coalesce(ow.doc_id, mw.doc_id) AS doc_id, coalesce(ow.word, mw.word) AS word, coalesce(ow.n, 0) AS a, coalesce(mw.n, 0) AS b FROM ow FULL JOIN mw ON ow.doc_id = mw.doc_id AND ow.word = mw.word),
    sm AS (SELECT doc_id, sum(a * b * idf * idf) AS ab, sum(a * a * idf * idf) AS aa, sum(b * b * idf * idf) AS bb FROM pv JOIN idf USING (word) GROUP BY doc_id),
    cs AS (SELECT idn.doc_id, category, round(coalesce(CASE WHEN aa > 0 AND bb > 0 THEN ab / sqrt(aa) / sqrt(bb) END, 0), 6) AS similarity FROM idn LEFT JOIN sm USING (doc_id)),
    dv AS (SELECT category, round(1 - similarity, 6) AS divergence FROM cs)"""
_WORDS = f"WITH {_ID}, w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM idn)"
_TWO = f"""{span_queries.WITH},
    mk AS (SELECT DISTINCT uid, annotator, start, "end", label FROM ann WHERE start IS NOT NULL AND "end" > start AND label IS NOT NULL AND annotator IS NOT NULL),
    bu AS (SELECT DISTINCT uid, annotator AS other, first FROM mk JOIN (SELECT uid, min(annotator) AS first FROM mk GROUP BY uid) USING (uid) WHERE annotator <> first),
    g AS (SELECT mk.uid || '|' || other AS uid, mk.uid AS doc, start, "end", label FROM mk JOIN bu ON mk.uid = bu.uid AND mk.annotator = bu.first),
    f AS (SELECT mk.uid || '|' || other AS uid, mk.uid AS doc, start, "end", label FROM mk JOIN bu ON mk.uid = bu.uid AND mk.annotator = bu.other),
    best AS (SELECT f.uid, f.start, f."end", f.label, max(CASE WHEN g.uid IS NULL THEN 0 WHEN f.start = g.start AND f."end" = g."end" AND f.label = g.label THEN 3 WHEN f.start = g.start AND f."end" = g."end" THEN 2 ELSE 1 END) AS o
             FROM f LEFT JOIN g ON f.uid = g.uid AND f.start < g."end" AND f."end" > g.start GROUP BY f.uid, f.start, f."end", f.label),
    oc AS (SELECT label, ['spurious', 'partial', 'typed', 'correct'][o + 1] AS outcome FROM best
           UNION ALL SELECT label, 'missed' FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.uid = g.uid AND f.start < g."end" AND f."end" > g.start))"""


def _tags(side: str) -> str:
    return f"""
    {side}k AS (SELECT {side}.uid, row_number() OVER (PARTITION BY {side}.uid ORDER BY start, "end", label) AS rank, start, least("end", length(rec.text)) AS stop, regexp_replace(label, '^[BI]-', '') AS label, length(rec.text) AS n FROM {side} JOIN rec ON rec.uid = {side}.doc),
    {side}c AS (SELECT uid, rank, start, label, unnest(range(start, stop)) AS pos FROM {side}k WHERE start >= 0 AND start < n AND start < stop),
    {side}t AS (SELECT uid, pos, max_by(CASE WHEN pos = start THEN 'B-' ELSE 'I-' END || label, rank) AS tag FROM {side}c GROUP BY uid, pos)"""


# tokens of the private and the public texts with their neighbours, and the numbered candidates
_MARKS = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_UNIFORM = "('0x' || substr(md5(doc_id || ':' || pos || '|{0}'), 1, 8))::BIGINT / 4294967296.0"
_TOKENS = "SELECT {0} AS doc_id, unnest(t) AS token, unnest(range(len(t))) AS pos, unnest(list_prepend('', list_transform(t[1:len(t) - 1], lambda x: lower(x)))) AS \"left\" FROM (SELECT *, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]') AS t FROM {1}) WHERE len(t) > 0"
_DP = f"""WITH {_ID}, pb AS (SELECT DISTINCT text FROM tab WHERE text IS NOT NULL),
    it AS ({_TOKENS.format('doc_id', 'idn')}), pt AS ({_TOKENS.format('0', 'pb')}),
    ct AS (SELECT \"left\", lower(token) AS word, count(*) AS n FROM pt WHERE instr('{_MARKS}', token) = 0 GROUP BY \"left\", lower(token)),
    al AS (SELECT * FROM ct UNION ALL SELECT '*', word, sum(n) FROM ct GROUP BY word),
    lv AS (SELECT \"left\", word, floor(greatest(least(ln(n), 8.0), 0.0) / 0.25 + 1e-9)::INT AS level FROM al),
    pl AS (SELECT *, row_number() OVER (ORDER BY \"left\", level, word) - 1 AS place FROM lv)"""
_PRF = "round(coalesce({0} / nullif({1}, 0), 0), 6)"
_F1 = "round(coalesce(2 * ({0} / nullif({1}, 0)) * ({0} / nullif({2}, 0)) / nullif({0} / nullif({1}, 0) + {0} / nullif({2}, 0), 0), 0), 6)"

SQL = {
    "label_dictionary": f"WITH {_ID} SELECT name, (dense_rank() OVER (ORDER BY name) - 1)::INT AS id FROM (SELECT DISTINCT name FROM idn)",
    "label_mapping_check": f"WITH {_ID}, a AS (SELECT DISTINCT name FROM idn), b AS (SELECT DISTINCT source AS name FROM mix_target) SELECT name, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT name, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "label_parse": "SELECT DISTINCT uid, try_cast(nullif(regexp_extract(uid, '_([0-9]+)$', 1), '') AS INT) AS n FROM dataset_record",
    "nb_scores": f"{_SCORED} SELECT doc_id, b.label AS predicted, round(b.score, 4) AS score FROM s_top",
    "reid_ranks": f"{_SCORED} SELECT doc_id, rank::BIGINT AS rank FROM s_rank",
    "rank_deltas": f"{_BOTH} SELECT * FROM delta",
    "rank_delta_summary": f"{_BOTH} SELECT {_SUMMARY.format('delta')}, count(*) FILTER (delta > 0) AS improved, count(*) FILTER (delta < 0) AS degraded, count(*) FILTER (delta = 0) AS unchanged, 0.0::DOUBLE AS score FROM delta",
    "reid_accuracy": f"{_SCORED} SELECT round(avg((b.label = name)::INT), 6) AS accuracy, count(*) FILTER (b.label = name) AS correct, count(*) AS total FROM s_top JOIN idn USING (doc_id)",
    "individual_accuracy": f"{_SCORED}, z AS (SELECT idn.name AS true_label, s.label, sum(score) AS score FROM s JOIN idn USING (doc_id) GROUP BY idn.name, s.label) SELECT true_label, max(struct_pack(score := score, label := label)).label AS predicted FROM z GROUP BY true_label",
    "reid_top_k": f"{_SCORED} SELECT " + ", ".join(f"round(avg((rank <= {k})::INT), 6) AS top_{k}" for k in (1, 3, 5)) + ", round(avg(1.0 / rank), 6) AS mrr FROM s_rank",
    "prob_max_merge": f"{_CHANCES} SELECT uid, label, coalesce(max(confidence), 0) AS confidence FROM ch GROUP BY uid, label",
    "prob_mean_merge": f"{_CHANCES}, k AS (SELECT uid, count(DISTINCT annotator) AS n FROM ch GROUP BY uid) SELECT uid, label, round(sum(coalesce(confidence, 0)) / any_value(n), 6) AS confidence FROM ch JOIN k USING (uid) GROUP BY uid, label",
    "score_average": f"{_CHANCES} SELECT uid, round(coalesce(avg(confidence), 0), 6) AS average, coalesce(max(confidence), 0) AS greatest FROM ch GROUP BY uid",
    "uniform_budget": f"{_WORDS} SELECT doc_id, epsilon, round(len(w) * epsilon, 4) AS spent, round(2 * 19.514110587802122 / epsilon, 6) AS temperature FROM w CROSS JOIN (SELECT unnest([10.0, 25.0, 100.0, 250.0])::DOUBLE AS epsilon) WHERE len(w) > 0",
    "weighted_budget": f"{_WORDS}, x AS (SELECT doc_id, unnest(w) AS t, len(w) AS n, list_max(list_transform(w, lambda v: length(v))) AS top FROM w WHERE len(w) > 0), e AS (SELECT doc_id, n, exp((length(t) - top) / 4.0) AS e FROM x), z AS (SELECT doc_id, any_value(n) AS n, sum(e) AS z, max(e) AS m FROM e GROUP BY doc_id) SELECT doc_id, round(10.0 / (m / z * n), 5) AS least, 10.0::DOUBLE AS harmonic_mean FROM z",
    "budget_compensation": f"WITH {_ID}, {text_queries.FOUND}, " + r"""
        t0 AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t, regexp_split_to_array(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM idn),
        t1 AS (SELECT doc_id, unnest(t) AS v, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM t0),
        t2 AS (SELECT doc_id, v, sum(length(v) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM t1),
        c AS (SELECT doc_id, stop, length(v) AS n, EXISTS (SELECT 1 FROM o WHERE o.doc_id = t2.doc_id AND t2.stop > o.start AND t2.stop - length(t2.v) < o.start + length(o.v)) AS hit FROM t2 WHERE instr('!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', v) = 0),
        k AS (SELECT doc_id, count(*) AS free, count(*) FILTER (hit) AS hits FROM c GROUP BY doc_id)
        SELECT idn.doc_id, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.doc_id = idn.doc_id) THEN coalesce(hits, 0) ELSE coalesce(free, 0) END AS n_critical,
               round(coalesce(greatest(CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.doc_id = idn.doc_id) THEN hits ELSE free END / nullif(free, 0)::DOUBLE, 1e-6), 1.0), 6) AS ratio
        FROM idn LEFT JOIN k USING (doc_id)""",
    "greedy_explain": f"""{_SCORED}, zz AS (SELECT s.doc_id, b.label AS target, b.score AS top, sum(exp(s.score - b.score)) AS z FROM s JOIN s_top USING (doc_id) GROUP BY s.doc_id, b),
        mk AS (SELECT ow.doc_id, ow.word, s.label, s.score - lb.unseen - ln(coalesce(bl.c, 0) + 1.0) AS m FROM ow JOIN s USING (doc_id) JOIN lb ON lb.label = s.label LEFT JOIN bl ON bl.label = s.label AND bl.word = ow.word),
        tp AS (SELECT doc_id, word, max(m) AS m0 FROM mk GROUP BY doc_id, word),
        ch AS (SELECT mk.doc_id, mk.word, sum(CASE WHEN mk.label = zz.target THEN exp(mk.m - tp.m0) ELSE 0 END) / sum(exp(mk.m - tp.m0)) AS p, 1 / any_value(zz.z) AS p0 FROM mk JOIN tp USING (doc_id, word) JOIN zz USING (doc_id) GROUP BY mk.doc_id, mk.word)
        SELECT doc_id, count(*) AS n_words, round(max(round(p0 - p, 9)), 6) AS score FROM ch GROUP BY doc_id""",
    "petre_first": f"""{_SCORED},
        tk AS (SELECT doc_id, word, min(pos) AS first, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM idn)) GROUP BY doc_id, word),
        mk AS (SELECT tk.doc_id, tk.word, tk.first, s.label, s.score - tk.n * (lb.unseen + ln(coalesce(bl.c, 0) + 1.0)) AS m FROM tk JOIN s USING (doc_id) JOIN lb ON lb.label = s.label LEFT JOIN bl ON bl.label = s.label AND bl.word = tk.word
               WHERE tk.word NOT IN ({", ".join(f"'{w}'" for w in IGNORED)})),
        tp AS (SELECT doc_id, word, max(m) AS m0 FROM mk GROUP BY doc_id, word),
        ch AS (SELECT mk.doc_id, mk.word, any_value(mk.first) AS first, sum(CASE WHEN mk.label = idn.name THEN exp(mk.m - tp.m0) ELSE 0 END) / sum(exp(mk.m - tp.m0)) AS p FROM mk JOIN tp USING (doc_id, word) JOIN idn USING (doc_id) GROUP BY mk.doc_id, mk.word),
        pk AS (SELECT doc_id, list_reduce(list(struct_pack(p := p, word := word) ORDER BY first), lambda a, b: CASE WHEN a.p - b.p > 1e-12 THEN b ELSE a END).word AS word FROM ch JOIN s_rank USING (doc_id) WHERE rank < 5 GROUP BY doc_id),
        ow1 AS (SELECT mk.doc_id, mk.label, mk.m, o.m AS own, idn.name FROM mk JOIN pk USING (doc_id, word) JOIN idn USING (doc_id) JOIN mk o ON o.doc_id = mk.doc_id AND o.word = mk.word AND o.label = idn.name)
        SELECT doc_id, any_value(pk.word) AS word, sum((label <> name AND (m > own + 1e-9 OR abs(m - own) <= 1e-9 AND label > name))::INT)::BIGINT + 1 AS rank FROM ow1 JOIN pk USING (doc_id) GROUP BY doc_id""",
    "dp_token_budgets": f"WITH {_ID}, {text_queries.FOUND}, " + r"""
        t0 AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t, regexp_split_to_array(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS g FROM idn),
        t1 AS (SELECT doc_id, unnest(t) AS v, unnest(g[1:len(t)]) AS gap, unnest(range(len(t))) AS i FROM t0),
        t2 AS (SELECT doc_id, v, sum(length(v) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM t1),
        c AS (SELECT doc_id, length(v) AS n, EXISTS (SELECT 1 FROM o WHERE o.doc_id = t2.doc_id) AS held, EXISTS (SELECT 1 FROM o WHERE o.doc_id = t2.doc_id AND t2.stop > o.start AND t2.stop - length(t2.v) < o.start + length(o.v)) AS hit FROM t2 WHERE instr('!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', v) = 0),
        k AS (SELECT doc_id, count(*) AS n_all, count(*) FILTER (hit OR NOT held) AS n_free, max(n) FILTER (hit OR NOT held) AS top FROM c GROUP BY doc_id),
        w AS (SELECT c.doc_id, n_all, n_free, exp((n - top) / 4.0) AS e FROM c JOIN k USING (doc_id) WHERE hit OR NOT held),
        z AS (SELECT doc_id, sum(e) AS z FROM w GROUP BY doc_id)
        SELECT doc_id, count(*) AS n_free, round(min(10.0 * greatest(n_free / n_all::DOUBLE, 1e-6) / (e / z * n_free)), 6) AS least, round(max(10.0 * greatest(n_free / n_all::DOUBLE, 1e-6) / (e / z * n_free)), 4) AS greatest
        FROM w JOIN z USING (doc_id) GROUP BY doc_id""",
    "dp_candidates": f"{_DP} SELECT \"left\", level, min(place) AS first, count(*) AS size FROM pl GROUP BY \"left\", level",
    "dp_draws": f"""{_DP}, gr AS (SELECT \"left\", level, min(place) AS first, count(*) AS size FROM pl GROUP BY \"left\", level),
        fr AS (SELECT doc_id, pos, CASE WHEN \"left\" IN (SELECT \"left\" FROM gr) THEN \"left\" ELSE '*' END AS \"left\", {_UNIFORM.format(7)} AS u, {_UNIFORM.format(8)} AS v FROM it WHERE instr('{_MARKS}', token) = 0),
        wt AS (SELECT \"left\", level, first, size, size * exp((level - max(level) OVER (PARTITION BY \"left\")) * 0.25 / (16.0 / 25.0)) AS w FROM gr),
        up AS (SELECT *, sum(w) OVER (PARTITION BY \"left\" ORDER BY level) AS upto, sum(w) OVER (PARTITION BY \"left\") AS total FROM wt),
        pk AS (SELECT fr.doc_id, fr.pos, min_by(up.first + least(floor(fr.v * up.size), up.size - 1), up.level) AS place FROM fr JOIN up ON fr.\"left\" = up.\"left\" AND up.upto > fr.u * up.total GROUP BY fr.doc_id, fr.pos)
        SELECT pk.doc_id, count(*) AS n_drawn, md5(string_agg(word, ' ' ORDER BY pos)) AS digest FROM pk JOIN pl ON pl.place = pk.place GROUP BY pk.doc_id""",
    "tfidf_cosine": f"{_COSINE} SELECT doc_id, similarity FROM cs",
    "overlap_f1": f"{_COSINE} SELECT doc_id, round(2 * sum(least(a, b)) / (sum(a) + sum(b)), 6) AS f1 FROM pv GROUP BY doc_id",
    "divergence_summary": f"{_COSINE} SELECT category, {_SUMMARY.format('divergence')} FROM dv GROUP BY category",
    "macro_divergence": f"{_COSINE} SELECT round(avg(mean), 6) AS macro, count(*) AS n_datasets FROM (SELECT round(avg(divergence), 6) AS mean FROM dv GROUP BY category)",
    "utility_labels": """
        WITH r AS (SELECT uid, max_by(metadata, loaded_at) AS m FROM dataset_record GROUP BY uid)
        SELECT uid, try_cast(nullif(regexp_extract(m['stars'], '^\\s*([0-9]+(\\.[0-9]+)?)\\s*$', 1), '') AS DOUBLE) AS stars, nullif(trim(m['category']), '') AS category, nullif(trim(m['feature']), '') AS feature FROM r
    """.replace("\\\\", "\\"),
    "reddit_targets": r"""
        WITH r AS (SELECT post_id, max(struct_pack(t := loaded_at, label := label, feature := feature, p := personality)) AS r FROM reddit WHERE post_id IS NOT NULL GROUP BY post_id)
        SELECT post_id, nullif(trim(r.feature), '') AS feature, nullif(trim(r.label), '') AS label, r.p.age::DOUBLE AS age,
               CASE WHEN r.p.age < 18 THEN 'under_18' WHEN r.p.age < 25 THEN '18_24' WHEN r.p.age < 35 THEN '25_34' WHEN r.p.age < 45 THEN '35_44' WHEN r.p.age < 55 THEN '45_54' WHEN r.p.age < 65 THEN '55_64' WHEN r.p.age IS NOT NULL THEN '65_plus' END AS age_group,
               nullif(trim(r.p.sex), '') AS sex, nullif(trim(r.p.income_level), '') AS income_level FROM r
    """,
    "tab_targets": nested_queries._LATEST + r"""
        , c AS (SELECT doc_id, min_by(trim(json_extract_string(x, '$')), pos) AS country FROM value WHERE child = 'country' AND json_type(x) <> 'NULL' AND trim(json_extract_string(x, '$')) <> '' GROUP BY doc_id),
        y AS (SELECT doc_id, min_by(try_cast(json_extract_string(x, '$') AS INT), pos)::DOUBLE AS year FROM value WHERE child = 'year' AND json_type(x) <> 'NULL' AND try_cast(json_extract_string(x, '$') AS INT) IS NOT NULL GROUP BY doc_id),
        d AS (SELECT DISTINCT doc_id FROM value WHERE json_type(x) <> 'NULL')
        SELECT doc_id, country, year FROM d LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)
    """,
    "stratified_split": f"""WITH {_ID}, h AS (SELECT doc_id, category, row_number() OVER (PARTITION BY category ORDER BY md5(doc_id || '|42'), doc_id) AS k, count(*) OVER (PARTITION BY category) AS n FROM idn)
        SELECT doc_id, category, k <= CASE WHEN n < 2 THEN 0 ELSE least(greatest(round_even(n * 0.25, 0), 1), n - 1) END AS is_test FROM h""",
    "macro_f1": f"""{_SCORED}, p AS (SELECT name AS label, b.label AS predicted FROM s_top JOIN idn USING (doc_id)),
        h AS (SELECT label AS l, count(*) AS n_true, count(*) FILTER (label = predicted) AS tp FROM p GROUP BY label), q AS (SELECT predicted AS l, count(*) AS n_guess FROM p GROUP BY predicted),
        o AS (SELECT 2.0 * coalesce(tp, 0) / (coalesce(n_true, 0) + coalesce(n_guess, 0)) AS f, n_true FROM h FULL JOIN q USING (l))
        SELECT round(avg(f), 6) AS macro_f1, round(1 - avg(f), 6) AS loss, sum(n_true)::BIGINT AS n FROM o""",
    "pii_matches": f"{_TWO} SELECT label, outcome, count(*) AS n FROM oc GROUP BY label, outcome",
    "pii_prf": f"""{_TWO}, c AS (SELECT count(*) FILTER (outcome = 'correct')::DOUBLE AS c, count(*) FILTER (outcome = 'typed')::DOUBLE AS t, count(*) FILTER (outcome = 'partial')::DOUBLE AS p, count(*) FILTER (outcome <> 'missed') AS actual, (SELECT count(*) FROM g) AS possible FROM oc),
        h AS (SELECT 'strict' AS mode, c AS hit, actual, possible FROM c UNION ALL SELECT 'exact', c + t, actual, possible FROM c UNION ALL SELECT 'partial', c + t + 0.5 * p, actual, possible FROM c)
        SELECT mode, {_PRF.format('hit', 'actual')} AS precision, {_PRF.format('hit', 'possible')} AS recall, {_F1.format('hit', 'actual', 'possible')} AS f1, possible, actual FROM h""",
    "char_prf": f"""{_TWO}, {_tags('g')}, {_tags('f')},
        m AS (SELECT count(*) FILTER (gt.tag = ft.tag)::DOUBLE AS hit, count(gt.tag)::DOUBLE AS gold, count(ft.tag)::DOUBLE AS found FROM gt FULL JOIN ft ON gt.uid = ft.uid AND gt.pos = ft.pos)
        SELECT {_PRF.format('hit', 'found')} AS precision, {_PRF.format('hit', 'gold')} AS recall, {_F1.format('hit', 'found', 'gold')} AS f1 FROM m""",
    "batch_stream_equal": text_queries.SQL["mask_pii"],
    "gaussian_scale": """
        WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings),
        u AS (SELECT vec_id, x, i, greatest(('0x' || substr(md5(vec_id || ':' || i || '|7'), 1, 8))::BIGINT / 4294967296.0, 1e-12) AS a, ('0x' || substr(md5(vec_id || ':' || i || '|8'), 1, 8))::BIGINT / 4294967296.0 AS b FROM v),
        n AS (SELECT vec_id, x, greatest(least(x, 0.1), -0.2) + 0.7751688420168623 * sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS y FROM u)
        SELECT vec_id, round(sqrt(sum(y * y)), 5) AS norm, round(sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))), 5) AS cosine FROM n GROUP BY vec_id
    """,
}
