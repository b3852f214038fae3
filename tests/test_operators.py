"""Operators against brute force on small fixtures, with nulls, ties, repeats, empty tables and long texts."""

import json
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbra.operators import detection, dp, kanon, methods, nested, recognise, records, scoring, similarity, utility
from umbra.operators import spans as OS
from umbra.sources import readers, sinks

TAB = "row_id long, doc_id string, text string, quality_checked boolean, task string, dataset_type string, meta string, annotations string, delivered_at timestamp, extra string, path string"


def tab(spark, rows):
    from datetime import datetime

    made = [(n, doc, "t", None, None, None, m, a, datetime(2024, 1, day), "x", "y") for n, (doc, m, a, day) in enumerate(rows)]
    return spark.createDataFrame(made, TAB)


def test_nested_children(spark):
    mention = {"entity_mention_id": "e", "start_offset": "3", "end_offset": 5, "metadata": {"identifier_type": "QUASI"}}
    rows = tab(spark, [
        ("a", json.dumps({"countries": ["X"], "years": 1999}), json.dumps({"p": {"entity_mentions": [None, mention]}, "q": None, "r": {"entity_mentions": []}}), 2),
        ("a", json.dumps({"countries": ["OLD"]}), "{}", 1),
        ("b", "null", json.dumps([{"annotator": "z", "entity_mentions": mention}, None]), 1),
        ("c", "{broken", "", 1),
        ("d", json.dumps({"countries": "Y", "years": [None, "2001", "x"]}), None, 1),
        (None, "{}", "{}", 1),
    ])
    found = {tuple(r) for r in nested.children(rows).collect()}
    assert found == {("a", "p", "mention", 1), ("a", "meta", "country", 0), ("a", "meta", "year", 0), ("b", "z", "mention", 0), ("d", "meta", "country", 0), ("d", "meta", "year", 1), ("d", "meta", "year", 2)}
    tables = nested.case_tables(rows)
    assert {(r["doc_id"], r["annotator"], r["pos"], r["entity_mention_id"], r["start_offset"]) for r in tables["mentions"].collect()} == {("a", "p", 1, "e", 3), ("b", "z", 0, "e", 3)}
    assert {r["identifier_type"] for r in tables["mentions"].collect()} == {"QUASI"}
    assert {tuple(r) for r in tables["years"].collect()} == {("a", 0, 1999), ("d", 1, 2001), ("d", 2, None)}
    assert nested.children(rows.limit(0)).count() == 0


def test_members_of_one_key_stay_apart(spark):
    twice = json.dumps([{"annotator": "x", "entity_mentions": [{"entity_mention_id": "m1", "span_text": "one"}]}, {"annotator": "x", "entity_mentions": [{"entity_mention_id": "m2"}]}])
    tables = nested.case_tables(tab(spark, [("a", None, twice, 1)]))
    found = {(r["annotator"], r["annotator_pos"], r["pos"], r["entity_mention_id"], r["span_text"]) for r in tables["mentions"].collect()}
    assert found == {("x", 0, 0, "m1", "one"), ("x", 1, 0, "m2", None)}
    assert {(r["annotator"], r["annotator_pos"]) for r in tables["annotators"].collect()} == {("x", 0), ("x", 1)}


def test_tables_of_whatever_is_repeated(spark):
    meta = json.dumps({"judges": [{"name": "A", "posts": ["p", "q"]}, None, {"name": "B's", "it's": 1}], "years": 7, "meta": {"deep": {"x": [[1], [2, 3]]}}})
    parsed = nested.parse(spark.createDataFrame([("d", meta), ("e", "{")], "doc_id string, meta string"), "doc_id", "meta", nested.META)
    tables = nested.flat_tables(parsed, "doc_id")
    assert set(tables) == {"meta.judges[]", "meta.judges[].posts[]", "meta.years[]", "meta.deep.x[][]"}
    assert {(tuple(r["ordinals"]), r["name"], r["it's"]) for r in tables["meta.judges[]"].collect()} == {((0,), "A", None), ((2,), "B's", "1")}
    assert {(tuple(r["ordinals"]), r["value"]) for r in tables["meta.judges[].posts[]"].collect()} == {((0, 0), "p"), ((0, 1), "q")}
    assert {(tuple(r["ordinals"]), r["value"]) for r in tables["meta.deep.x[][]"].collect()} == {((0, 0), "1"), ((1, 0), "2"), ((1, 1), "3")}


def test_stream_parser_agrees_with_a_whole_parse():
    shapes = (nested.ANNOTATIONS, nested.META)
    rng = random.Random(8)

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return (None, True, 1.5, "s\u00e9\"\\", -3)[kind]
        if kind == 5:
            return [value(depth - 1) for _ in range(rng.randrange(4))]
        return {rng.choice(["annotations", "entity_mentions", "annotator", "metadata", "meta", "countries", "years", "k"]): value(depth - 1) for _ in range(rng.randrange(4))}

    for n in range(600):
        shape, made = shapes[n % 2], value(4)
        text = json.dumps(made, indent=rng.choice([None, 2]), ensure_ascii=rng.random() < 0.5)
        whole = nested.decoded(made, shape.root, [], [], shape)
        assert sorted(map(str, nested.triples(text, shape))) == sorted(map(str, whole))
        broken = text[: rng.randrange(len(text))]
        try:
            json.loads(broken)
        except ValueError:
            assert nested.triples(broken, shape) == []
        assert nested.triples(text + " x", shape) == []


def test_recognise_positions(spark):
    text = "mail x.19@mail5.example.com or (743) 555-3824; 10.0.0.1 🙂 2020-01-02 " * 50
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    found = recognise.redact(rows).orderBy("doc_id").collect()
    for span in found[0]["spans"]:
        assert text[span["start"] : span["end"]] == span["text"]
    assert Counter(s["label"] for s in found[0]["spans"]) == {"EMAIL_ADDRESS": 50, "PHONE_NUMBER": 50, "IP_ADDRESS": 50, "DATE_TIME": 50}
    assert found[1]["masked"] == "" and found[2]["spans"] == []


DOCS = [("d1", "red green blue red", "A"), ("d2", "green apple tree", "A"), ("d3", "blue sky red sky", "B"), ("d4", "sky sea sea wave", "C"), ("d5", "", "C"), ("d6", "red", None)]


def documents(spark):
    return spark.createDataFrame([(*d, "clash") for d in DOCS], "uid string, text string, name string, label string")


def brute_scores():
    known = [d for d in DOCS if d[2]]
    by = defaultdict(Counter)
    for _, text, name in known:
        by[name].update(w for w in text.split() if len(w) > 1)
    size = len({w for c in by.values() for w in c})
    out = {}
    for uid, text, _ in DOCS:
        for name, c in by.items():
            prior = math.log(sum(d[2] == name for d in known) / len(known))
            out[uid, name] = prior + sum(math.log((c[w] + 1) / (sum(c.values()) + size)) for w in text.split())
    return out


def test_naive_bayes_and_ranks(spark):
    rows = documents(spark)
    scores = scoring.NaiveBayes(rows).scores(rows, "uid")
    expected = brute_scores()
    found = {(r["uid"], r["label"]): r["score"] for r in scores.collect()}
    assert found.keys() == expected.keys() and all(math.isclose(found[k], expected[k]) for k in found)
    ranks = {r["uid"]: r["rank"] for r in scoring.ranks(scores, rows.select("uid", F.col("name").alias("label")), "uid").collect()}
    for uid, _, name in DOCS:
        if name:
            order = sorted("ABC", key=lambda x: (expected[uid, x], x), reverse=True)
            assert ranks[uid] == order.index(name) + 1
    assert "d6" not in ranks


def test_greedy_trace_is_one_path_for_every_k(spark):
    rows = documents(spark)
    model = scoring.NaiveBayes(rows)
    traced = kanon.trace(model, rows.drop("label").withColumnRenamed("name", "label"), "uid", "label", 3)
    grid = {(r["uid"], r["k"]): r for r in kanon.grid(traced, "uid", (2, 3)).collect()}
    for uid in ("d1", "d2", "d3", "d4"):
        assert set(grid[uid, 2]["words"]) <= set(grid[uid, 3]["words"])
    # brute force of one step
    expected, (uid, text, name) = brute_scores(), DOCS[0]
    first = traced.where("uid = 'd1' AND step = 1").first()["word"]
    by = defaultdict(Counter)
    for _, t, n in DOCS:
        if n:
            by[n].update(t.split())
    size = len({w for c in by.values() for w in c})

    def chance(without):
        s = {n: expected[uid, n] - (sum(math.log((by[n][w] + 1) / (sum(by[n].values()) + size)) for w in text.split() if w == without) if without else 0) for n in by}
        return math.exp(s[name]) / sum(map(math.exp, s.values()))

    assert first == max(dict.fromkeys(text.split()), key=lambda w: chance(None) - chance(w))


def test_blocks_of_labels_add_up(spark, monkeypatch):
    rows = documents(spark)
    whole = scoring.NaiveBayes(rows)
    assert len(whole.blocks()) == 1
    monkeypatch.setattr(scoring, "BLOCK_CELLS", 1)
    parts = scoring.NaiveBayes(rows)
    assert len(parts.blocks()) == 3
    order = lambda frame: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in frame.collect())
    known = rows.withColumn("label", F.col("name")).drop("name").withColumnRenamed("label", "name")
    for a, b in ((whole.best(rows, "uid"), parts.best(rows, "uid")), (whole.ranks(known, "uid"), parts.ranks(known, "uid")), (whole.summed(known), parts.summed(known)), (scoring.explain(whole, rows, "uid"), scoring.explain(parts, rows, "uid")), (scoring.shapley(whole, rows, "uid"), scoring.shapley(parts, rows, "uid"))):
        assert order(a) == order(b) and order(a)
    given = scoring.ranks(whole.scores(rows, "uid"), rows.select("uid", F.col("name").alias("label")), "uid")
    assert order(given) == order(whole.ranks(rows, "uid")) == sorted((u, r) for u, r in given.collect())
    traced = [order(kanon.trace(m, rows.drop("label").withColumnRenamed("name", "label"), "uid", "label", 3)) for m in (whole, parts)]
    assert traced[0] == traced[1]


def test_shapley_values_add_up(spark):
    rows = documents(spark)
    model = scoring.NaiveBayes(rows)
    best = {r["uid"]: r["predicted"] for r in model.best(rows, "uid").collect()}
    scores = {(r["uid"], r["label"]): r["score"] for r in model.scores(rows, "uid").collect()}
    values = defaultdict(float)
    for r in scoring.shapley(model, rows, "uid").collect():
        values[r["uid"]] += r["score"]
    by, n = {r["word"]: 0 for r in model.by_label.collect()}, len(DOCS)
    gains = defaultdict(dict)
    for r in model.by_label.collect():
        gains[r["word"]][r["label"]] = math.log(r["c"] + 1)
        by[r["word"]] += r["c"]
    for uid, text, _ in DOCS:
        contrast = lambda w: gains[w].get(best[uid], 0) - sum(gains[w].values()) / 3
        assert math.isclose(values[uid], sum(contrast(w) * (c - by[w] / n) for w, c in Counter(text.split()).items()), abs_tol=1e-4)
    assert scores


def test_stopping_rule():
    loss = np.eye(4)[[0, 0, 0]] * 1.0
    steps = kanon.greedy(np.array([1.0, 0.5, 0.4, 0.3]), 0, loss, 9)
    assert [r for _, r in steps] == [1, 4, 4, 4]


def test_explain_matches_brute_force(spark):
    rows = documents(spark).where("text <> ''")
    model = scoring.NaiveBayes(documents(spark))
    found = {(r["uid"], r["word"]): r["score"] for r in scoring.explain(model, rows, "uid").collect()}
    expected = brute_scores()
    by, known = defaultdict(Counter), [d for d in DOCS if d[2]]
    for _, t, n in known:
        by[n].update(t.split())
    size = len({w for c in by.values() for w in c})
    s = {n: expected["d1", n] for n in by}
    target = max(s, key=lambda n: (s[n], n))
    base = math.exp(s[target]) / sum(map(math.exp, s.values()))
    m = {n: s[n] - math.log((by[n]["red"] + 1) / (sum(by[n].values()) + size)) for n in by}
    assert math.isclose(found["d1", "red"], base - math.exp(m[target]) / sum(map(math.exp, m.values())), abs_tol=1e-8)


def test_similarity_of_equal_and_blank_texts(spark):
    rows = spark.createDataFrame([("a", "one two", "one two"), ("b", "three four", ""), ("c", None, None)], "uid string, text string, masked string")
    assert {r["uid"]: r["similarity"] for r in similarity.tfidf_cosine(rows, "uid").collect()} == {"a": 1.0, "b": 0.0, "c": 0.0}


def test_perturbation_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([(f"d{n}", f"The cat sat on the mat. The dog saw a cat {n}!") for n in range(20)] + [("e", ""), ("n", None)], "uid string, text string")
    public = rows.select("text")
    a = dp.rewrite(rows.repartition(1), dp.perturb(rows.repartition(1), "uid", 5.0, public), "uid")
    b = dp.rewrite(rows.repartition(7), dp.perturb(rows.repartition(7), "uid", 5.0, public.repartition(3)), "uid")
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}
    text = {r["uid"]: r["text"] for r in a.collect()}
    assert text["e"] == "" and text["d0"].endswith("!") and text["d0"].count(".") == 1


def test_draws_follow_the_scores(spark):
    public = spark.createDataFrame([("x a",)] * 1 + [("x b",)] * 3 + [("x c",)] * 3, "text string")  # levels of log 1 and log 3
    asked = spark.range(4000).select(F.col("id").cast("string").alias("uid"), F.lit("x").alias("left"))
    heat = 0.5
    found = Counter(r["word"] for r in dp.Candidates(public).draw(asked, F.lit(heat), F.col("uid"), 3, "word").collect())
    weights = {"a": 1.0, "b": math.exp(1.0 / heat), "c": math.exp(1.0 / heat)}  # quarter nats below log 3
    for word, weight in weights.items():
        assert abs(found[word] / 4000 - weight / sum(weights.values())) < 0.03
    unknown = dp.Candidates(public).draw(asked.limit(50).withColumn("left", F.lit("never")), F.lit(heat), F.col("uid"), 3, "word")
    assert {r["word"] for r in unknown.collect()} <= {"x", "a", "b", "c"}
    none = dp.Candidates(public.limit(0)).draw(asked.limit(5), F.lit(heat), F.col("uid"), 3, "word")
    assert {r["word"] for r in none.collect()} == {None}


def test_only_sensitive_tokens_are_redrawn_and_budgets_add_up(spark):
    rows = spark.createDataFrame([("p", "Ana met Bob in Bonn.", [(0, 3), (8, 11)]), ("q", "Ana met Bob.", []), ("n", "One two", None), ("e", "", None), ("z", None, None)], "uid string, text string, spans array<struct<start:int,end:int>>")
    each = dp.budgets(rows, "uid", 10.0, "spans", F.length("token").cast("double"), 2.0, True).collect()
    free = {u: [r for r in each if r["uid"] == u and r["free"]] for u in "pqn"}
    assert sorted(r["token"] for r in free["p"]) == ["Ana", "Bob"] and len(free["q"]) == 3 and len(free["n"]) == 2
    harmonic = lambda found: len(found) / sum(1 / r["epsilon"] for r in found)
    assert math.isclose(harmonic(free["p"]), 10.0 * 2 / 5) and math.isclose(harmonic(free["q"]), 10.0)
    public = spark.createDataFrame([("Cleo saw Dora near Essen",)], "text string")
    out = {r["uid"]: r for r in dp.rewrite(rows, dp.perturb(rows, "uid", 0.1, public, sensitive="spans", add=1.0), "uid").collect()}
    assert out["p"]["text"].split()[2] == "met" and out["p"]["n_added"] == 2 and out["p"]["text"].endswith("in Bonn.") and out["e"]["text"] == ""
    gone = {r["uid"]: r for r in dp.rewrite(rows, dp.perturb(rows, "uid", 0.1, public, delete=1.0), "uid").collect()}
    assert gone["n"]["n_deleted"] == 1 and gone["n"]["n_tokens"] == 1 and gone["q"]["text"] == "."


def test_split_is_exact_and_skew_safe(spark):
    rows = spark.createDataFrame([(n, "hot" if n % 3 else "cold") for n in range(100)] + [(200, "single"), (300, None), (301, None)], "k long, label string")
    found = utility.split(rows, "k", "label", 0.25).groupBy("label").agg(F.count_if("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert {r["label"]: (r["t"], r["n"]) for r in found} == {"hot": (16, 66), "cold": (8, 34), "single": (0, 1), None: (1, 2)}


def test_f1_and_regression(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, predicted string")
    expected = (2 * 1 / 4 + 2 * 1 / 3 + 0) / 3
    assert math.isclose(utility.f1(rows).first()["macro_f1"], expected, abs_tol=1e-6)
    numbers = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "label double, predicted double")
    row = utility.regression_scores(numbers).first()
    assert math.isclose(row["r2"], 1 - 0.5 / 2) and math.isclose(row["rmse"], math.sqrt(0.5 / 3), abs_tol=1e-6)


def test_detection_scores(spark):
    gold = spark.createDataFrame([("u", 0, 3, "P"), ("u", 5, 9, "L"), ("u", 20, 25, "P")], "uid string, start int, end int, label string")
    found = spark.createDataFrame([("u", 0, 3, "P"), ("u", 5, 9, "P"), ("u", 24, 26, "P"), ("u", 40, 41, "L")], "uid string, start int, end int, label string")
    rows = {r["mode"]: r for r in detection.prf(gold, found).collect()}
    assert rows["strict"]["precision"] == 0.25 and rows["exact"]["precision"] == 0.5 and rows["partial"]["precision"] == 0.625
    assert detection.prf(gold, found.limit(0)).first()["precision"] == 0.0


def test_char_labels(spark):
    span = "array<struct<start:int,end:int,label:string>>"
    rows = spark.createDataFrame([("u", "Al be", [(0, 2, "P"), (3, 9, "B-L"), (7, 8, "X")])], f"uid string, text string, spans {span}")
    assert {r["pos"]: r["tag"] for r in OS.char_labels(rows).collect()} == {0: "B-P", 1: "I-P", 3: "B-L", 4: "I-L"}


def test_last_by_index_fills_gaps(spark):
    rows = spark.createDataFrame([(0, "a", 1), (3, "b", 2), (3, "c", 3), (None, "d", 4), (-1, "e", 5)], "idx long, v string, o int")
    assert [tuple(r) for r in OS.last_by_index(rows, "v", "o").orderBy("idx").collect()] == [(0, "a"), (1, None), (2, None), (3, "c")]
    assert OS.last_by_index(rows.limit(0), "v", "o").count() == 0


def test_methods_check_their_parameters(spark):
    with pytest.raises(ValueError):
        methods.check("dpmlm", None, None)
    with pytest.raises(ValueError):
        methods.check("manual", [1.0], None)
    rows = spark.createDataFrame([("u", 0, "call a@b.cc", "n")], "uid string, idx long, text string, name string")
    with pytest.raises(NotImplementedError):
        methods.anonymise(rows, "dpprompt", [1.0])
    assert methods.anonymise(rows, "presidio").first()["text"] == "call [EMAIL_ADDRESS]"
    out = methods.anonymise(rows, "dpprompt", [2.0, 2.0, 5.0], generator=lambda p, t: F.concat(p, F.lit(" new "))).collect()
    assert [(r["parameter"], r["text"]) for r in out] == [(2.0, "new"), (5.0, "new")]


def test_readers(spark, tmp_path):
    reddit = tmp_path / "r.jsonl"
    reddit.write_text('{"response": " hi ", "personality": {"sex": "m", "age": 3}}\n\n{"response": "  "}\n{"response": "yes"}\n', encoding="utf-8")
    rows = readers.read_dataset(spark, "Reddit", str(reddit)).orderBy("idx").collect()
    assert [(r["uid"], r["text"], r["idx"]) for r in rows] == [("reddit_1", "hi", 0), ("reddit_3", "yes", 2)]
    assert rows[1]["name"] == "9a10b9411715172e"
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"review": "ok"}\n{oops\n', encoding="utf-8")
    with pytest.raises(Exception, match="line 2"):
        readers.read_trustpilot(spark, str(bad)).collect()
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "nope", "x")
    import pyarrow as pa

    table = pa.table({c.split()[0]: pa.array([f"v{n}" if "string" in c else n for n in range(7)], pa.string() if "string" in c else pa.int64()) for c in readers.DB_BIO.split(", ")})
    with pa.OSFile(str(tmp_path / "b.arrow"), "wb") as sink, pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table, max_chunksize=3)
    assert [(r["idx"], r["uid"], r["word_count"]) for r in readers.read_db_bio(spark, str(tmp_path / "b.arrow")).orderBy("idx").collect()] == [(n, f"v{n}", n) for n in range(7)]
    held = tmp_path / "spans"
    held.mkdir()
    (held / "a.json").write_text('{"u1": [[0, 2]]}', encoding="utf-8")
    (held / "b.json").write_text("[1]", encoding="utf-8")
    (held / "c.json").write_text("{", encoding="utf-8")
    with pytest.warns(UserWarning):
        named = readers.read_annotation_folder(spark, str(held))
    assert list(named) == ["a"] and named["a"].first()["uid"] == "u1"
    cases = tmp_path / "tab.json"
    cases.write_text(json.dumps([{"doc_id": "c1", "text": "Ana", "meta": {"applicant": "A"}, "annotations": {"x": {"entity_mentions": [{"start_offset": 0, "end_offset": 3, "entity_type": "PERSON"}]}}}, {"text": "none"}]), encoding="utf-8")
    found = {r["uid"]: r for r in readers.read_tab(spark, str(cases)).collect()}
    assert found["c1"]["name"] == "A" and found["c1"]["spans"][0]["label"] == "PERSON" and found["1"]["spans"] is None


def test_run_round_trip(spark, tmp_path):
    run = tmp_path / "outputs/reddit/m/20240101_000000.jsonl"
    run.parent.mkdir(parents=True)
    run.write_text('{"idx": 0, "text": "a", "spans": [{"start": 0, "end": 1, "label": "P"}]}\n{"idx": "3", "text": "b"}\n{"idx": 3, "text": "c"}\n{"idx": "x", "text": "d"}\n{"text": "e"}\n', encoding="utf-8")
    rows = readers.read_run(spark, str(run)).orderBy("idx").collect()
    assert [(r["idx"], r["text"], len(r["spans"])) for r in rows] == [(0, "a", 1), (1, None, 0), (2, None, 0), (3, "c", 0)]
    assert readers.collect_sources(spark, str(tmp_path)) == [("m_reddit_0", str(run))]
    assert readers.list_stamps(spark, "reddit", "m", str(tmp_path / "outputs")) == ["20240101_000000"]
    marks = tmp_path / "a.json"
    marks.write_text('{"u": [{"start": 1, "end": 2, "label": "P"}], "v": [[0, 4]], "w": []}', encoding="utf-8")
    found = readers.read_annotations(spark, str(marks))
    assert {r["uid"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found.collect()} == {"u": [(1, 2)], "v": [(0, 4)], "w": []}
    again = tmp_path / "b.json"
    sinks.write_annotations(found, str(again))
    assert {r["uid"]: r["spans"] for r in readers.read_annotations(spark, str(again)).collect()} == {r["uid"]: r["spans"] for r in found.collect()}


def test_report_forms(spark):
    heads = spark.createDataFrame([("x", 3, 0.5)], "dataset string, count long, mean double")
    entries = spark.createDataFrame([(1, "u", 2), (0, "v", -1)], "index long, uid string, delta long")
    assert "delta=+2" in sinks.report(heads, entries) and sinks.report(heads, entries).index("delta=-1") < sinks.report(heads, entries).index("delta=+2")
    assert json.loads(sinks.report(heads, entries, "json"))["summaries"][0]["count"] == 3
    with pytest.raises(ValueError):
        sinks.report(heads, None, "xml")


def test_records_with_spans(spark, folder):
    from umbra.sources.tables import table

    rows = records.with_spans(table(spark, folder, "dataset_record"), table(spark, folder, "text_annotation"))
    assert rows.count() > 0 and rows.select("uid").distinct().count() == rows.count()


def test_numbering_is_dense_and_in_order(spark):
    rows = spark.createDataFrame([(f"n{k:03d}",) for k in range(57)], "name string").repartition(5)
    assert [(r["name"], r["idx"]) for r in records.numbered(rows, ["name"]).orderBy("idx").collect()] == [(f"n{k:03d}", k) for k in range(57)]
    assert records.numbered(rows.limit(0), ["name"]).count() == 0
    made = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "name string")
    assert {tuple(r) for r in scoring.label_ids(made).collect()} == {("a", 0), ("b", 1)}


def test_treebank_rules_and_offsets(spark):
    from umbra.functions import treebank

    sentence = 'He said, "I can\'t pay $5.50 (or more)--gonna wait..." Really?'
    tokens = treebank.split_sentence(sentence)
    assert tokens == ["He", "said", ",", "``", "I", "ca", "n't", "pay", "$", "5.50", "(", "or", "more", ")", "--", "gon", "na", "wait", "...", "''", "Really", "?"]
    spans = treebank.locate(sentence, tokens)
    assert [sentence[a:b] for a, b in spans] == [t if t not in ("``", "''") else '"' for t in tokens]
    rows = spark.createDataFrame([("Ana met. Bob's in 'town' 😀 ok.",), ("",), (None,), ("x " * 3000,)], "text string")
    found = rows.select("text", treebank.terms(F.col("text")).alias("t"), treebank.detokenize(F.col("t.text")).alias("again")).collect()
    assert all(r["text"][t["start"] : t["end"]] == t["text"] for r in found if r["t"] for t in r["t"])
    assert [t["sentence"] for t in found[0]["t"]][:4] == [0, 0, 0, 1] and found[1]["t"] == [] and found[2]["t"] is None and len(found[3]["t"]) == 3000
    assert found[0]["again"] == "Ana met. Bob's in 'town' 😀 ok."


def test_token_labels_and_ignore_set(spark):
    rows = spark.createDataFrame([("u", "Al be goes", [(0, 2, "P"), (3, 10, "B-L")]), ("n", "x y", None), ("e", "", [])], "uid string, text string, spans array<struct<start:int,end:int,label:string>>")
    found = {(r["uid"], r["pos"]): (r["token"], r["tag"]) for r in OS.token_labels(rows).collect()}
    assert found == {("u", 0): ("Al", "B-P"), ("u", 1): ("be", "B-L"), ("u", 2): ("goes", "I-L"), ("n", 0): ("x", "O"), ("n", 1): ("y", "O")}
    labels = spark.createDataFrame([("PERSON",), (None,), ("PERSON",)], "label string")
    assert {r["term"] for r in OS.ignore_set(spark, ["The"], ["[MASK]"], labels).collect()} == {"The", "the", "[MASK]", "[mask]", "PERSON", "person"}


def test_indices(spark):
    rows = spark.createDataFrame([(n, f"u{n}", {"record_index": "9"} if n == 1 else None) for n in range(4)], "idx long, uid string, metadata map<string,string>")
    assert sorted(r["idx"] for r in records.by_indices(rows, [3, 0, 3]).collect()) == [0, 3]
    with pytest.raises(ValueError, match="7"):
        records.by_indices(rows, [0, 7])
    assert {r["uid"]: r["index"] for r in records.with_index(rows, ["uid"]).collect()} == {"u0": 1, "u1": 9, "u2": 3, "u3": 4}


def test_detector_learns_and_chunks_agree(spark):
    from umbra.operators import detector

    names, rows = ["Ana", "Bob", "Cleo", "Dora"], []
    for n in range(60):
        text = f"Yesterday Mr {names[n % 4]} Belling met the {['judge', 'clerk'][n % 2]} in town."
        rows.append((f"u{n}", text, [(13, 13 + len(names[n % 4]) + 8, "PERSON")]))
    rows += [("e", "", []), ("z", None, None)]
    made = spark.createDataFrame(rows, "uid string, text string, spans array<struct<start:int,end:int,label:string>>")
    model = detector.train(made.where("uid < 'u4'"))
    found = {r["uid"]: r for r in detector.predict(model, made).collect()}
    right = sum([(s["start"], s["end"], s["label"]) for s in found[u]["spans"]] == [(a, b, c) for a, b, c in gold] for u, _, gold in rows[:60])
    assert right >= 57 and found["e"]["spans"] == [] and found["z"]["spans"] == []
    long = spark.createDataFrame([("d", ("filler " * 20 + "mail a.b@c.example now " + "filler " * 20) * 3)], "uid string, text string")
    whole = [tuple(s)[:2] for s in recognise.redact(long).first()["spans"]]
    for size, overlap in ((60, 30), (200, 40), (5000, 10)):
        chunked = detector.in_chunks(long, recognise.redact, size, overlap).first()["spans"]
        assert {(s["start"], s["end"]) for s in chunked} >= set(whole)


def test_targets_and_specifications(spark):
    rows = spark.createDataFrame([(" a ", ["", " FR ", "DE"], ["x", "1999", "2000"], 24), ("", [], None, None)], "label string, country array<string>, year array<string>, persona_age int")
    got = rows.select(utility.target("reddit_label", F.col("label")), utility.target("tab_country", F.col("country"), True), utility.target("tab_year", F.col("year"), True), utility.target("reddit_age_group", F.col("persona_age"))).collect()
    assert tuple(got[0]) == ("a", "FR", 1999.0, "18_24") and tuple(got[1]) == (None, None, None, None)
    assert utility.specification("reddit_age") == ("tfidf", "perceptron_regressor") and utility.specification("reddit_sex", "tfidf+logistic") == ("tfidf", "logistic")
    with pytest.raises(ValueError):
        utility.specification("reddit_sex", "tfidf+magic")
    assert len(utility.TARGETS) == 11


def test_perceptron_regressor_fits(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(4)
    rows = [(Vectors.sparse(6, {int(k): 1.0 for k in rng.choice(6, 3, replace=False)}),) for _ in range(200)]
    made = spark.createDataFrame([(x, float(3 * x[0] - 2 * x[1] * x[2] + 10)) for (x,) in rows], ["x", "y"])
    fitted = utility.PerceptronRegressor(6, (16, 8), 120).fit(made)
    scored = fitted.transform(made).select(F.col("y").alias("label"), F.col("prediction").alias("predicted"))
    assert utility.regression_scores(scored).first()["r2"] > 0.9


def test_commands_train_evaluate_predict(spark, tmp_path, capsys):
    from umbra import cli

    cases = [{"doc_id": f"c{n}", "text": f"The applicant Mr {['Ana', 'Bob'][n % 2]} Belling lived in {['Bonn', 'Lyon'][n % 2]}.", "meta": {"applicant": ["A", "B"][n % 2]}, "annotations": {"x": {"entity_mentions": [{"start_offset": 17, "end_offset": 28, "entity_type": "PERSON"}]}}} for n in range(12)]
    (tmp_path / "tab.json").write_text(json.dumps(cases), encoding="utf-8")
    base = ["--set", "dataset=tab", "--set", f"data_in={tmp_path}/tab.json"]
    run = lambda *args: (cli.main([args[0], *base, *[x for pair in args[1:] for x in ("--set", pair)]]), capsys.readouterr().out)[1]
    assert "written" in run("detect", "mode=train", f"model={tmp_path}/det")
    assert "mode=strict  precision=1.0000" in run("detect", "mode=evaluate", f"model={tmp_path}/det")
    assert "written" in run("detect", "mode=predict", f"model={tmp_path}/det", f"output={tmp_path}/out/tab/det/1.jsonl")
    assert "written" in run("identify", "mode=train", f"model={tmp_path}/nb")
    told = run("identify", "mode=evaluate", f"model={tmp_path}/nb")
    assert "accuracy=1.0000" in told and "individual_accuracy=1.0000" in told
    assert "written" in run("identify", "mode=predict", f"model={tmp_path}/nb", f"output={tmp_path}/told")
    assert "greedy" in run("explain", "index=1") and "preset=eps_10" in run("matrix")
    out = run("anonymise", "method=manual", "indices=[1, 3]")
    assert out.count("[PERSON]") == 2 and "[1]" in out
    for n in range(2):  # the second run finds nothing left to do
        run("anonymise", "method=manual", f"output={tmp_path}/res", "resume=true")
    assert spark.read.json(f"{tmp_path}/res").count() == 12
    with pytest.raises(ValueError):
        cli.with_preset({"preset": "nope"})


def test_vector_mechanism_needs_its_plug_in(spark):
    rows = spark.createDataFrame([("u", 0, "abc"), ("b", 1, " ")], "uid string, idx long, text string")
    coder = methods.AutoEncoder(lambda text: F.array(*[F.lit(0.05)] * 4), lambda vector: F.concat(F.lit("v"), F.round(vector[0], 3).cast("string")), 4)
    out = {r["uid"]: r["text"] for r in methods.anonymise(rows, "dpbart", [10.0], generator=coder).collect()}
    assert out["u"].startswith("v") and out["u"] != "v0.05" and out["b"] == ""
    with pytest.raises(NotImplementedError):
        methods.anonymise(rows, "dpbart", [10.0], generator=lambda p, t: p)
    with pytest.raises(ValueError):
        methods.anonymise(rows, "dpmlm", [10.0])


def test_mean_of_written_numbers_in_any_order(spark):
    from fractions import Fraction

    rng = random.Random(3)
    for _ in range(3):
        values = [rng.randrange(1000) / 1000 for _ in range(16)]
        values[0] = ((1000 - round(sum(values[1:]) * 1000)) % 16 + 1) / 1000  # the sum is 1/16 more than a multiple: a tie at the sixth place
        mean = sum(Fraction(round(v * 1000), 1000) for v in values) / 16
        assert (mean * 10**6).denominator == 2
        found = set()
        for _ in range(4):
            rng.shuffle(values)
            found |= {r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).agg(scoring.exact_mean("v")).collect()}
        assert found == {float(mean)}
    rows = spark.createDataFrame([(1, 0.995852), (1, 0.058849), (2, None), (3, float("inf")), (3, 1.0), (4, float("nan"))], "k int, v double")
    by = {r["k"]: r["m"] for r in rows.groupBy("k").agg(scoring.rounded(scoring.exact_mean("v"), 6).alias("m")).collect()}
    assert by[1] == 0.527351 and by[2] is None and by[3] == float("inf") and math.isnan(by[4])


def test_score_average_gives_the_rows_of_its_sql_at_ties(spark, tmp_path):
    import duckdb

    from umbra.plans.queries import QUERIES, SQL

    annotations = "ann_id long, uid string, annotator string, start int, `end` int, label string, text string, confidence double, made_at timestamp, received_at timestamp"
    rows = [(n, "u", f"a{n}", 0, 1, "EMAIL", None, v, None, None) for n, v in enumerate((0.995852, 0.058849))]
    spark.createDataFrame(rows, annotations).coalesce(1).write.parquet(f"{tmp_path}/text_annotation.parquet")
    spark.createDataFrame([(1, "u", "s", "text", None)], "idx long, uid string, source string, text string, loaded_at timestamp").write.parquet(f"{tmp_path}/dataset_record.parquet")
    connection = duckdb.connect()
    for name in ("text_annotation", "dataset_record"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = connection.execute(SQL["score_average"]).fetchall()
    assert [tuple(r) for r in QUERIES["score_average"](spark, str(tmp_path)).collect()] == expected == [("u", 0.527351, 0.995852)]


def test_treebank_terms_of_a_batch_take_little_memory(spark):
    import tracemalloc

    import pyarrow as pa

    from umbra.functions import treebank

    text = 'He said "no", they\'re gone (to Łódź); we can\'t stay. ' * 20
    rows = spark.createDataFrame([(n, (None, "", text)[min(n, 2)]) for n in range(6)], "n int, text string")
    sentences = rows.select("n", treebank.T.sentences(F.col("text")).alias("s")).orderBy("n").toArrow()["s"].combine_chunks()
    batch = pa.concat_arrays([sentences] * 100)
    tracemalloc.start()
    found = treebank._terms.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * 400 * len(text)
    assert found[0].as_py() is None and found[1].as_py() == []
    assert {text[t["start"] : t["end"]] == t["text"] for t in found[602 - 6 + 2].as_py()} == {True}
    shown = rows.select("n", treebank.terms(F.col("text")).alias("t")).orderBy("n").collect()
    assert [r["t"] if r["t"] is None else [t.asDict() for t in r["t"]] for r in shown] == found[:6].to_pylist()
