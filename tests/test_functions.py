"""Hand-made cases of the text, span and sampling functions."""

import math

import pytest
from pyspark.sql import functions as F

from umbra.functions import sampling, text as T, vectors as V
from umbra.functions import spans as S

SPAN = "array<struct<start:int,end:int,label:string,replacement:string,confidence:double>>"
TEXT = "Ana met Bob in Köln."


def one(spark, column, **values):
    row = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def spans_of(spark, text, spans):
    rows = [(text, [(s[0], s[1], s[2] if len(s) > 2 else None, s[3] if len(s) > 3 else None, s[4] if len(s) > 4 else None) for s in spans])]
    return spark.createDataFrame(rows, f"text string, spans {SPAN}")


@pytest.mark.parametrize(
    "text, spans, expected",
    [
        (TEXT, [(0, 3), (8, 11, None, "[P]"), (15, 19)], "[MASK] met [P] in [MASK]."),
        (TEXT, [(0, 7), (4, 11)], "[MASK]SK] in Köln."),
        (TEXT, [(0, 3, None, "X"), (0, 7, None, "Y")], "Yob in Köln."),
        (TEXT, [(0, 7, None, "Y"), (0, 3, None, "X")], "Xob in Köln."),
        ("abc", [(1, 9), (2, 2), (-1, 2), (0, 1)], "[MASK]bc"),
        ("abcd", [(2, 4), (0, 6)], "[MASK]K]"),
        ("a😀b", [(1, 2)], "a[MASK]b"),
        ("", [(0, 1)], ""),
        ("same", [], "same"),
    ],
)
def test_apply_annotations(spark, text, spans, expected):
    assert spans_of(spark, text, spans).select(S.apply_annotations(F.col("text"), F.col("spans")).alias("x")).first()["x"] == expected


def test_keep_first_and_redaction(spark):
    kept = spans_of(spark, TEXT, [(0, 5, "A"), (3, 8, "B"), (5, 9, "C"), (0, 2, "D")]).select(S.keep_first(F.col("spans")).alias("x")).first()["x"]
    assert [(s["start"], s["end"], s["label"]) for s in kept] == [(0, 5, "A"), (5, 9, "C")]
    rows = spans_of(spark, TEXT, [(0, 3, "PERSON"), (8, 11, "PERSON"), (15, 19, None)])
    assert rows.select(S.redact_disjoint(F.col("text"), F.col("spans")).alias("x")).first()["x"] == "[PERSON] met [PERSON] in [None]."


def test_merge_chunks(spark):
    rows = spans_of(spark, "", [(0, 3, "P", None, 0.9), (5, 8, "L", None, 0.8), (8, 10, "L", None, 0.6), (9, 12, "P", None, 0.7)])
    merged = rows.select(S.merge_chunks(F.col("spans")).alias("x")).first()["x"]
    assert [tuple(s) for s in merged] == [(0, 3, "P", 0.9), (5, 10, "L", 0.8), (9, 12, "P", 0.7)]


@pytest.mark.parametrize("text, expected", [("Hi there.  How are you?! ok", [(0, 11), (11, 25), (25, 27)]), ("No end", [(0, 6)]), ("", [(0, 0)]), ("A. ", [(0, 3)]), ("x.y z! ", [(0, 7)])])
def test_sentences(spark, text, expected):
    found = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("x")).first()["x"]
    assert [(s["start"], s["end"]) for s in found] == expected
    assert "".join(s["text"] for s in found) == text


@pytest.mark.parametrize("length, size, overlap, expected", [(10, 4, 1, [(0, 4), (3, 7), (6, 10)]), (4, 4, 1, [(0, 4)]), (9, 4, 2, [(0, 4), (2, 6), (4, 8), (6, 9)])])
def test_windows(spark, length, size, overlap, expected):
    assert [tuple(w) for w in one(spark, T.windows(F.lit(length), size, overlap))] == expected


def test_windows_need_a_smaller_overlap():
    with pytest.raises(ValueError):
        T.windows(F.lit(3), 4, 4)


def test_recode(spark):
    rows = spark.createDataFrame([("a\\nb",), ('say \\"hi\\"',), ("c:\\\\temp",), ("x\\\\ny",), (None,)], "t string")
    assert [r["x"] for r in rows.select(T.recode(F.col("t")).alias("x")).collect()] == ["a\nb", 'say "hi"', "c:\\\temp", "x\\\ny", None]


def test_persona_hash(spark):
    assert one(spark, T.persona_hash([])) == "9a10b9411715172e"
    assert one(spark, T.persona_hash([("sex", F.lit("m")), ("age", F.lit(3))])) == "87eb00da7a9a98ba"


@pytest.mark.parametrize("private, original, expected", [("paris", "LyonX", "PariS"), ("berlin", "Rome", "Berlin"), ("USA", "rome", "USA"), ("NEW york", "Rom", "New york")])
def test_case_transfer(spark, private, original, expected):
    assert one(spark, T.transfer_case(F.lit(private), F.lit(original))) == expected


def test_small_text_functions(spark):
    assert one(spark, T.mask_first(F.lit("an Ana an"), F.lit("an"))) == "[MASK] Ana an"
    assert one(spark, T.mask_first(F.lit("Banana an"), F.lit("an"))) == "B[MASK]ana an"
    assert [one(spark, T.is_punctuation(F.lit(t))) for t in (".", "()", "...", "", "``", "''", "/:")] == [True, True, False, True, False, False, True]
    assert [one(spark, T.age_group(F.lit(a))) for a in (17.9, 18.0, 24.5, 25.0, 64.0, 65.0)] == ["under_18", "18_24", "18_24", "25_34", "55_64", "65_plus"]
    assert one(spark, T.strip(F.lit("\u00a0 \n x y\t "))) == "x y"


def test_budgets(spark):
    weights = sampling.softmax(F.array(*[F.lit(x) for x in (0.0, 1.0, 0.0, 0.5)]))
    found = one(spark, sampling.token_budgets(weights, F.lit(10.0), F.lit(1.0)))
    assert [round(x, 6) for x in found] == [15.917508, 5.855724, 15.917508, 9.654456]
    assert math.isclose(len(found) / sum(1 / x for x in found), 10.0)
    assert math.isclose(one(spark, sampling.temperature(F.lit(10.0))), 3.9028221175604245)
    assert math.isclose(sampling.gaussian_scale(64, 10.0), 0.7751688420168623)
    assert math.isclose(one(spark, sampling.uniform(F.lit("doc1"), 7)), 0.37777220946736634)
    with pytest.raises(ValueError):
        sampling.softmax(F.array(F.lit(1.0)), 0)


def test_cosine(spark):
    assert one(spark, V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 1.0
    assert one(spark, V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


def test_tokens_and_expansion(spark):
    rows = spark.createDataFrame([("Al-be 😀 x",), ("",), (None,)], "t string").select("t", T.tokens("t").alias("k"))
    found = [r["k"] for r in rows.collect()]
    assert [(t["start"], t["end"], t["text"]) for t in found[0]] == [(0, 2, "Al"), (2, 3, "-"), (3, 5, "be"), (6, 7, "😀"), (8, 9, "x")]
    assert found[1] == [] and found[2] is None
    grown = rows.limit(1).select(S.expand_to_tokens(F.lit(1), F.lit(4), F.col("k")).alias("x")).first()["x"]
    assert tuple(grown) == (0, 5)
