"""Pattern recognisers for sensitive values, and redaction with what they find.

The patterns use no look-around, so the JVM and SQL engines agree on them.  Recognisers
for persons and organisations take a gazetteer: a table of names joined by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import spans as S
from umbra.functions.sampling import let

# Recognisers in order of precedence: at one place the first one wins.
RECOGNISERS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "URL": r"https?://[A-Za-z0-9./?=&%_\-]+",
    "IBAN_CODE": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}",
    "CREDIT_CARD": r"[0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}[ \-][0-9]{4}",
    "IP_ADDRESS": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
    "US_SSN": r"[0-9]{3}[ \-][0-9]{2}[ \-][0-9]{4}",
    "PHONE_NUMBER": r"\+[0-9]{1,3}[ .\-][0-9(][0-9() .\-]{6,14}[0-9]|\([0-9]{3}\) [0-9]{3}-[0-9]{4}|0[0-9]{3,4} ?[0-9]{3} ?[0-9]{3,4}",
    "DATE_TIME": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{4}",
    "SECRET": r"[0-9a-f]{40}",
}
ANY = "|".join(f"(?:{p})" for p in RECOGNISERS.values())


def label_of(value: Column) -> Column:
    """The first recogniser that matches a whole value."""
    out = None
    for label, pattern in RECOGNISERS.items():
        test = value.rlike(f"^(?:{pattern})$")
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def recognise(text: Column) -> Column:
    """array<struct<start,end,label,replacement,text>> of the recognised values, disjoint and in order."""
    return let(F.split(text, ANY), lambda gaps: _located(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), gaps))


def _located(found: Column, gaps: Column) -> Column:
    empty = F.array().cast("array<struct<start:int,end:int,label:string,replacement:string,text:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), empty.alias("out"))

    def step(acc: Column, value: Column) -> Column:
        start = acc["at"] + F.length(F.element_at(gaps, acc["n"] + 1))
        end = start + F.length(value)
        label = label_of(value)
        span = F.struct(start.alias("start"), end.alias("end"), label.alias("label"), F.concat(F.lit("["), label, F.lit("]")).alias("replacement"), value.alias("text"))
        return F.struct(end.alias("at"), (acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(found, zero, step, lambda acc: acc["out"])


def redact(records: DataFrame, text_col: str = "text") -> DataFrame:
    """The records with ``spans`` and ``masked``: each recognised value replaced by its type."""
    text = F.coalesce(text_col, F.lit(""))
    # both results come from one evaluation of the patterns
    both = let(recognise(text), lambda spans: F.struct(spans.alias("spans"), S.redact_disjoint(text, spans).alias("masked")))
    return records.withColumn("_found", both).withColumn("spans", F.col("_found.spans")).withColumn("masked", F.col("_found.masked")).drop("_found")


def gazetteer_spans(tokens: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``tokens`` (uid, start, end, text) whose text is a name, with the name's label.

    A plain equi join on the word: neither side is broadcast by hint.
    """
    return tokens.join(names.select(F.col("name").alias("text"), "label").distinct(), "text")
