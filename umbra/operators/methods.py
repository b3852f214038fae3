"""Anonymisation methods by name, with what each of them takes.

Neural rewriting (prompt, paraphrase and auto-encoder mechanisms) is an interface: the
temperature, score limits, prompts and cleaning are here, the generator is a plug-in, and
calling such a method without one raises an error rather than inventing text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbra.functions import sampling
from umbra.functions import spans as S
from umbra.operators import dp, kanon, recognise
from umbra.operators.scoring import NaiveBayes


@dataclass(frozen=True)
class Capabilities:
    epsilon: bool = False
    k: bool = False
    dataset: bool = False
    generator: bool = False
    public: bool = False


# What each method takes.
CAPABILITIES = {
    "spacy": Capabilities(), "presidio": Capabilities(), "baroud": Capabilities(), "manual": Capabilities(dataset=True), "petre": Capabilities(dataset=True, k=True),
    "dpmlm": Capabilities(epsilon=True, public=True), "dpprompt": Capabilities(epsilon=True, generator=True), "dpparaphrase": Capabilities(epsilon=True, generator=True), "dpbart": Capabilities(epsilon=True, generator=True),
}

Generator = Callable[[Column, Column], Column]  # prompt, temperature -> text


@dataclass(frozen=True)
class AutoEncoder:
    """A plug-in for the vector mechanism: text to a vector of ``size`` numbers, and back."""

    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    size: int


def prompt(text: Column, method: str) -> Column:
    if method == "dpprompt":
        return F.concat(F.lit("Document : "), text, F.lit("\nParaphrase of the document :"))
    return F.concat(text, F.lit(" >>>>> "))


def clean(output: Column, text: Column, method: str) -> Column:
    """A generated text without its prompt, hard blanks and separators."""
    if method == "dpprompt":
        return F.trim(F.replace(output, prompt(text, method), F.lit("")))
    return F.trim(F.replace(F.replace(F.replace(output, prompt(text, method), F.lit("")), F.lit(" "), F.lit(" ")), F.lit(">"), F.lit("")))


def check(method: str, epsilons: list[float] | None, ks: list[int] | None) -> Capabilities:
    """The method's capabilities; ValueError where a parameter is missing or not taken."""
    if method not in CAPABILITIES:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(sorted(CAPABILITIES))}")
    can = CAPABILITIES[method]
    for taken, given, name in ((can.epsilon, epsilons, "epsilon"), (can.k, ks, "k")):
        if taken and not given:
            raise ValueError(f"{method} needs {name}")
        if given and not taken:
            raise ValueError(f"{method} takes no {name}")
    return can


def anonymise(records: DataFrame, method: str, epsilons: list[float] | None = None, ks: list[int] | None = None, threshold: float = 0.5, generator: Generator | AutoEncoder | None = None, public: DataFrame | None = None, **options) -> DataFrame:
    """uid, idx, parameter, text, spans: one row for each record and distinct parameter (in the order given).

    Blank texts give an empty text.  ``records`` has uid, idx, text and, for methods on a
    dataset, spans and name.  ``public`` is the corpus (column text) whose counts dpmlm
    draws from; ``options`` go to ``dp.perturb``.
    """
    can = check(method, epsilons, ks)
    if can.generator and not isinstance(generator, AutoEncoder) and (generator is None or method == "dpbart"):
        raise NotImplementedError(f"{method} needs {'an AutoEncoder' if method == 'dpbart' else 'a text generator'}; pass one")
    if can.public and public is None:
        raise ValueError(f"{method} needs a public corpus to draw from")
    blank = F.coalesce(F.trim("text"), F.lit("")) == ""
    none = F.lit(None).cast("double").alias("parameter")
    put = lambda rows, text, spans, parameter=none: rows.select("uid", "idx", parameter, F.when(blank, "").otherwise(text).alias("text"), spans.alias("spans"))
    bare = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    if method in ("spacy", "presidio"):
        found = recognise.redact(records.select("uid", "idx", "text"))
        return put(found, F.col("masked"), bare(F.col("spans")))
    if method == "manual":
        kept = records.withColumn("kept", S.keep_first(S.valid(F.coalesce("spans", F.array().cast(dict(records.dtypes)["spans"])), F.col("text"))))
        return put(kept, S.redact_disjoint(F.col("text"), F.col("kept")), bare(F.col("kept")))
    if method == "baroud":
        sure = records.withColumn("kept", S.confident(F.col("spans"), threshold, keep_unknown=False))
        return put(sure, S.mask_by_label(F.col("text"), F.col("kept")), bare(F.col("kept")))
    if method == "petre":
        model = NaiveBayes(records)
        traced = kanon.trace(model, records.withColumnRenamed("name", "label"), "uid", "label", max(ks))
        stops = kanon.grid(traced, "uid", tuple(dict.fromkeys(ks)))
        met = records.select("uid", "idx", "text").join(stops, "uid")
        from umbra.functions.text import tokens

        located = met.withColumn("t", tokens("text"))
        spans = F.transform(F.filter("t", lambda t: F.array_contains("words", F.lower(t["text"]))), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["text"].alias("label")))
        masked = located.withColumn("m", spans)
        return put(masked, S.mask_original(F.col("text"), F.col("m")), F.col("m"), F.col("k").cast("double").alias("parameter"))
    out = None
    for epsilon in dict.fromkeys(epsilons):
        if method == "dpmlm":
            rows = dp.rewrite(records, dp.perturb(records, "uid", epsilon, public, **options), "uid").join(records.select("uid", "idx"), "uid")
            text = F.col("text")
        elif method == "dpbart":  # the encoder's state is clipped and gets Gaussian noise before it is decoded
            rows = records
            noisy = sampling.noisy_vector(generator.encode(F.col("text")), F.concat_ws(":", "uid", F.lit(str(epsilon))), generator.size, float(epsilon))
            text = clean(generator.decode(noisy), F.col("text"), method)
        else:
            clip = {"dpprompt": sampling.PROMPT_CLIP, "dpparaphrase": sampling.PARAPHRASE_CLIP}[method]
            rows = records
            text = clean(generator(prompt(F.col("text"), method), sampling.temperature(F.lit(epsilon), clip)), F.col("text"), method)
        part = put(rows, text, F.array().cast("array<struct<start:int,end:int,label:string>>"), F.lit(float(epsilon)).alias("parameter"))
        out = part if out is None else out.unionByName(part)
    return out
