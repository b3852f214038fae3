"""Command line: ``python -m umbra.cli COMMAND --config FILE``.

Commands: stats, anonymise, privacy, divergence, utility, identify (the re-identification
model), detect (the span detector), explain, matrix.

The configuration is YAML with ``dataset``, ``data_in`` and what the command takes:
``method``, ``epsilons``, ``ks``, ``preset``, ``texts`` or ``indices``, ``start_idx``,
``annotations``, ``public``, ``output``, ``resume`` (anonymise); ``sources`` (privacy,
divergence, utility); ``mode`` (train, evaluate, predict), ``model``, ``output``
(identify, detect); ``report`` (text, json or jsonl) and ``report_path``.
"""

from __future__ import annotations

import argparse
import os

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import spans as S
from umbra.operators import detection, detector, methods, scoring, similarity, utility
from umbra.operators import spans as OS
from umbra.operators.records import by_indices
from umbra.session import local_session
from umbra.sources import readers, sinks


def load_config(path: str) -> dict:
    """A YAML file, with or without its ending, also under ``configs/experiments``."""
    for folder in ("", "configs/experiments"):
        for ending in ("", ".yaml", ".yml"):
            file = os.path.join(folder, path + ending)
            if os.path.isfile(file):
                with open(file, encoding="utf-8") as text:
                    return yaml.safe_load(text) or {}
    raise FileNotFoundError(path)


def _records(spark: SparkSession, config: dict) -> DataFrame:
    return readers.read_dataset(spark, config["dataset"], config["data_in"], **({"max_records": config["max_records"]} if config.get("max_records") else {}))


def stats(spark: SparkSession, config: dict) -> str:
    rows = _records(spark, config)
    row = rows.agg(F.count("*").alias("records"), F.countDistinct("uid").alias("uids"), F.countDistinct("name").alias("names"), F.round(F.avg(F.length("text")), 2).alias("average_length"), F.max(F.length("text")).alias("longest")).first()
    return "\n".join(f"{k}: {v}" for k, v in row.asDict().items())


# Presets of a run's parameters.
PRESETS = {f"eps_{e}": {"epsilons": [float(e)], "temperature": 0.3 if e == 100 else 0.1} for e in (10, 25, 100, 250)} | {f"k_{k}": {"ks": [k]} for k in (2, 3, 5)}


def with_preset(config: dict) -> dict:
    """The configuration with its preset's values where it has none of its own."""
    name = config.get("preset")
    if name is None:
        return config
    if name not in PRESETS:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}")
    return PRESETS[name] | config


def chosen(spark: SparkSession, config: dict) -> DataFrame:
    """The records of a run: given texts, given indices, or the dataset from ``start_idx`` on; before any work is done on them."""
    if config.get("texts") and config.get("indices"):
        raise ValueError("give texts or indices, not both")
    if config.get("texts"):
        if methods.CAPABILITIES.get(config.get("method"), methods.Capabilities()).dataset:
            raise ValueError(f"{config['method']} needs records of a dataset, not texts")
        rows = [(n, f"text_{n}", text) for n, text in enumerate(config["texts"])]
        return spark.createDataFrame(rows, "idx long, uid string, text string")
    rows = _records(spark, config)
    if config.get("annotations"):
        files = config["annotations"] if isinstance(config["annotations"], list) else str(config["annotations"]).split(",")
        given = OS.merge_sources([readers.read_annotations(spark, f.strip()) for f in files])
        rows = rows.drop("spans").join(given, "uid", "left")
    if config.get("indices"):
        rows = by_indices(rows, config["indices"])
    return rows.where(F.col("idx") >= config["start_idx"]) if config.get("start_idx") else rows


def anonymise(spark: SparkSession, config: dict) -> str:
    config = with_preset(config)
    public = spark.read.parquet(config["public"]).select("text") if config.get("public") else None
    rows = chosen(spark, config)
    out = methods.anonymise(rows, config["method"], config.get("epsilons"), config.get("ks"), config.get("threshold", 0.5), public=public)
    if config.get("output") is None:
        sinks.print_records(out)
        return "printed"
    sinks.write_run(out, config["output"], bool(config.get("resume")))
    return f"written to {config['output']}"


def _mode(config: dict) -> str:
    mode = config.get("mode", "evaluate")
    if mode not in ("train", "evaluate", "predict"):
        raise ValueError(f"unknown mode {mode!r}; known: train, evaluate, predict")
    return mode


def _attack_model(spark: SparkSession, config: dict, named: DataFrame) -> scoring.NaiveBayes:
    return scoring.NaiveBayes.load(spark, config["model"]) if config.get("model") and _mode(config) != "train" else scoring.NaiveBayes(named)


def identify(spark: SparkSession, config: dict) -> str:
    """The re-identification model: train (counts to ``model``), evaluate (accuracy by source and individual), predict (best labels to ``output``)."""
    named = _records(spark, config).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "uid"))
    model = _attack_model(spark, config, named)
    if _mode(config) == "train":
        model.save(config["model"])
        return f"written to {config['model']}"
    if _mode(config) == "predict":
        model.best(named, "uid").select("uid", "predicted", "chance").write.mode("overwrite").json(config["output"])
        return f"written to {config['output']}"
    truth = named.select("uid", F.col("name").alias("label"))
    sources = [("original", named), *((n, met.withColumn("text", F.col("rewritten"))) for n, met in (_rewritten(spark, config, named) if config.get("sources") else ()))]
    heads = None
    for name, rows in sources:
        single = scoring.individual_accuracy(model.summed(rows)).agg(F.round(F.avg((F.col("true_label") == F.col("predicted")).cast("double")), 6).alias("individual_accuracy"))
        head = scoring.accuracy(model.best(rows, "uid"), truth, "uid").crossJoin(single).withColumn("dataset", F.lit(name))
        heads = head if heads is None else heads.unionByName(head)
    return sinks.report(heads, None, config.get("report", "text"))


def detect(spark: SparkSession, config: dict) -> str:
    """The span detector: train (counts to ``model``), evaluate (strict, exact, partial scores), predict (spans to ``output``)."""
    records = chosen(spark, config)
    if _mode(config) == "train":
        detector.train(records.where("spans IS NOT NULL")).save(config["model"])
        return f"written to {config['model']}"
    model = scoring.NaiveBayes.load(spark, config["model"])
    found = detector.predict(model, records, "uid", config.get("threshold", 0.0))
    if _mode(config) == "predict":
        sinks.write_run(found.select("idx", "text", "spans"), config["output"])
        return f"written to {config['output']}"
    spans = lambda rows: rows.select("uid", F.explode("spans").alias("s")).select("uid", "s.start", "s.end", "s.label").where("label IS NOT NULL").distinct()
    return sinks.report(detection.prf(spans(records), spans(found)), None, config.get("report", "text"), order="mode")


def explain(spark: SparkSession, config: dict) -> str:
    """A table of the words of one text: leave-one-out and Shapley scores with their soft-max."""
    named = _records(spark, config).withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "uid"))
    model = _attack_model(spark, config | {"mode": "evaluate"}, named)
    asked = named.where(F.col("idx") == config.get("index", 0)) if not config.get("texts") else spark.createDataFrame([("given", config["texts"][0])], "uid string, text string")
    both = scoring.explain(model, asked, "uid").withColumnRenamed("score", "greedy").join(scoring.shapley(model, asked, "uid").withColumnRenamed("score", "shap"), ["uid", "word"])
    return sinks.score_table([row.asDict() for row in both.orderBy("word").toLocalIterator()], ("greedy", "shap"), float(config.get("temperature", 1.0)))


def matrix(spark: SparkSession, config: dict) -> str:
    """The command of every dataset, method and preset; nothing is run."""
    lines = []
    for dataset in config.get("datasets", sorted(readers.READERS)):
        for name, can in methods.CAPABILITIES.items():
            presets = [p for p in PRESETS if p.startswith("eps_")] if can.epsilon else [p for p in PRESETS if p.startswith("k_")] if can.k else [None]
            lines += [f"python -m umbra.cli anonymise --set dataset={dataset} --set method={name}" + (f" --set preset={p}" if p else "") for p in presets]
    return "\n".join(lines)


def _rewritten(spark: SparkSession, config: dict, records: DataFrame):
    for name, path in readers.collect_sources(spark, *config["sources"]):
        run = readers.read_run(spark, path)
        met = records.join(run.select("idx", F.col("spans").alias("run_spans"), F.col("text").alias("run_text")), "idx", "left")
        # a run without spans is read by its text
        masked = F.when(F.size("run_spans") > 0, S.apply_annotations(F.col("text"), F.col("run_spans"))).otherwise(F.coalesce("run_text", "text"))
        yield name, met.withColumn("rewritten", masked)


def privacy(spark: SparkSession, config: dict) -> str:
    records = _records(spark, config)
    named = records.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), "uid"))
    model = scoring.NaiveBayes(named)
    before = model.ranks(named, "uid")
    heads, rows = None, None
    for name, met in _rewritten(spark, config, named):
        delta = scoring.rank_deltas(before, model.ranks(met, "uid", text="rewritten"), "uid").join(named.select("uid", F.col("idx").alias("index")), "uid")
        head = scoring.summary(delta, "delta").withColumn("dataset", F.lit(name)).withColumn("score", F.lit(0.0))
        entry = delta.withColumn("dataset", F.lit(name))
        heads, rows = (head, entry) if heads is None else (heads.unionByName(head), rows.unionByName(entry))
    return sinks.report(heads, rows, config.get("report", "text")) if heads is not None else "no sources"


def divergence(spark: SparkSession, config: dict) -> str:
    records, heads = _records(spark, config), None
    for name, met in _rewritten(spark, config, records):
        rows = similarity.tfidf_cosine(met, "uid", "text", "rewritten").withColumn("divergence", 1 - F.col("similarity"))
        head = scoring.summary(rows, "divergence").drop("improved", "degraded", "unchanged").withColumn("dataset", F.lit(name))
        heads = head if heads is None else heads.unionByName(head)
    return sinks.report(heads, None, config.get("report", "text")) if heads is not None else "no sources"


def utility_report(spark: SparkSession, config: dict) -> str:
    records, heads = _records(spark, config), None
    bad: list[str] = []  # sources without enough records that have a label
    for name, met in _rewritten(spark, config, records):
        wanted = config["target"]
        labelled = utility.with_target(met, wanted)
        head_name = config.get("head") or utility.specification(wanted, config.get("model"))[1]
        if labelled.select("uid").distinct().count() < 2:
            bad.append(f"dataset={name}  insufficient coverage")
            continue
        made = utility.Experiment(labelled, "uid", "target", head_name)
        head = made.drops("rewritten").withColumn("dataset", F.lit(name))
        heads = head if heads is None else heads.unionByName(head)
    told = [sinks.report(heads, None, config.get("report", "text"))] if heads is not None else []
    return "\n".join([*told, *bad]) or "no sources"


COMMANDS = {"identify": identify, "detect": detect, "explain": explain, "matrix": matrix, "stats": stats, "anonymise": anonymise, "privacy": privacy, "divergence": divergence, "utility": utility_report}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="umbra")
    parser.add_argument("command", choices=sorted(COMMANDS))
    parser.add_argument("--config")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="a value of the configuration, as YAML")
    args = parser.parse_args(argv)
    config = load_config(args.config) if args.config else {}
    for pair in args.set:
        key, _, value = pair.partition("=")
        config[key] = yaml.safe_load(value)
    spark = SparkSession.getActiveSession() or local_session()
    sinks.put(COMMANDS[args.command](spark, config), config.get("report_path"))


if __name__ == "__main__":
    main()
