"""Readers of the four dataset formats, of run outputs and of annotation files.

Every reader returns records: idx, uid, name, text, spans (where the format has them) and
typed metadata columns.  ``idx`` is the place in the file where the format defines one.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.operators.nested import ANNOTATIONS, MENTION, MENTION_COLUMNS, parse, pivot
from umbra.operators.records import numbered
from umbra.operators.spans import last_by_index

TRUSTPILOT = "review_id string, review string, category string, stars string, title string, company string"
DB_BIO = "text string, l1 string, l2 string, l3 string, wiki_name string, label string, people string, word_count long"
PERSONALITY = "age int, sex string, city_country string, birth_city_country string, education string, occupation string, income string, income_level string, relationship_status string"
REDDIT = f"response string, personality struct<{PERSONALITY.replace(', ', ',').replace(' ', ':')}>, label string, feature string, hardness int, question_asked string, guess string, guess_correctness string"
SPANS = "array<struct<start:int,end:int,label:string,text:string,replacement:string,confidence:double,annotator:string,metadata:map<string,string>>>"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 1), idx (from 0, blank lines not counted) and value of each line that is not blank.

    A JSON-lines file has an order, Spark's rows have none: numbers are formed from the
    place of each line in its partition and the counts of the partitions before it.
    """
    raw = spark.read.text(path, lineSep="\n").select("value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"), (F.trim("value") != "").alias("filled"))
    counts = raw.groupBy("part").agg(F.count("*").alias("n"), F.count_if("filled").alias("k"), F.min("id").alias("first"))  # one row for each partition
    earlier = Window.orderBy("part")
    before = counts.select("part", "first", (F.sum("n").over(earlier) - F.col("n")).alias("lines"), (F.sum("k").over(earlier) - F.col("k")).alias("rows"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    kept = raw.where("filled").withColumn("place", place).join(before, "part")
    return kept.select((F.col("lines") + F.col("id") - F.col("first") + 1).alias("line"), (F.col("rows") + F.col("place")).alias("idx"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line, place and the fields of each line; reading a line that is no JSON fails with its number."""
    if not path.endswith((".jsonl", ".json")):
        raise ValueError(f"unsupported file format: {path}")
    # tested where the lines are used, in the same pass; raise_error carries the line number
    message = F.concat(F.lit(f"invalid JSON in {path}, line "), F.col("line").cast("string"))
    checked = F.when(F.expr("try_parse_json(value)").isNull(), F.raise_error(message).cast("string")).otherwise(F.col("value"))
    lines = numbered_lines(spark, path).withColumn("value", checked)
    return lines.select("line", F.col("idx").alias("place"), F.from_json("value", schema).alias("r")).select("line", "place", "r.*")


def _limit(rows: DataFrame, most: int | None, order: str = "idx") -> DataFrame:
    return rows if most is None else rows.orderBy(order).limit(most)


def read_tab(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Court cases: one JSON array; spans are null where a case has no annotations."""
    text = spark.read.text(path, wholetext=True).select(F.expr("parse_json(value)").alias("v"))
    items = text.select(F.expr("cast(v AS array<variant>)").alias("a")).select(F.posexplode("a").alias("idx", "v"))
    get = lambda field, kind="string": F.expr(f"try_variant_get(v, '$.{field}', '{kind}')")
    rows = items.select("idx", F.coalesce(get("doc_id"), F.col("idx").cast("string")).alias("uid"), F.coalesce(get("meta.applicant"), F.lit("")).alias("name"), get("text").alias("text"), get("quality_checked", "boolean").alias("quality_checked"), get("task").alias("task"), get("dataset_type").alias("dataset_type"), F.to_json(get("meta", "variant")).alias("meta"), F.to_json(get("annotations", "variant")).alias("annotations"))
    rows = _limit(rows, max_records)
    found = pivot(parse(rows, "uid", "annotations", ANNOTATIONS), "uid", MENTION, MENTION_COLUMNS)
    span = F.struct(F.col("keys")[0].alias("annotator"), F.col("ordinals")[0].alias("ord"), F.col("start_offset").alias("start"), F.col("end_offset").alias("end"), F.col("entity_type").alias("label"), F.col("span_text").alias("text"), "identifier_type", "confidential_status")
    return rows.join(found.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("spans")), "uid", "left").drop("annotations")


def read_trustpilot(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Reviews, JSON lines only; written escapes are resolved."""
    rows = read_jsonl(spark, path, TRUSTPILOT).withColumnRenamed("place", "idx")
    uid = F.coalesce(F.nullif("review_id", F.lit("")), F.col("idx").cast("string"))
    return _limit(rows.select("idx", uid.alias("uid"), uid.alias("name"), T.recode(F.col("review")).alias("text"), "category", "stars", "title", "company"), max_records)


def _arrow_batches(path: str):
    """Record batches of an Arrow stream or file, one after the other."""
    import pyarrow as pa

    with pa.memory_map(path) as source:
        try:
            yield from pa.ipc.open_stream(source)
        except pa.ArrowInvalid:
            held = pa.ipc.open_file(source)
            yield from (held.get_batch(n) for n in range(held.num_record_batches))


def read_db_bio(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Biographies, Arrow or Parquet; the uid falls back from page name to label to place."""
    if path.endswith(".arrow"):
        # the driver counts the batches, the workers read them: the file lies where both see it
        sizes = [batch.num_rows for batch in _arrow_batches(path)]
        parts = spark.createDataFrame([(n, sum(sizes[:n])) for n in range(len(sizes))], "batch int, first long").repartition(max(1, min(len(sizes), spark.sparkContext.defaultParallelism)))

        def load(batches):
            for part in batches:
                wanted = dict(zip(part["batch"], part["first"]))
                for number, held in enumerate(_arrow_batches(path)):
                    if number in wanted:
                        made = held.to_pandas()
                        made["idx"] = range(wanted[number], wanted[number] + len(made))
                        yield made[["idx", *[c.split()[0] for c in DB_BIO.split(", ")]]]

        rows = parts.mapInPandas(load, f"idx long, {DB_BIO}")
    else:
        rows = numbered(spark.read.parquet(path), ["wiki_name", "text"])
    uid = F.coalesce(F.nullif("wiki_name", F.lit("")), F.nullif("label", F.lit("")), F.col("idx").cast("string"))
    return _limit(rows.select("idx", uid.alias("uid"), F.col("people").alias("name"), "text", "label", "l1", "l2", "l3", "word_count", "wiki_name"), max_records)


def read_reddit(spark: SparkSession, path: str, max_records: int | None = None) -> DataFrame:
    """Question and answer pairs: rows with a blank answer fall out but count in the numbering; max_records counts kept rows."""
    rows = read_jsonl(spark, path, REDDIT).withColumnRenamed("place", "idx")
    keys = [part.split()[0] for part in PERSONALITY.split(", ")]
    named = F.when(F.col("personality").isNull(), T.persona_hash([])).otherwise(T.persona_hash([(k, F.col(f"personality.{k}")) for k in keys]))
    persona = [F.col(f"personality.{k}").alias(f"persona_{k}") for k in keys]
    kept = rows.withColumn("text", T.strip(F.col("response"))).where(F.length("text") > 0)
    return _limit(kept.select("idx", F.concat(F.lit("reddit_"), (F.col("idx") + 1).cast("string")).alias("uid"), named.alias("name"), "text", "label", "feature", "hardness", F.col("question_asked").alias("question"), "guess", "guess_correctness", *persona), max_records)


READERS: dict[str, Callable[..., DataFrame]] = {"tab": read_tab, "trustpilot": read_trustpilot, "db_bio": read_db_bio, "reddit": read_reddit}


def read_dataset(spark: SparkSession, name: str, path: str, **options) -> DataFrame:
    """Records of a dataset by its name, in any case."""
    if name.lower() not in READERS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(sorted(READERS))}")
    return READERS[name.lower()](spark, path, **options)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """idx, spans, text of a run output: the last line of an index wins, gaps are filled with empty spans."""
    if not path.endswith(".jsonl"):
        raise ValueError(f"unsupported annotation file format: {path}")
    rows = read_jsonl(spark, path, f"idx string, text string, spans {SPANS}").withColumn("idx", F.expr("try_cast(idx AS long)")).where("idx IS NOT NULL")
    packed = rows.select("idx", "line", F.struct("text", "spans").alias("r"))
    empty = F.from_json(F.lit("[]"), SPANS)
    return last_by_index(packed, "r", "line").select("idx", F.coalesce("r.spans", empty).alias("spans"), F.col("r.text").alias("text"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """uid, spans of an annotation file: a map of uid to span objects or [start, end] pairs, by its first item."""
    text = spark.read.text(path, wholetext=True)
    items = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("uid", "v"))
    objects, pairs = F.from_json("v", SPANS), F.from_json("v", "array<array<int>>")
    made = F.transform(F.filter(pairs, lambda p: F.size(p) >= 2), lambda p: F.struct(p[0].alias("start"), p[1].alias("end"), *[F.lit(None).cast(k).alias(n) for n, k in (("label", "string"), ("text", "string"), ("replacement", "string"), ("confidence", "double"), ("annotator", "string"), ("metadata", "map<string,string>"))]))
    first = F.regexp_extract("v", r"^\s*\[\s*([\[{])", 1)
    return items.select("uid", F.when(first == "{", objects).when(first == "[", made).otherwise(F.from_json(F.lit("[]"), SPANS)).alias("spans"))


def read_annotation_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Annotation files of a folder by their name without ending; files that are no JSON object are left out with a warning."""
    import warnings

    out = {}
    for file in _files(spark, folder, ".json"):
        whole = spark.read.text(file, wholetext=True).select(F.expr("try_parse_json(value)").isNotNull().alias("ok"), F.substring(F.trim(F.regexp_replace("value", r"^\s+", "")), 1, 1).alias("first"))
        row = whole.first()
        if row is None or not row["ok"] or row["first"] != "{":
            warnings.warn(f"{file} is no annotation file", stacklevel=2)
            continue
        out[PurePosixPath(file).stem] = read_annotations(spark, file)
    return out


def texts_by_uid(run: DataFrame, records: DataFrame) -> DataFrame:
    """uid, text of a run's rewritten texts, by way of the index; empty texts and unknown indices fall out."""
    return run.where(F.length("text") > 0).select("idx", F.col("text").alias("rewritten")).join(records.select("idx", "uid"), "idx").select("uid", "rewritten")


def _files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Paths of files under a folder (or the file itself), in order, on any file system Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    if not system.exists(root):
        return []
    if system.getFileStatus(root).isFile():
        return [path]
    listed, out = system.listFiles(root, True), []
    while listed.hasNext():
        name = listed.next().getPath().toString()
        if name.endswith(suffix):
            out.append(name.removeprefix("file:"))
    return sorted(out)


def collect_sources(spark: SparkSession, *paths: str) -> list[tuple[str, str]]:
    """(name, path) of the run outputs under paths, each once, named ``{method}_{dataset}_{n}``."""
    counts: dict[tuple[str, str], int] = {}
    out, seen = [], set()
    for path in paths:
        for file in _files(spark, path, ".jsonl"):
            if file in seen:
                continue
            seen.add(file)
            parts = PurePosixPath(file).parts
            method, dataset = (parts[-2] if len(parts) > 1 else ""), (parts[-3] if len(parts) > 2 else "")
            n = counts.get((method, dataset), 0)
            counts[method, dataset] = n + 1
            out.append((f"{method}_{dataset}_{n}", file))
    return out


def list_stamps(spark: SparkSession, dataset: str, model: str, base: str = "outputs") -> list[str]:
    """Stamps of a model's runs, in order; none if there is no folder."""
    return sorted(PurePosixPath(f).stem for f in _files(spark, f"{base}/{dataset}/{model}", ".jsonl"))


def read_run_of(spark: SparkSession, dataset: str, model: str, stamp: str, base: str = "outputs") -> DataFrame:
    return read_run(spark, f"{base}/{dataset}/{model}/{stamp}.jsonl")


def latest_runs(spark: SparkSession, folder: str) -> dict[str, str]:
    """The last run of each model's folder."""
    out: dict[str, str] = {}
    for file in _files(spark, folder, ".jsonl"):
        out[PurePosixPath(file).parent.name] = file
    return out


def split_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Paths of the train, dev and test files of a folder; a file is the test split alone."""
    found = _files(spark, path, ".json")
    if found == [path]:
        return {"test": path}
    return {PurePosixPath(f).stem: f for f in found if PurePosixPath(f).stem in ("train", "dev", "test")}


def latest_checkpoint(names: list[str]) -> str | None:
    """The folder name ``checkpoint-N`` with the greatest N."""
    import re

    numbered = [(int(m.group(1)), n) for n in names if (m := re.fullmatch(r"checkpoint-(\d+)", n))]
    return max(numbered)[1] if numbered else None
