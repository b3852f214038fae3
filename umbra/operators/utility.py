"""Downstream utility: targets, splits, classifiers and their scores."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbra.functions import text as T
from umbra.session import cut

FEATURES = 20_000  # terms kept: the most frequent of words and pairs that two texts hold


# The targets by dataset: where the value stands, and how it is read.
TARGETS = {
    "reddit_feature": ("feature", "nominal"), "reddit_label": ("label", "nominal"), "reddit_age": ("persona_age", "cardinal"), "reddit_age_group": ("persona_age", "ordinal"), "reddit_sex": ("persona_sex", "binary"), "reddit_income_level": ("persona_income_level", "ordinal"),
    "tab_country": ("country", "nominal"), "tab_year": ("year", "cardinal"), "db_bio_label": ("label", "nominal"), "trustpilot_category": ("category", "nominal"), "trustpilot_stars": ("stars", "ordinal"),
}


def first_text(values: Column) -> Column:
    """The first value of an array that is not blank, stripped."""
    return F.try_element_at(F.filter(F.transform(values, lambda v: text_target(v)), lambda v: v.isNotNull()), F.lit(1))


def first_number(values: Column) -> Column:
    """The first value of an array that is a number."""
    return F.try_element_at(F.filter(F.transform(values, lambda v: number_target(v.cast("string"))), lambda v: v.isNotNull()), F.lit(1))


def target(name: str, value: Column, many: bool = False) -> Column:
    """The label of a target from its raw value (an array with ``many``): a number for cardinal ones, else a stripped text; null where there is none."""
    if name not in TARGETS:
        raise ValueError(f"unknown target {name!r}; known: {', '.join(sorted(TARGETS))}")
    mode = TARGETS[name][1]
    if name == "reddit_age_group":
        return T.age_group(number_target(value.cast("string")))
    if mode == "cardinal":
        return first_number(value) if many else number_target(value.cast("string"))
    return first_text(value) if many else text_target(value)


def with_target(records: DataFrame, name: str) -> DataFrame:
    """The records with ``target``, read from the column the target names; records without a value are left out."""
    column = TARGETS[name][0] if name in TARGETS else name
    kind = dict(records.dtypes).get(column)
    if kind is None:
        raise ValueError(f"{name} needs a column {column}")
    return records.withColumn("target", target(name, F.col(column), kind.startswith("array"))).where("target IS NOT NULL")


def specification(name: str, given: str | None = None) -> tuple[str, str]:
    """(vectoriser, head) of a target: ``given`` as "vectoriser+head", else TF-IDF with a perceptron for classes and for numbers."""
    if given:
        vectoriser, _, head = given.partition("+")
        if vectoriser not in VECTORISERS or head not in HEADS:
            raise ValueError(f"unknown model {given!r}; known: {', '.join(VECTORISERS)} + {', '.join(HEADS)}")
        return vectoriser, head
    if name not in TARGETS:
        raise ValueError(f"unknown target {name!r}; known: {', '.join(sorted(TARGETS))}")
    return "tfidf", "perceptron_regressor" if TARGETS[name][1] == "cardinal" else "perceptron"


def text_target(value: Column) -> Column:
    """A stripped string, null if nothing is left."""
    return F.nullif(T.strip(value.cast("string")), F.lit(""))


def number_target(value: Column) -> Column:
    return F.try_to_number(F.regexp_extract(value, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*$", 1), F.lit("99999999.99999999")).cast("double")


def split(records: DataFrame, key: str, label: str | None, share: float, seed: int = 42) -> DataFrame:
    """The records with ``is_test``: within each label (or all, if none is given) the given share by hash order.

    The cut is exact (rounded half to even, at least one and at most all but one of each
    label with two records or more).  Rows are counted by label and hash bucket first, so
    only the records of the bucket that holds the cut are put in order.
    """
    group = F.col(label) if label else F.lit("")
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    hashed = records.withColumn("_label", group).withColumn("_hash", digest).withColumn("_bucket", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    counts = hashed.groupBy("_label", "_bucket").agg(F.count("*").alias("_in"))
    running = Window.partitionBy("_label").orderBy("_bucket")
    sums = counts.withColumn("_upto", F.sum("_in").over(running)).withColumn("_all", F.sum("_in").over(Window.partitionBy("_label")))
    wanted = F.bround(F.col("_all") * share, 0).cast("long")
    cut = F.when(F.col("_all") < 2, F.lit(0)).otherwise(F.least(F.greatest(wanted, F.lit(1)), F.col("_all") - 1))
    limits = sums.select(F.col("_label").alias("_l"), F.col("_bucket").alias("_b"), (F.col("_upto") - F.col("_in")).alias("_before"), cut.alias("_cut"), F.col("_upto").alias("_to"))
    met = hashed.join(limits, hashed["_label"].eqNullSafe(limits["_l"]) & (hashed["_bucket"] == limits["_b"])).drop("_l", "_b")
    whole = met.where((F.col("_to") <= F.col("_cut")) | (F.col("_before") >= F.col("_cut"))).withColumn("is_test", F.col("_to") <= F.col("_cut"))
    place = F.row_number().over(Window.partitionBy("_label", "_bucket").orderBy("_hash", key))
    edge = met.where((F.col("_to") > F.col("_cut")) & (F.col("_before") < F.col("_cut"))).withColumn("is_test", F.col("_before") + place <= F.col("_cut"))
    return whole.unionByName(edge).drop("_label", "_hash", "_bucket", "_before", "_cut", "_to")


def f1(predicted: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """macro_f1, loss, n: unweighted mean of the labels' F1 over labels that occur or are predicted."""
    hits = predicted.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n_true"), F.count_if(F.col(label) == F.col(guess)).alias("tp"))
    guesses = predicted.groupBy(F.col(guess).alias("l")).agg(F.count("*").alias("n_guess"))
    both = hits.join(guesses, "l", "full")
    one = 2 * F.coalesce("tp", F.lit(0)) / (F.coalesce("n_true", F.lit(0)) + F.coalesce("n_guess", F.lit(0)))
    return both.agg(F.round(F.avg(one), 6).alias("macro_f1"), F.round(1 - F.avg(one), 6).alias("loss"), F.coalesce(F.sum("n_true"), F.lit(0)).alias("n"))


def regression_scores(predicted: DataFrame, label: str = "label", guess: str = "predicted") -> DataFrame:
    """r2 and rmse; r2 is null where the labels do not vary."""
    error = F.col(label) - F.col(guess)
    spread = F.var_pop(label) * F.count("*")
    return predicted.agg(F.round(1 - F.sum(error * error) / F.nullif(spread, F.lit(0.0)), 6).alias("r2"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.count("*").alias("n"))


# Heads and what builds them.
def _logistic():
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="y", featuresCol="x", maxIter=20, regParam=0.01)


def _linear():
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(labelCol="y", featuresCol="x", maxIter=20, regParam=0.1, solver="l-bfgs")


def _perceptron(features: int, labels: int):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(labelCol="y", featuresCol="x", layers=[features, *HIDDEN, labels], maxIter=30, seed=7)


HIDDEN = (128, 64)
HEADS = ("logistic", "linear", "perceptron", "perceptron_regressor")
NUMERIC = ("linear", "perceptron_regressor")
VECTORISERS = ("tfidf",)


class PerceptronRegressor:
    """Least squares through two hidden layers, fitted by Adam on whole gradients.

    Every step sums the gradients of the partitions in a tree, so what a task holds is one
    batch, and what reaches the driver is one gradient (features x first layer numbers).
    """

    def __init__(self, features: int, hidden: tuple[int, ...] = HIDDEN, steps: int = 60, rate: float = 0.01, seed: int = 7):
        rng = np.random.default_rng(seed)
        sizes = [features, *hidden, 1]
        self.weights = [rng.normal(0, np.sqrt(2 / max(a, 1)), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.biases = [np.zeros(b) for b in sizes[1:]]
        self.steps, self.rate, self.mean, self.scale = steps, rate, 0.0, 1.0

    def _forward(self, index: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
        first = value @ self.weights[0][index] + self.biases[0] if len(index) else self.biases[0].copy()
        layers = [np.maximum(first, 0)]
        for n, (w, b) in enumerate(zip(self.weights[1:], self.biases[1:]), 1):
            out = layers[-1] @ w + b
            layers.append(out if n == len(self.weights) - 1 else np.maximum(out, 0))
        return layers

    def _gradient(self, rows) -> tuple[list[np.ndarray], list[np.ndarray], int]:
        dw, db, count = [np.zeros_like(w) for w in self.weights], [np.zeros_like(b) for b in self.biases], 0
        for index, value, y in rows:
            layers = self._forward(index, value)
            delta = layers[-1] - (y - self.mean) / self.scale
            count += 1
            for n in range(len(self.weights) - 1, 0, -1):
                dw[n] += np.outer(layers[n - 1], delta)
                db[n] += delta
                delta = (self.weights[n] @ delta) * (layers[n - 1] > 0)
            if len(index):
                dw[0][index] += np.outer(value, delta)
            db[0] += delta
        return dw, db, count

    def fit(self, rows: DataFrame) -> "PerceptronRegressor":
        """``rows`` has x (a vector) and y."""
        held = rows.where("y IS NOT NULL").select("x", "y").rdd.map(lambda r: (np.asarray(r["x"].indices if hasattr(r["x"], "indices") else np.arange(len(r["x"])), int), np.asarray(r["x"].values if hasattr(r["x"], "indices") else r["x"], float), float(r["y"]))).persist(StorageLevel.MEMORY_AND_DISK)
        stats = held.map(lambda r: r[2]).stats()
        self.mean, self.scale = stats.mean(), stats.stdev() or 1.0
        if not stats.count():
            return self
        m = [np.zeros_like(p) for p in (*self.weights, *self.biases)]
        v = [np.zeros_like(p) for p in (*self.weights, *self.biases)]
        add = lambda a, b: ([x + y for x, y in zip(a[0], b[0])], [x + y for x, y in zip(a[1], b[1])], a[2] + b[2])
        for step in range(1, self.steps + 1):
            sent = rows.sparkSession.sparkContext.broadcast(self)
            dw, db, n = held.mapPartitions(lambda part: iter([sent.value._gradient(part)])).treeReduce(add)
            for at, (p, g) in enumerate(zip((*self.weights, *self.biases), (*dw, *db))):
                g = g / n
                m[at], v[at] = 0.9 * m[at] + 0.1 * g, 0.999 * v[at] + 0.001 * g * g
                p -= self.rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
            sent.unpersist()
        held.unpersist()
        return self

    def transform(self, rows: DataFrame) -> DataFrame:
        """The rows with ``prediction``."""
        sent = rows.sparkSession.sparkContext.broadcast(self)

        @F.udf("double")
        def predict(x):
            sparse = hasattr(x, "indices")
            index = np.asarray(x.indices if sparse else np.arange(len(x)), int)
            return float(sent.value._forward(index, np.asarray(x.values if sparse else x, float))[-1][0] * sent.value.scale + sent.value.mean)

        return rows.withColumn("prediction", predict("x"))


class Experiment:
    """Fits a vectoriser and a head on original training texts; scores any text column of the test records."""

    def __init__(self, records: DataFrame, key: str, label: str, head: str = "logistic", features: int = FEATURES, text: str = "text", share: float = 0.25):
        from pyspark.ml import Pipeline
        from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer
        from pyspark.ml.linalg import Vectors

        if head not in HEADS:
            raise ValueError(f"unknown head {head!r}; known: {', '.join(HEADS)}")
        self.key, self.label, self.head, self.text = key, label, head, text
        parts = split(records.where(F.col(label).isNotNull() & F.col(text).isNotNull()), key, None if head in NUMERIC else label, share)
        self.train, self.test = parts.where(~F.col("is_test")), parts.where("is_test")
        words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+", minTokenLength=2)
        pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
        both = SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__")
        train = cut(self.train.withColumn("_text", F.col(text)))
        counted = Pipeline(stages=[words, pairs, both, CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=features, minDF=2)]).fit(train)
        inverse = IDF(inputCol="_tf", outputCol="_idf").fit(counted.transform(train))
        # idf = ln((1 + n) / (1 + df)) + 1, the rows brought to length 1
        weigh = ElementwiseProduct(inputCol="_tf", outputCol="_w", scalingVec=Vectors.dense(inverse.idf.toArray() + 1.0))
        stages = [*counted.stages, weigh, Normalizer(inputCol="_w", outputCol="x", p=2.0)]
        size = len(counted.stages[-1].vocabulary)
        if head in NUMERIC:
            train = train.withColumn("y", F.col(label).cast("double"))
            model = _linear() if head == "linear" else PerceptronRegressor(size)
        else:
            stages.append(StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"))
            model = _logistic() if head == "logistic" else _perceptron(size, self.train.select(label).distinct().count() + 1)
        self.vectoriser = Pipeline(stages=stages).fit(train)
        self.model = model.fit(self.vectoriser.transform(train).select("x", "y"))

    def predict(self, text: str | None = None) -> DataFrame:
        """key, label, predicted of the test records, read from a text column."""
        rows = self.vectoriser.transform(self.test.withColumn("_text", F.col(text or self.text)))
        out = self.model.transform(rows)
        if self.head in NUMERIC:
            return out.select(self.key, F.col(self.label).cast("double").alias("label"), F.col("prediction").alias("predicted"))
        names = self.vectoriser.stages[-1].labels
        known = F.array(*[F.lit(n) for n in names])
        return out.select(self.key, F.col(self.label).alias("label"), F.try_element_at(known, F.col("prediction").cast("int") + 1).alias("predicted"))

    def scores(self, text: str | None = None) -> DataFrame:
        return regression_scores(self.predict(text)) if self.head in NUMERIC else f1(self.predict(text))

    def drops(self, text: str) -> DataFrame:
        """Scores of the original texts, of the given column, and what is lost."""
        a, b = self.scores(), self.scores(text)
        names = [c for c in a.columns if c not in ("n", "loss", "rmse")]
        left, right = a.select(*[F.col(c).alias(f"{c}_baseline") for c in names]), b.select(*[F.col(c).alias(f"{c}_current") for c in names], "n")
        return left.crossJoin(right).select("*", *[F.round(F.col(f"{c}_baseline") - F.col(f"{c}_current"), 6).alias(f"{c}_drop") for c in names])
