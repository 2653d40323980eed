"""Heads: balanced logistic regression and ridge regression by category, splits, metrics, and heads as a table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED, TRAIN_SHARE = 42, 0.8


def _part(key: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}"))), 1, 8), 16, 10).cast("long")


def in_training(key: Column, seed: int = SEED, share: float = TRAIN_SHARE) -> Column:
    """Whether a key's row is for training, by its hash alone: the shares hold in expectation, and nothing is shuffled."""
    return _part(key, seed) < int(share * (1 << 32))


def stratified_split(
    rows: DataFrame, key: str, label: str | None, seed: int = SEED, share: float = TRAIN_SHARE, out: str = "train"
) -> DataFrame:
    """``rows`` with a column ``out``: whether a row is for training, exactly ``share`` of each class (rounded half up).

    A class of two or more has a row on both sides; the only row of a class is for training. Within a class, rows are
    taken by the hash of their key (then the key). ``label`` None: all rows are one class. Rows are ranked in 4,096 parts
    of the hash's range by class, and the parts' sizes are summed up, so that no class meets in one task.
    """
    taken = {c.lower() for c in rows.columns}
    name = lambda n: n if n not in taken else name(n + "_")
    h, part, y, n, before, total = map(name, ("hash", "part", "class", "count", "before", "total"))
    placed = rows.withColumns({h: _part(F.col(key), seed), y: F.col(label) if label else F.lit(0)})
    placed = placed.withColumn(part, F.shiftright(h, 20).cast("int"))
    sizes = placed.groupBy(y, part).agg(F.count("*").alias(n))
    sizes = sizes.select(
        F.col(y).alias(f"{y}_"), F.col(part).alias(f"{part}_"), F.expr(f"sum({n}) OVER (PARTITION BY {y} ORDER BY {part}) - {n}").alias(before),
        F.expr(f"sum({n}) OVER (PARTITION BY {y})").alias(total),
    )
    rank = F.col(before) + F.expr(f"row_number() OVER (PARTITION BY {y}, {part} ORDER BY {h}, {key})")
    most = F.floor(F.col(total) * share + 0.5)
    most = F.when(F.col(total) > 1, F.least(F.col(total) - 1, F.greatest(F.lit(1), most))).otherwise(F.lit(1))
    both = placed.join(sizes, F.col(y).eqNullSafe(F.col(f"{y}_")) & (F.col(part) == F.col(f"{part}_")))
    return both.withColumn(out, rank <= most).select(*rows.columns, out)


def class_balance(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))


def balance_test(rows: DataFrame, label: str) -> DataFrame:
    """One row: classes, the size of the smallest, and whether a stratified split is possible (two classes, two of each)."""
    each = class_balance(rows, label).agg(F.count("*").alias("classes"), F.coalesce(F.min("n"), F.lit(0).cast("long")).alias("least"))
    return each.withColumn("balanced", (F.col("classes") == 2) & (F.col("least") >= 2))


def split_for(rows: DataFrame, key: str, label: str, least: int = 1) -> DataFrame:
    """The split that a training program makes: by class if there are two, of ``least`` rows each; else over all rows."""
    found = balance_test(rows, label).first()
    return stratified_split(rows, key, label if found["classes"] == 2 and found["least"] >= least else None)


def fit_logistic(rows: DataFrame, label: str, vector: str = "vector", c: float = 1.0, iterations: int = 1000):
    """A classifier with balanced classes and an L2 penalty of 1 / (2 c). With one class only: its constant (0.0 or 1.0)."""
    data = rows.select(F.col(label).cast("int").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    sizes = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(sizes.values())
    if len(sizes) < 2:
        return float(next(iter(sizes), 0))
    weight = F.lit(0.0)
    for k, m in sizes.items():
        weight = F.when(F.col("label") == k, n / (len(sizes) * m)).otherwise(weight)
    model = LogisticRegression(weightCol="w", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-10)
    return model.fit(data.withColumn("w", weight))


def fit_ridge(rows: DataFrame, target: str, vector: str = "vector", alpha: float = 1.0):
    """Ridge regression with a penalty of alpha. A constant target: that constant."""
    data = rows.select(F.col(target).cast("double").alias("label"), array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    n, spread, mean = data.agg(F.count("*"), F.stddev_pop("label"), F.avg("label")).first()
    if not spread:
        return float(mean or 0.0)
    # Spark scales the penalty by the target's deviation.
    return LinearRegression(solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * spread / n).fit(data)


class Head(NamedTuple):
    """A fitted head: ``logistic`` or ``ridge`` weights and bias, or a ``constant`` (in the bias)."""

    kind: str
    weights: list[float]
    bias: float


def head_of(model) -> Head:
    """A fitted model, or the constant of a target with one value, as a head; a head stays as it is."""
    if isinstance(model, Head):
        return model
    if isinstance(model, float):
        return Head("constant", [], model)
    kind = "logistic" if isinstance(model, LogisticRegressionModel) else "ridge"
    return Head(kind, [float(w) for w in model.coefficients], float(model.intercept))


def head_value(model, vector: Column) -> Column:
    """A classifier's probability of class 1, or a regression's value between 0 and 1."""
    kind, weights, bias = head_of(model)
    if kind == "constant":
        return F.lit(min(1.0, max(0.0, bias)))
    products = F.zip_with(vector, F.lit(weights), lambda a, b: a.cast("double") * b)
    total = F.aggregate(products, F.lit(bias), lambda s, x: s + x)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) if kind == "logistic" else F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def predict(rows: DataFrame, model, out: str, vector: str = "vector") -> DataFrame:
    """``rows`` with a head's value as column ``out``."""
    return rows.withColumn(out, head_value(model, F.col(vector)))


def metrics(rows: DataFrame, label: str, prediction: str) -> DataFrame:
    """By class: precision, recall, f1 and support; nothing divided by nothing is 0."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    each = F.explode(F.array(F.lit(0), F.lit(1))).alias("class")
    rows = rows.groupBy(y.alias("y"), p.alias("p")).agg(F.count("*").alias("n")).select("y", "p", "n", each)
    is_y, is_p = F.col("y") == F.col("class"), F.col("p") == F.col("class")
    sums = rows.groupBy("class").agg(
        F.sum(F.when(is_y & is_p, F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(is_p, F.col("n")).otherwise(0)).alias("chosen"),
        F.sum(F.when(is_y, F.col("n")).otherwise(0)).alias("support"),
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("chosen")), ratio(F.col("tp"), F.col("support"))
    return sums.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"), "support",
    )


def one_class_metrics(train: DataFrame, held: DataFrame, label: str, prediction: str) -> DataFrame:
    """What can be said where the rows held out have one class: that class, accuracy, and the positive rate in training."""
    hit = (F.col(label).cast("int") == F.col(prediction).cast("int")).cast("double")
    judged = held.agg(F.min(F.col(label).cast("int")).alias("class"), F.avg(hit).alias("accuracy"))
    rate = train.agg(F.avg(F.col(label).cast("double")).alias("positive_rate_train"))
    return judged.withColumn("positive_rate_train", rate.scalar())


def report(train: DataFrame, held: DataFrame, label: str, prediction: str) -> DataFrame:
    """Metrics by class, or those of one class if the rows held out have no other."""
    if held.select(F.col(label).cast("int")).distinct().limit(2).count() == 2:
        return metrics(held, label, prediction)
    return one_class_metrics(train, held, label, prediction)


HEADS_SCHEMA = "category string, part string, kind string, weights array<double>, bias double"


def save_heads(spark: SparkSession, heads: dict, path: str) -> None:
    """Heads by category (a model), or by category and part (a dict of models), as a small table."""
    rows = []
    for category, own in heads.items():
        for part, model in (own if isinstance(own, dict) else {"bin": own}).items():
            rows.append((category, part, *head_of(model)))
    spark.createDataFrame(rows, HEADS_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def load_heads(spark: SparkSession, path: str) -> dict[str, dict[str, Head]] | None:
    """Heads by category and part; None if none were saved there, as heads of scenes are optional."""
    try:
        rows = spark.read.schema(HEADS_SCHEMA).parquet(path).collect()  # ten rows
    except AnalysisException:
        return None
    out: dict[str, dict[str, Head]] = {}
    for r in rows:
        out.setdefault(r["category"], {})[r["part"]] = Head(r["kind"], list(r["weights"]), r["bias"])
    return out
