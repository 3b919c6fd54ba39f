"""Splits, preprocessing, classifiers and scoring on top of MLlib."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVCModel, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.functions.values import label_code
from erashift.operators.evaluation import score_minmax
from erashift.operators.linear_fit import ColumnStats, Problem, TrainingSet, collect_statistics, fit_sets
from erashift.operators.order_stats import exact_quantiles, hash_cut, hash_order, melt
from erashift.operators.skew import stored_small


def labelled(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Add y = 1 for bot, 0 for human; drop every other row."""
    return df.withColumn("y", label_code(F.col(label_col))).filter("y is not null")


def split_sizes(rows: DataFrame, size: float = fv.SPLIT_SIZE) -> DataFrame:
    """Rows to hold out per (dataset, y): (dataset, y, k).

    ceil(size * N) rows of an era in total, classes in proportion, a left-over
    training row going to the class with the largest remainder.
    """
    counts = rows.groupBy("dataset", "y").agg(F.count(F.lit(1)).alias("n"))
    era = Window.partitionBy("dataset")
    train_n = F.sum("n").over(era) - F.ceil(F.lit(float(size)) * F.sum("n").over(era))
    shares = (
        counts.withColumns({"train_n": train_n, "all_n": F.sum("n").over(era)})
        .withColumn("exact", F.col("n") * F.col("train_n") / F.col("all_n"))
        .withColumn("whole", F.floor("exact"))
    )
    by_remainder = era.orderBy(F.desc(F.col("exact") - F.col("whole")), F.desc("y"))
    left_over = F.col("train_n") - F.sum("whole").over(era)
    extra = (F.row_number().over(by_remainder) <= left_over).cast("bigint")
    return shares.select("dataset", "y", (F.col("n") - F.col("whole") - extra).alias("k"))


def stratified_split(
    rows: DataFrame, size: float = fv.SPLIT_SIZE, seed: int = fv.SEED, key: str = "user_id",
) -> DataFrame:
    """Add is_test (0/1): the k rows of each class with the smallest md5(seed, key).

    Only the keys are counted and ordered; the frame itself is not shuffled,
    it is compared with one cut hash per class.
    """
    h = hash_order(seed, F.col(key))
    cuts = stored_small(  # two rows per era
        hash_cut(rows.select("dataset", "y", h.alias("h")), ["dataset", "y"], split_sizes(rows, size)))
    held = F.coalesce(h <= F.col("cut"), F.lit(False)).cast("int")
    return rows.join(cuts, ["dataset", "y"], "left").withColumn("is_test", held).drop("cut")


def class_weights(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Balanced weights n / (2 n_class): (keys, y, weight)."""
    keys = keys or []
    counts = rows.groupBy(*keys, "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))  # one row per class
    return counts.select(*keys, "y", "n", (total / (2 * F.col("n"))).alias("weight"))


@dataclass
class Preprocess:
    """Fitted on training rows: median per column, and mean and scale after imputing."""

    cols: list[str]
    median: dict[str, float]
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def value(self, c: str) -> str:
        filled = f"coalesce(cast(`{c}` as double), {self.median[c]!r}D)"
        if not self.mean:
            return filled
        return f"(({filled} - ({self.mean[c]!r}D)) / {self.scale[c]!r}D)"

    def stages(self) -> list:
        columns = ", ".join(f"{self.value(c)} as `_x_{c}`" for c in self.cols)
        return [
            SQLTransformer(statement=f"select *, {columns} from __THIS__"),
            VectorAssembler(inputCols=[f"_x_{c}" for c in self.cols], outputCol="features"),
        ]

    def apply(self, df: DataFrame) -> DataFrame:
        """The columns themselves imputed (and scaled)."""
        return df.withColumns({c: F.expr(self.value(c)) for c in self.cols})


def fit_preprocess(train: DataFrame, cols: list[str], scale: bool) -> Preprocess:
    """Exact medians; mean and population deviation. One value per column reaches
    the driver."""
    medians = {r["col"]: r["value"] for r in exact_quantiles(train, [], cols, [0.5]).collect()}
    fitted = Preprocess(cols, {c: float(medians.get(c, 0.0)) for c in cols})
    if scale:
        moments = melt(fitted.apply(train), [], cols).groupBy("col").agg(
            F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")).collect()
        fitted.mean = {r["col"]: r["mean"] for r in moments}
        fitted.scale = {r["col"]: r["std"] or 1.0 for r in moments}
    return fitted


def median_impute(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    return fit_preprocess(train, cols, scale=False).apply(df)


def standardize(df: DataFrame, train: DataFrame, cols: list[str]) -> DataFrame:
    return fit_preprocess(train, cols, scale=True).apply(df)


def classifier(model_type: str, _n_train: int | None = None, **overrides):
    """The estimator of a tree family; the linear ones are fitted by linear_fit.

    Trees are at most 30 deep, and forest weights are per training set.
    """
    common = {"featuresCol": "features", "labelCol": "y", **overrides}
    if model_type == "rf":
        return RandomForestClassifier(**{"numTrees": 200, "maxDepth": 30, "seed": fv.SEED, "weightCol": "weight",
                                         "featureSubsetStrategy": "sqrt", "maxMemoryInMB": 1024,
                                         "cacheNodeIds": True, "checkpointInterval": 10, **common})
    if model_type == "xgb":
        return GBTClassifier(**{"maxIter": 300, "maxDepth": 6, "stepSize": 0.05, "subsamplingRate": 0.8,
                                "featureSubsetStrategy": "0.8", "seed": fv.SEED, **common})
    raise ValueError(f"unknown model type: {model_type!r}")


@dataclass
class Bundle:
    """A fitted pipeline with what is needed to use it correctly."""

    model_type: str
    train: str
    test: str
    feature_cols: list[str]
    model: PipelineModel
    metrics: dict = field(default_factory=dict)


def linear_model(spark, problem: Problem, cols: list[str], stats: ColumnStats) -> PipelineModel:
    """A fitted linear problem as a pipeline that imputes, scales and classifies, like those of the other families."""
    theta = [float(v) for v in problem.theta]
    weights = _py2java(spark.sparkContext, Vectors.dense(theta[:-1]))
    made = spark.sparkContext._jvm.org.apache.spark.ml.classification
    if problem.family == "svm":
        model = LinearSVCModel(made.LinearSVCModel(f"svm-{uuid.uuid4().hex[:12]}", weights, theta[-1]))
    else:
        model = LogisticRegressionModel(made.LogisticRegressionModel(f"{problem.family}-{uuid.uuid4().hex[:12]}", weights, theta[-1]))
    model._resetUid(model._java_obj.uid())
    pre = Preprocess(cols, *({c: float(part[c]) for c in cols} for part in (stats.median, stats.mean, stats.std)))
    return PipelineModel([*pre.stages(), model.setFeaturesCol("features")])


def fit_model(train: DataFrame, cols: list[str], model_type: str, **overrides) -> PipelineModel | None:
    """Fit on rows with y and cols. None if the rows hold fewer than two classes. Linear families take maxIter only."""
    if model_type in fv.LINEAR_MODELS:
        one = TrainingSet("", "all", tuple(cols))
        rows = train.select(F.lit("").alias("dataset"), F.lit(1).alias("is_test"), "y", *cols)
        columns, classes = collect_statistics(rows, list(cols))
        fitted = fit_sets(rows, [one], model_type, columns, classes, **overrides).get(one)
        return linear_model(train.sparkSession, fitted, list(cols), columns["", "all"]) if fitted else None
    classes = {r["y"]: r for r in class_weights(train).collect()}
    if len(classes) < 2 or not cols:
        return None
    pre = fit_preprocess(train, cols, scale=False)
    weight = F.when(F.col("y") == 1, F.lit(classes[1]["weight"])).otherwise(F.lit(classes[0]["weight"]))
    rows = train.select(F.col("y").cast("double").alias("y"), weight.alias("weight"), *cols)
    for stage in pre.stages():
        rows = stage.transform(rows)
    fitted = classifier(model_type, **overrides).fit(rows.select("y", "weight", "features"))
    return PipelineModel([*pre.stages(), fitted])


def _gives_margin(model: PipelineModel) -> bool:
    return isinstance(model.stages[-1], LinearSVCModel)


def score(model: PipelineModel, df: DataFrame, carry: list[str]) -> DataFrame:
    """carry columns plus raw score (margin for the SVM, else probability) and the
    classifier's own prediction."""
    column = "rawPrediction" if _gives_margin(model) else "probability"
    out = model.transform(df)
    return out.select(*carry, vector_to_array(column)[1].alias("score"), F.col("prediction").cast("int").alias("pred"))


def predict_with_bundle(bundle: Bundle, df: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Score any rows. Raises if a column of the bundle is missing; the SVM
    margin is scaled over the scored rows."""
    missing = [c for c in bundle.feature_cols if c not in df.columns]
    if missing:
        raise ValueError(f"{len(missing)} columns of the bundle are missing, e.g. {missing[:5]}")
    carry = carry or [c for c in ("dataset", "user_id", "label", "y") if c in df.columns]
    scored = score(bundle.model, df, carry)
    if _gives_margin(bundle.model):
        scored = score_minmax(scored.withColumn("_batch", F.lit(0)), ["_batch"]).drop("_batch")
    return scored


def feature_importance(bundle: Bundle) -> list[tuple[str, float]]:
    """(feature, coefficient or tree importance), strongest first."""
    last = bundle.model.stages[-1]
    linear = bundle.model_type in fv.LINEAR_MODELS
    vector = last.coefficients if linear else last.featureImportances
    pairs = list(zip(bundle.feature_cols, [float(v) for v in vector.toArray()]))
    return sorted(pairs, key=lambda p: (-abs(p[1]) if linear else -p[1], p[0]))


def collect_importances(spark, bundles: list[Bundle]) -> DataFrame:
    """(model, pair, feature, value) of all bundles; one row per model column."""
    rows = [
        (b.model_type, f"{b.train}__on__{b.test}", name, value)
        for b in bundles for name, value in feature_importance(b)
    ]
    return spark.createDataFrame(rows, "model string, pair string, feature string, value double")
