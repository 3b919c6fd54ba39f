"""Result sinks: frames, edge cache, contracts, metrics and model bundles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from erashift.operators.models import Bundle


def save_frame(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet (keeps types and NULLs), or CSV if the path ends in .csv."""
    if path.endswith(".csv"):
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        parts = ["dataset"] if "dataset" in df.columns else []
        df.write.mode(mode).partitionBy(*parts).parquet(path)
    return path


def load_frame(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return spark.read.option("header", True).option("escape", '"').csv(path)
    return spark.read.parquet(path)


def cached_edges(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Edges from path; built and written first if there are none yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        build().write.mode("errorifexists").partitionBy("dataset").parquet(path)
        return spark.read.parquet(path)


def save_contract(contract: DataFrame, path: str) -> None:
    """The tall contract as JSON lines."""
    contract.write.mode("overwrite").json(path)


def load_contract(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(
        "train string, test string, scope string, col string, kept boolean, reason string").json(path)


def save_results(results: DataFrame, path: str) -> None:
    """One row per (model, train, test); matrices are pivots of it."""
    results.write.mode("overwrite").partitionBy("model").parquet(path)


def bundle_path(folder: str, model_type: str, train: str, test: str) -> str:
    return f"{folder}/{model_type}__train_{train}__test_{test}"


def save_bundles(spark: SparkSession, bundles: list[Bundle], folder: str) -> None:
    """Each bundle as a saved pipeline next to a one-row table describing it."""
    for b in bundles:
        path = bundle_path(folder, b.model_type, b.train, b.test)
        b.model.write().overwrite().save(f"{path}/pipeline")
        about = spark.createDataFrame(
            [(b.model_type, b.train, b.test, b.feature_cols, {k: float(v) for k, v in b.metrics.items()})],
            "model_type string, train string, test string, feature_cols array<string>, metrics map<string,double>")
        about.write.mode("overwrite").parquet(f"{path}/about")


def load_bundle(spark: SparkSession, folder: str, model_type: str, train: str, test: str) -> Bundle | None:
    path = bundle_path(folder, model_type, train, test)
    try:
        about = spark.read.parquet(f"{path}/about").first()
    except AnalysisException:
        return None
    model = PipelineModel.load(f"{path}/pipeline")
    return Bundle(about["model_type"], about["train"], about["test"], list(about["feature_cols"]), model,
                  dict(about["metrics"] or {}))


def load_bundles(spark: SparkSession, folder: str, model_type: str, eras: list[str]) -> list[Bundle]:
    """Every bundle of the family that exists."""
    found = [load_bundle(spark, folder, model_type, tr, te) for tr in eras for te in eras]
    return [b for b in found if b is not None]

