"""Tables over stored importances (model, pair, feature, value).

A pair has one row per feature column of a frame, so its window is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erashift import fixed_values as fv


def _strength(model_type: str) -> Column:
    """Linear models rank by absolute coefficient, tree models by value."""
    return F.abs("value") if model_type in fv.LINEAR_MODELS else F.col("value")


def importance_ranking(importances: DataFrame, model_type: str) -> DataFrame:
    order = Window.partitionBy("pair").orderBy(F.desc(_strength(model_type)), "feature")
    return importances.withColumn("rank", F.row_number().over(order))


def importance_topk(importances: DataFrame, model_type: str, k: int) -> DataFrame:
    return importance_ranking(importances, model_type).filter(F.col("rank") <= k)


def stable_top_features(importances: DataFrame, model_type: str, k: int = 10) -> DataFrame:
    """In how many pairs a feature is among the top k."""
    return (
        importance_topk(importances, model_type, k).groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_pairs")).orderBy(F.desc("n_pairs"), "feature")
    )


def importance_matrix(
    importances: DataFrame, pairs: list[str], model_type: str = "logreg", top_k: int | None = None,
) -> DataFrame:
    """Feature x pair, 0 where a pair does not use (or rank) the feature."""
    if top_k is not None:
        importances = importance_topk(importances, model_type, top_k)
    return importances.groupBy("feature").pivot("pair", pairs).agg(F.first("value")).fillna(0.0)
