"""Evaluation tables over scored rows and over the metrics of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.operators.order_stats import FAN_OUT, tree_prefix_sums, value_ranges
from erashift.operators.skew import lookup_join
from erashift.session import cut

PAIR = ["train", "test"]


def score_minmax(scores: DataFrame, keys: list[str], col: str = "score") -> DataFrame:
    """Scale a margin to 0..1 within each scored batch."""
    bounds = cut(scores.groupBy(*keys).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")))
    scaled = (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + fv.SCORE_EPSILON)
    return lookup_join(scores, bounds, keys).withColumn(col, scaled).drop("_lo", "_hi")


def accuracy(scored: DataFrame, keys: list[str] = PAIR, threshold: float | None = fv.DECISION_THRESHOLD) -> DataFrame:
    """Share of right predictions, from `score` and a threshold, or from `pred`."""
    hit = _prediction(threshold) == F.col("y")
    return scored.filter("y is not null").groupBy(*keys).agg(F.avg(hit.cast("int")).alias("accuracy"))


def _prediction(threshold: float | None) -> Column:
    return F.col("pred") if threshold is None else (F.col("score") >= threshold).cast("int")


def _runs(scored: DataFrame, keys: list[str], hot_rows: int | None, fan_out: int) -> DataFrame:
    """Positives and negatives per key and distinct score, with the path of the score's range."""
    valid = scored.filter("y is not null and score is not null").withColumn("score", F.col("score").cast("double"))
    return value_ranges(valid, "score", hot_rows, fan_out).groupBy(*keys, "path", "score").agg(
        F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def _with_starts(rows: DataFrame, totals: DataFrame, keys: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """rows with what lies before their range, as start_<value>."""
    starts = tree_prefix_sums(totals, keys, values, descending).select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("path").alias("_path"), *[F.col(v).alias(f"start_{v}") for v in values])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "path"]]
    return rows.join(starts, same).drop(*[f"_{k}" for k in [*keys, "path"]])


def auc_exact(scored: DataFrame, keys: list[str] = PAIR, hot_rows: int | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """ROC AUC with ties counted half; NULL if a class is missing.

    AUC = sum over scores of pos * (negatives below + neg / 2) / (P * N).
    Negatives below come from the same range of scores (a window over one
    range) and from the tree of earlier ranges.
    """
    inside = Window.partitionBy(*keys, "path").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0))
    per_range = cut(
        _runs(scored, keys, hot_rows, fan_out).withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
        .groupBy(*keys, "path").agg(F.sum("won").alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )
    return (
        _with_starts(per_range, per_range, keys, ["neg"])
        .groupBy(*keys).agg(
            F.sum(F.col("won") + F.col("pos") * F.col("start_neg")).alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
        .select(*keys, "n_pos", "n_neg",
                F.try_divide("won", F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"))
    )


def roc_curve(scored: DataFrame, keys: list[str] = PAIR, hot_rows: int | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """fpr and tpr at every distinct score, from the highest down, plus the
    origin as a row with a NULL threshold."""
    runs = cut(_runs(scored, keys, hot_rows, fan_out))
    per_range = runs.groupBy(*keys, "path").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sums = runs.groupBy(*keys).agg(F.sum("pos").alias("p_all"), F.sum("neg").alias("n_all"))
    inside = Window.partitionBy(*keys, "path").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    counted = runs.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)})
    points = (
        _with_starts(counted, per_range, keys, ["pos", "neg"], descending=True)
        .join(sums, keys)
        .select(
            *keys, F.col("score").alias("threshold"),
            F.try_divide(F.col("fp") + F.col("start_neg"), F.col("n_all")).alias("fpr"),
            F.try_divide(F.col("tp") + F.col("start_pos"), F.col("p_all")).alias("tpr"),
        )
    )
    origin = sums.select(*keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def confusion_matrix(scored: DataFrame, keys: list[str] = PAIR, threshold: float | None = fv.DECISION_THRESHOLD) -> DataFrame:
    """The full 2 x 2 grid: (keys, truth, predicted, n, row_share)."""
    p, y = _prediction(threshold), F.col("y")
    cell = {(t, q): f"c{t}{q}" for t in (0, 1) for q in (0, 1)}
    counted = scored.filter("y is not null").groupBy(*keys).agg(
        *[F.count_if((y == t) & (p == q)).alias(name) for (t, q), name in cell.items()])
    grid = F.array(*[
        F.struct(
            F.lit(t).alias("truth"), F.lit(q).alias("predicted"), F.col(name).alias("n"),
            F.try_divide(F.col(name), F.col(cell[t, 0]) + F.col(cell[t, 1])).alias("row_share"),
        ) for (t, q), name in cell.items()
    ])
    return counted.select(*keys, F.explode(grid).alias("g")).select(*keys, "g.*")


def metric_matrix(results: DataFrame, eras: list[str], metric: str = "auc") -> DataFrame:
    """Rows train, one column per test era."""
    return results.groupBy("train").pivot("test", eras).agg(F.first(metric))


def _diagonal(metric: str) -> Column:
    return F.when(F.col("train") == F.col("test"), F.col(metric))


def _off_diagonal(metric: str) -> Column:
    return F.when(F.col("train") != F.col("test"), F.col(metric))


def mean_cross_era(results: DataFrame, metric: str = "auc") -> DataFrame:
    return results.agg(F.avg(_off_diagonal(metric)).alias("mean_cross_auc"))


def diagonal_vs_cross(results: DataFrame, metric: str = "auc") -> DataFrame:
    return results.groupBy(F.col("train").alias("train_dataset")).agg(
        F.max(_diagonal(metric)).alias("diagonal_auc"), F.avg(_off_diagonal(metric)).alias("mean_cross_auc"))


def degradation(results: DataFrame, metric: str = "auc") -> DataFrame:
    """Diagonal minus cell, per row (a row has one cell per era)."""
    best = F.max(_diagonal(metric)).over(Window.partitionBy("train"))
    return results.select("train", "test", (best - F.col(metric)).alias("degradation"))


def best_model_per_pair(results: DataFrame, metric: str = "auc") -> DataFrame:
    """Best model per pair; of equal ones the first by name."""
    first = F.struct(-F.col(metric), F.col("model"))
    return results.filter(F.col(metric).isNotNull()).groupBy("train", "test").agg(
        F.min_by("model", first).alias("model"), F.max(metric).alias(metric))


def mean_auc_by_model(results: DataFrame) -> DataFrame:
    """Mean off-diagonal AUC per model, best first."""
    return (
        results.groupBy("model").agg(F.avg(_off_diagonal("auc")).alias("mean_cross_auc"))
        .orderBy(F.desc("mean_cross_auc"), "model")
    )


def auc_by_pair(results: DataFrame, models: list[str]) -> DataFrame:
    """One row per pair, one column per model."""
    return results.groupBy("train", "test").pivot("model", models).agg(F.first("auc"))
