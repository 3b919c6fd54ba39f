"""Linear classifiers for many training sets at once: every pass over the data serves all of them.

A training set is an era, the part of it to learn from ("all" rows, or "train" for those that are not held out) and
its columns. Statistics come from one grouped aggregation per (era, part, column). Fits are Newton steps: a pass adds
up loss, gradient and curvature of every set that has not converged, the driver solves the small systems, and the next
pass judges the steps. The number of passes is that of the slowest set, whatever the number of sets.

Objectives, s being balanced class weights, t = +1/-1 and z = w x + b:
  logreg, ridge   |w|^2 / 2 + sum s log(1 + exp(-t z)), b not penalised
  lasso           |w|_1 + |b| + 0.5 sum s log(1 + exp(-t z))
  svm             (|w|^2 + b^2) / 2 + sum s max(0, 1 - t z)^2
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erashift.operators.order_stats import exact_quantiles, melt
from erashift.session import cut

PARTS = ("all", "train")
COST = {"logreg": 1.0, "ridge": 1.0, "lasso": 0.5, "svm": 1.0}
PASSES = 200
TOLERANCE = 1e-13  # of the objective, in the decrease a step still promises


@dataclass(frozen=True)
class TrainingSet:
    era: str
    part: str
    cols: tuple[str, ...]


@dataclass
class ColumnStats:
    """One (era, part): medians, and means and deviations after imputing, per column."""

    median: dict[str, float]
    mean: dict[str, float]
    std: dict[str, float]


def in_parts(split: DataFrame, cols: list[str]) -> DataFrame:
    """(dataset, part, y, cols): every row in "all", those not held out also in "train"."""
    parts = F.when(F.col("is_test") == 0, F.array(*map(F.lit, PARTS))).otherwise(F.array(F.lit(PARTS[0])))
    return split.select("dataset", F.explode(parts).alias("part"), "y", *cols)


def column_statistics(split: DataFrame, cols: list[str]) -> DataFrame:
    """(dataset, part, col, n, known, median, mean, std): exact median; mean and population deviation of the column
    with the median in place of NULLs. A column without a value has NULLs.

    Imputing k copies of the median shifts mean and squares by a closed form, so the data is read three times (two for
    the median), not once per column or pair.
    """
    rows = in_parts(split, cols)
    keys = ["dataset", "part"]
    medians = exact_quantiles(rows, keys, cols, [0.5]).select(*keys, "col", F.col("value").alias("median"))
    known = melt(rows, keys, cols).groupBy(*keys, "col").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("known"), F.avg("value").alias("_mean"), F.var_pop("value").alias("_var"))
    k = F.col("n") - F.col("known")
    mean = (F.col("_mean") * F.col("known") + F.col("median") * k) / F.col("n")
    apart = F.col("_mean") - F.col("median")
    var = (F.col("_var") * F.col("known") + apart * apart * F.col("known") * k / F.col("n")) / F.col("n")
    return known.join(medians, [*keys, "col"], "left").select(
        *keys, "col", "n", "known", "median", mean.alias("mean"), F.sqrt(var).alias("std"))


def class_statistics(split: DataFrame) -> DataFrame:
    """(dataset, part, y, n, weight): balanced weights n / (2 n_class)."""
    counts = in_parts(split, []).groupBy("dataset", "part", "y").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("dataset", "part"))  # two rows per group
    return counts.withColumn("weight", total / (2 * F.col("n")))


class Problem:
    """One set's fit: objective, current weights (the intercept last) and the step being judged."""

    def __init__(self, family: str, size: int, weight: dict[int, float]):
        self.family, self.weight, self.cost = family, weight, COST[family]
        self.theta = self.trial = np.zeros(size + 1)
        self.value = self.promised = None
        self.step, self.done = 1.0, False

    def penalty(self, theta: np.ndarray) -> float:
        if self.family == "lasso":
            return float(np.abs(theta).sum())
        w = theta if self.family == "svm" else theta[:-1]
        return float(w @ w) / 2

    def judge(self, loss: float, grad: np.ndarray, curve: np.ndarray) -> None:
        """Take the trial or shorten the step; then set out the next trial."""
        value = self.cost * loss + self.penalty(self.trial)
        if self.value is not None and value > self.value + 1e-4 * self.step * self.promised and self.step > 1e-8:
            self.step /= 2
            self.trial = self.theta + self.step * self.direction
            return
        if self.value is not None and value > self.value:  # rounding is all that is left
            self.trial, self.done = self.theta, True
            return
        self.theta, self.value, self.step = self.trial, value, 1.0
        self.grad, curve = self.cost * grad, self.cost * curve
        if self.family == "lasso":
            self.direction = sparse_step(self.theta, self.grad, curve)
            self.promised = float(self.grad @ self.direction) + self.penalty(self.theta + self.direction) - self.penalty(self.theta)
        else:
            ridge = np.ones(len(self.theta))
            ridge[-1] = 1.0 if self.family == "svm" else 1e-10
            slope = self.grad + np.where(ridge == 1.0, self.theta, 0.0)
            self.direction = -np.linalg.solve(curve + np.diag(ridge), slope)
            self.promised = float(slope @ self.direction)
        self.done = -self.promised <= TOLERANCE * max(1.0, abs(self.value))
        self.trial = self.theta + self.direction

    def violation(self) -> float:
        """How far the gradient at theta is from the optimality condition, in units of the cost."""
        if self.family == "lasso":
            at_zero = np.maximum(np.abs(self.grad) - 1, 0)
            return float(np.where(self.theta == 0, at_zero, np.abs(self.grad + np.sign(self.theta))).max())
        slope = self.grad + self.theta
        if self.family != "svm":
            slope[-1] = self.grad[-1]
        return float(np.abs(slope).max())


def sparse_step(theta: np.ndarray, grad: np.ndarray, curve: np.ndarray) -> np.ndarray:
    """The step that minimises grad d + d curve d / 2 + |theta + d|_1, by coordinates."""
    step, product = np.zeros_like(theta), np.zeros_like(theta)
    for _ in range(1000):
        most = 0.0
        for j in range(len(theta)):
            h = curve[j, j]
            if h <= 0:
                continue
            at = theta[j] + step[j]
            goal = at - (grad[j] + product[j]) / h
            new = np.sign(goal) * max(abs(goal) - 1 / h, 0.0)
            if new != at:
                step[j] += new - at
                product += curve[:, j] * (new - at)
                most = max(most, abs(new - at) * np.sqrt(h))
        if most < 1e-12:
            break
    return step


def losses(family: str, theta: np.ndarray, x: np.ndarray, t: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature over the rows of x (whose last column is 1), in one flat array."""
    m = t * (x @ theta)
    if family == "svm":
        u = np.maximum(0.0, 1 - m)
        loss, pull, bend = s * u * u, -2 * s * u * t, 2 * s * (u > 0)
    else:
        p = 0.5 * (1 - np.tanh(m / 2))
        loss, pull, bend = s * np.logaddexp(0, -m), -s * p * t, s * p * (1 - p)
    return np.concatenate([[loss.sum()], x.T @ pull, ((x * bend[:, None]).T @ x).ravel()])


def design(table: np.ndarray, stats: ColumnStats, cols: tuple[str, ...], at: dict[str, int]) -> np.ndarray:
    """Imputed and scaled columns, and a column of ones."""
    x = table[:, [at[c] for c in cols]]
    median = np.array([stats.median[c] for c in cols])
    scaled = (np.where(np.isnan(x), median, x) - [stats.mean[c] for c in cols]) / [stats.std[c] for c in cols]
    return np.hstack([scaled, np.ones((len(x), 1))])


def _numbers(batch: pa.RecordBatch, cols: list[str]) -> np.ndarray:
    out = np.empty((batch.num_rows, len(cols)))
    for k, c in enumerate(cols):
        out[:, k] = batch.column(c).to_numpy(zero_copy_only=False)
    return out


def _typed(split: DataFrame, cols: list[str], *more: str) -> DataFrame:
    return split.select("dataset", F.col("is_test").cast("int").alias("is_test"), F.col("y").cast("int").alias("y"), *more,
                        *[F.col(c).cast("double").alias(c) for c in cols])


def collect_statistics(split: DataFrame, cols: list[str]) -> tuple[dict, dict]:
    """ColumnStats and {y: (n, weight)} per (era, part): a few numbers per era and column reach the driver."""
    columns: dict[tuple[str, str], ColumnStats] = {}
    if cols:
        for r in column_statistics(split, cols).collect():
            s = columns.setdefault((r["dataset"], r["part"]), ColumnStats({}, {}, {}))
            s.median[r["col"]], s.mean[r["col"]] = r["median"] or 0.0, r["mean"] or 0.0
            s.std[r["col"]] = r["std"] or 1.0
    classes: dict[tuple[str, str], dict[int, tuple[int, float]]] = {}
    for r in class_statistics(split).collect():
        classes.setdefault((r["dataset"], r["part"]), {})[r["y"]] = (r["n"], r["weight"])
    return columns, classes


def fit_sets(split: DataFrame, sets: list[TrainingSet], family: str, columns: dict, classes: dict, maxIter: int = PASSES) -> dict[TrainingSet, Problem]:
    """The fitted problem of each set with two classes and a column. split has dataset, is_test, y and all columns."""
    problems = {s: Problem(family, len(s.cols), {y: w for y, (_, w) in classes[s.era, s.part].items()})
                for s in sets if s.cols and len(classes.get((s.era, s.part), {})) == 2}
    used = sorted({c for s in problems for c in s.cols})
    rows = cut(_typed(split, used)) if problems else None
    at = {c: k for k, c in enumerate(used)}
    for _ in range(maxIter):
        waiting = [(k, s) for k, s in enumerate(problems) if not problems[s].done]
        if not waiting:
            break
        todo = [(k, s, problems[s].trial, problems[s].weight, columns[s.era, s.part]) for k, s in waiting]

        def add_up(batches, todo=todo):
            total: dict[int, np.ndarray] = {}
            for b in batches:
                table, y = _numbers(b, used), b.column("y").to_numpy(zero_copy_only=False)
                era, held = np.array(b.column("dataset").to_pylist(), object), b.column("is_test").to_numpy(zero_copy_only=False)
                for k, s, theta, weight, stats in todo:
                    mine = np.flatnonzero((era == s.era) & ((s.part == "all") | (held == 0)))
                    if len(mine):
                        label = y[mine]
                        part = losses(family, theta, design(table[mine], stats, s.cols, at), 2.0 * label - 1, np.where(label == 1, weight[1], weight[0]))
                        total[k] = total[k] + part if k in total else part
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))],
                                                 names=["k", "v"])

        parts = rows.mapInArrow(add_up, "k int, v array<double>").select("k", F.posexplode("v").alias("at", "v"))
        sums = parts.groupBy("k", "at").agg(F.sum("v").alias("v")).toArrow()  # one small matrix per set
        found = {k: np.empty((len(s.cols) + 1) * (len(s.cols) + 2) + 1) for k, s in waiting}
        key, place, value = (sums[c].to_numpy() for c in ("k", "at", "v"))
        for k in found:
            found[k][place[key == k]] = value[key == k]
        for k, s in waiting:
            d, v = len(s.cols) + 1, found[k]
            problems[s].judge(float(v[0]), v[1:d + 1], v[d + 1:].reshape(d, d))
    return problems


def score_sets(split: DataFrame, pairs: list[tuple[str, str, TrainingSet, Problem]], columns: dict) -> DataFrame:
    """(train, test, user_id, y, score, pred) of all pairs in one pass: every row meets the models that are tested on it.

    A pair's test rows are the held-out rows of the era for a model of its own "train" part, else the whole era. The
    score is the probability, for svm the margin.
    """
    used = sorted({c for _, _, s, _ in pairs for c in s.cols})
    at = {c: k for k, c in enumerate(used)}
    models = [(tr, te, s, p.theta, p.family, columns[s.era, s.part]) for tr, te, s, p in pairs]
    names = ["train", "test", "user_id", "y", "score", "pred"]

    def run(batches):
        for b in batches:
            table = _numbers(b, used)
            era, held = np.array(b.column("dataset").to_pylist(), object), b.column("is_test").to_numpy(zero_copy_only=False)
            for tr, te, s, theta, family, stats in models:
                mine = np.flatnonzero((era == te) & ((tr != te) | (held == 1)))
                if not len(mine):
                    continue
                z = design(table[mine], stats, s.cols, at) @ theta
                score = z if family == "svm" else 0.5 * (1 + np.tanh(z / 2))
                pick = pa.array(mine)
                yield pa.RecordBatch.from_arrays([pa.array([tr] * len(mine)), pa.array([te] * len(mine)), b.column("user_id").take(pick), b.column("y").take(pick),
                                                  pa.array(score), pa.array((z > 0).astype(np.int32))], names=names)

    rows = _typed(split, used, "user_id")
    kind = rows.schema["user_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"train string, test string, user_id {kind}, y int, score double, pred int")
