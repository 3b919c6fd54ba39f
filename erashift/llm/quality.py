"""Quality by Bradley-Terry pairwise ranking.

A text's strength is linear in a few surface features. Strengths are learnt from
all preference pairs (each text labelled good over each one labelled bad) by
logistic loss on the difference of their features, then cut at the quantile of the
training strengths that leaves the labelled share of good texts above it. Every
labelled text takes part in both; the passes over them run on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import stored
from erashift.llm.labelled import all_training_features, remainder, remainder_of, score_rows

FOLDS, HELD_OUT_FOLD, THRESHOLD = 4, 2, 0.7
DECAY, MAX_PASSES, ENOUGH = 1e-3, 40, 1e-9  # weight penalty; of the Newton iteration: passes, predicted gain it stops at
WIDTH, MOST_BINS = 1 / 16, 4096   # of a bin of strengths; bins on each side of 0
SLICES, FEW = 1024, 10_000        # the cut: parts an interval is counted in, rows it may have to be sorted
N_FEATURES = 12
_KIND = np.zeros(256, np.int64)  # 0 other, 1 upper case, 2 lower case, 3 digit, 4 space, 5 mark, 6 end of sentence, 7 beyond ASCII
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"abcdefghijklmnopqrstuvwxyz", 2), (b"0123456789", 3),
                   (b" \t\n\x0b\x0c\r", 4), (b"#$%&*+/<=>@[\\]^_`{|}~", 5), (b".,;:?", 6)):
    _KIND[list(_chars)] = _k
_KIND[128:] = 7


def features(text: str) -> np.ndarray:
    """Surface features of a whole text, each between 0 and about 1; all 0 without words."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.zeros(12)
    n = len(raw)
    kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=8) / n
    w = len(words)
    distinct = len(set(words))
    same = sum(a == b for a, b in zip(words, words[1:]))
    return np.array([
        math.sqrt(kinds[1]), kinds[2] + kinds[7], math.sqrt(kinds[3]), math.sqrt(kinds[5]), math.sqrt(kinds[6]),
        math.sqrt(raw.count(b"!") / n), same / w, (w - distinct) / w, min(1.0, n / w / 20),
        min(1.0, math.log1p(w) / 12), math.sqrt(raw.count(b"|") / n), 1.0 if w < 20 else 0.0,
    ])


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float       # the strength that gets a score of THRESHOLD
    share: float | None = None  # the only answer of a model without pairs

    def standard(self, x: np.ndarray) -> np.ndarray:
        return (np.hstack([x, x * x]) - self.mean) / self.scale

    def strength(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.weight

    def scorer(self):
        shift = math.log(THRESHOLD / (1 - THRESHOLD))

        def score(text: str) -> float:
            if self.share is not None:
                return self.share
            z = float(self.strength(features(text)[None, :])[0]) - self.cut + shift
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def cut_at(strengths: np.ndarray, share_of: np.ndarray, below: float) -> float:
    """The strength that leaves `below` of the texts under it: midway between the text at that quantile, which belongs
    below the cut, and the next stronger one, so that equal strengths always fall on one side."""
    order = np.argsort(strengths, kind="stable")
    ranked = strengths[order]
    at = min(int(np.searchsorted(np.cumsum(share_of[order]), below - 1e-9)), len(ranked) - 1)
    stronger = ranked[ranked > ranked[at] + _tie(ranked[at])]
    return between(ranked[at], stronger[0] if len(stronger) else None)


def _tie(strength: float) -> float:
    return 1e-9 * (1 + abs(strength))


def between(at: float, stronger: float | None) -> float:
    return float(at) + 1e-6 if stronger is None else float(at + stronger) / 2


def moments(x: np.ndarray) -> np.ndarray:
    """Of texts given by their features: how many, the sums and the sums of products of all 24 numbers."""
    full = np.hstack([x, x * x])
    return np.concatenate([[len(full)], full.sum(0), (full.T @ full).ravel()])


def binned(model: QualityModel, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bins of strengths the texts are in, and of each: texts, sum of strengths, sums of standardised numbers."""
    z = model.standard(x)
    s = z @ model.weight
    bins, at = np.unique(np.clip(np.floor(s / WIDTH), -MOST_BINS, MOST_BINS).astype(np.int64), return_inverse=True)
    sums = np.zeros((len(bins), 2 + z.shape[1]))
    np.add.at(sums, at, np.column_stack([np.ones(len(s)), s, z]))
    return bins, sums


def fit_strengths(first: list[np.ndarray], sums_of: Callable[[QualityModel], list[np.ndarray]]) -> QualityModel:
    """Weights that minimise the loss over all pairs of a good and a bad text.

    first: moments() of the texts of label 0 and 1. sums_of(model): the sums of binned() for either label, from one pass
    over all texts. How often a text loses depends on its strength alone, so a bin's texts meet the other label's bins
    at the mean strength of each; with bins this narrow that is the sum over all pairs but for terms in WIDTH squared.
    Newton steps, halved while the loss rises.
    """
    k = 2 * N_FEATURES
    total = first[0] + first[1]
    mean = total[1:k + 1] / total[0]
    scale = np.sqrt(np.maximum(np.diag(total[k + 1:].reshape(k, k)) / total[0] - mean**2, 0)) + 1e-3
    model = QualityModel(mean, scale, np.zeros(k), 0.0)
    around = []  # second moments of either label's standardised numbers
    for m in first:
        own = m[1:k + 1] / m[0]
        d = (own - mean) / scale
        around.append((m[k + 1:].reshape(k, k) / m[0] - np.outer(own, own)) / np.outer(scale, scale) + np.outer(d, d))
    step, gain, before = np.zeros(k), 0.0, math.inf
    start = model.weight
    for _ in range(MAX_PASSES):
        share, strength, centre, spread = [], [], [], np.zeros((k, k))
        for sums, second in zip(sums_of(model), around):
            n = sums[:, 0]
            share.append(n / n.sum())
            strength.append(sums[:, 1] / n)
            centre.append(sums[:, 2:] / n[:, None])
            spread += second - (centre[-1].T * share[-1]) @ centre[-1]  # inside the bins
        ahead = strength[1][:, None] - strength[0][None, :]
        pairs = share[1][:, None] * share[0][None, :]
        loss = float((pairs * np.logaddexp(0, -ahead)).sum()) + DECAY / 2 * float(model.weight @ model.weight)
        if loss > before + 1e-12 and np.abs(step).max() > 1e-9:
            step = step / 2
            model = replace(model, weight=start + step)
            continue
        wrong = np.exp(-np.logaddexp(0, ahead))  # how wrong each pair still is
        lost = pairs * wrong
        grad = centre[1].T @ lost.sum(1) - centre[0].T @ lost.sum(0) - DECAY * model.weight
        bend = lost * (1 - wrong)
        cross = centre[1].T @ bend @ centre[0]
        curve = ((centre[1].T * bend.sum(1)) @ centre[1] + (centre[0].T * bend.sum(0)) @ centre[0] - cross - cross.T
                 + bend.sum() * spread + DECAY * np.eye(k))
        step = np.linalg.solve(curve, grad)
        gain, before, start = float(grad @ step), loss, model.weight
        if gain < ENOUGH:
            break
        model = replace(model, weight=start + step)
    return replace(model, weight=start)


def fit(texts: list[str], y: list[int], good_share: float | None = None) -> QualityModel:
    """fit_features() on the features of texts."""
    return fit_features(np.array([features(t) for t in texts]).reshape(len(texts), N_FEATURES), np.array(y, np.int64), good_share)


def fit_features(x: np.ndarray, label: np.ndarray, good_share: float | None = None) -> QualityModel:
    """Fit strengths from all pairs of a few labelled texts at hand, given by their features.

    good_share: the share of texts that should pass (that of the given labels if None). Without both labels the model
    answers the share of label 1 (0 if there is no label).
    """
    share = float(label.mean()) if len(label) else 0.0
    if share in (0.0, 1.0):
        return constant(share)
    of = [x[label == y] for y in (0, 1)]
    model = fit_strengths([moments(part) for part in of], lambda m: [binned(m, part)[1] for part in of])
    # the quantile of the population: each class weighs what it does among all labels
    passing = share if good_share is None else good_share
    each = np.where(label == 1, passing / len(of[1]), (1 - passing) / len(of[0]))
    return replace(model, cut=cut_at(model.strength(x), each, 1 - passing))


def constant(share: float) -> QualityModel:
    k = 2 * N_FEATURES
    return QualityModel(np.zeros(k), np.ones(k), np.zeros(k), 0.0, share)


def _by_label(batches):
    """(label, features) of each label in each batch."""
    for b in batches:
        y, x = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)
        for k in (0, 1):
            if (y == k).any():
                yield k, x[y == k]


def _moments_of(rows: DataFrame) -> dict[int, np.ndarray]:
    def run(batches):
        sums = {}
        for y, x in _by_label(batches):
            sums[y] = sums.get(y, 0) + moments(x)
        for y, m in sums.items():
            yield pa.RecordBatch.from_pydict({"y": np.full(len(m), y, np.int32), "at": np.arange(len(m), dtype=np.int32), "value": m})

    got = rows.mapInArrow(run, "y int, at int, value double").groupBy("y", "at").agg(F.sum("value").alias("value")).orderBy("y", "at").toArrow()
    y, value = got["y"].to_numpy(), got["value"].to_numpy()
    return {k: value[y == k] for k in (0, 1) if (y == k).any()}


def _binned_rows(rows: DataFrame, model: QualityModel) -> list[np.ndarray]:
    names = [f"v{k}" for k in range(2 + 2 * N_FEATURES)]

    def run(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for y, x in _by_label(batches):
            for bin_, row in zip(*binned(model, x)):
                sums[y, int(bin_)] = sums.get((y, int(bin_)), 0) + row
        if sums:
            keys, values = np.array(list(sums)), np.array(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0].astype(np.int32)), pa.array(keys[:, 1]), *map(pa.array, values.T.copy())],
                                             names=["y", "bin", *names])

    made = rows.mapInArrow(run, "y int, bin long, " + ", ".join(f"{n} double" for n in names))
    got = made.groupBy("y", "bin").agg(*[F.sum(n).alias(n) for n in names]).orderBy("y", "bin").toArrow()
    y, values = got["y"].to_numpy(), np.column_stack([got[n].to_numpy() for n in names])
    return [values[y == k] for k in (0, 1)]


def _cut_of(rows: DataFrame, model: QualityModel, each: list[float], below: float) -> float:
    """cut_at() of all rows, whose label y weighs each[y]: the interval the quantile is in is counted in slices again and
    again until few enough rows are left to be sorted."""
    def run(batches):
        for y, x in _by_label(batches):
            yield pa.RecordBatch.from_pydict({"y": np.full(len(x), y, np.int32), "s": model.strength(x)})

    strengths = stored(rows.mapInArrow(run, "y int, s double"), "quality-strengths")
    weight = F.when(F.col("y") == 1, F.lit(each[1])).otherwise(F.lit(each[0]))
    lo, hi, n = strengths.agg(F.min("s"), F.max("s"), F.count("*")).first()
    passed, inside = 0.0, strengths
    while n > FEW and lo < hi:
        part = F.least(F.floor((F.col("s") - lo) / (hi - lo) * SLICES), F.lit(SLICES - 1))
        counted = inside.groupBy(part.alias("part")).agg(
            F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.min("s").alias("lo"), F.max("s").alias("hi"))
        for r in (counted := counted.orderBy("part").collect()):  # at most SLICES rows
            more = r["n0"] * each[0] + r["n1"] * each[1]
            if passed + more >= below - 1e-9 or r is counted[-1]:
                lo, hi, n = r["lo"], r["hi"], r["n0"] + r["n1"]
                break
            passed += more
        inside = strengths.where(F.col("s").between(lo, hi))
    at = lo
    if lo < hi:
        ranked = inside.select("s", weight.alias("w")).orderBy("s").toArrow()  # at most FEW rows
        s, upto = ranked["s"].to_numpy(), passed + np.cumsum(ranked["w"].to_numpy())
        at = float(s[min(int(np.searchsorted(upto, below - 1e-9)), len(s) - 1)])
    return between(at, strengths.where(F.col("s") > at + _tie(at)).agg(F.min("s")).first()[0])


def train_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from all labelled rows outside the held-out fold.

    The executors keep 12 numbers a row; the driver gets sums per bin of strengths, and at most FEW strengths.
    """
    usable = remainder(labels["doc_id"].cast("long"), FOLDS) != HELD_OUT_FOLD
    share = labels.where(usable).agg({"quality": "avg"}).collect()[0][0]
    made = all_training_features(docs, labels, "quality", lambda i: remainder(i, FOLDS) != HELD_OUT_FOLD,
                                 lambda text: (features(text).tolist(),), "x array<double>")
    rows = stored(made.select("y", "x"), "quality-features")
    first = _moments_of(rows)
    if len(first) < 2:
        return constant(float(max(first, default=0)))
    model = fit_strengths([first[0], first[1]], lambda m: _binned_rows(rows, m))
    return replace(model, cut=_cut_of(rows, model, [(1 - share) / first[0][0], share / first[1][0]], 1 - share))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row and its whole text.

    NULL and empty texts have all features 0. Only the text is scored; repeated
    rows get equal scores. The model is 24 numbers a vector.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_rows(docs, lambda: shared.value.scorer(), lambda i: remainder_of(i, FOLDS) == HELD_OUT_FOLD, THRESHOLD)
