"""Train and evaluate every (train, test) pair of eras."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.operators.evaluation import PAIR, accuracy, auc_exact, confusion_matrix, roc_curve
from erashift.operators.linear_fit import TrainingSet, collect_statistics, fit_sets, score_sets
from erashift.operators.models import Bundle, fit_model, labelled, linear_model, score, stratified_split
from erashift.session import cut

RESULT_COLS = ["model", "train", "test", "accuracy", "auc", "n_features", "n_train", "n_test", "scope"]


def kept_columns(contract: DataFrame) -> dict[tuple[str, str], list[str]]:
    """Pair -> columns it may use. A contract has one row per pair and column name."""
    out: dict[tuple[str, str], list[str]] = {}
    for r in contract.select("train", "test", "col", "kept").collect():
        cols = out.setdefault((r["train"], r["test"]), [])
        if r["kept"]:
            cols.append(r["col"])
    return {pair: sorted(cols) for pair, cols in out.items()}


@dataclass
class PairData:
    train_rows: DataFrame
    test_rows: DataFrame
    cols: list[str]


def pair_data(split: DataFrame, kept: dict[tuple[str, str], list[str]], train: str, test: str) -> PairData:
    """Rows and columns of one pair.

    `split` is a labelled frame with is_test. The diagonal trains and tests
    on the two sides of the split, every other pair on two whole eras.
    """
    if (train, test) not in kept:
        raise KeyError(f"no contract entry for {train} on {test}")
    cols = kept[train, test]
    missing = [c for c in cols if c not in split.columns]
    if missing:
        raise ValueError(f"contract and frame differ: {len(missing)} columns missing, e.g. {missing[:5]}")
    rows = split.select("dataset", "user_id", "y", "is_test", *cols)
    if train == test:
        era = rows.filter(F.col("dataset") == train)
        return PairData(era.filter("is_test = 0"), era.filter("is_test = 1"), cols)
    return PairData(rows.filter(F.col("dataset") == train), rows.filter(F.col("dataset") == test), cols)


def pair_counts(split: DataFrame, eras: list[str]) -> DataFrame:
    """Rows per pair and class: (train, test, y, n_train, n_test)."""
    per_class = split.groupBy("dataset", "y").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_test") == 1).alias("held"))
    other = F.explode(F.array(*[F.lit(e) for e in eras])).alias("other")
    diagonal = F.col("dataset") == F.col("other")
    as_train = per_class.select("*", other).select(
        F.col("dataset").alias("train"), F.col("other").alias("test"), "y",
        F.when(diagonal, F.col("n") - F.col("held")).otherwise(F.col("n")).alias("n_train"),
        F.lit(0).cast("bigint").alias("n_test"))
    as_test = per_class.select("*", other).select(
        F.col("other").alias("train"), F.col("dataset").alias("test"), "y",
        F.lit(0).cast("bigint").alias("n_train"),
        F.when(diagonal, F.col("held")).otherwise(F.col("n")).alias("n_test"))
    return as_train.unionByName(as_test).groupBy("train", "test", "y").agg(
        F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))


@dataclass
class Experiment:
    bundles: list[Bundle]
    scored: DataFrame | None
    results: DataFrame


def _linear_bundles(split: DataFrame, data: dict, used: list[str], model_type: str, **overrides) -> tuple[list[Bundle], DataFrame | None]:
    """All fits from shared passes: as many scans as the slowest fit has steps, for any number of pairs."""
    wanted = {(tr, te): TrainingSet(tr, "train" if tr == te else "all", tuple(d.cols)) for (tr, te), d in data.items()}
    columns, classes = collect_statistics(split, used)
    fitted = fit_sets(split, list(dict.fromkeys(wanted.values())), model_type, columns, classes, **overrides)
    models = {s: linear_model(split.sparkSession, p, list(s.cols), columns[s.era, s.part]) for s, p in fitted.items()}
    pairs = [(tr, te, s) for (tr, te), s in wanted.items() if s in fitted]
    bundles = [Bundle(model_type, tr, te, list(s.cols), models[s]) for tr, te, s in pairs]
    return bundles, score_sets(split, [(tr, te, s, fitted[s]) for tr, te, s in pairs], columns) if pairs else None


def _tree_bundles(data: dict, model_type: str, parallelism: int, **overrides) -> tuple[list[Bundle], DataFrame | None]:
    groups: dict[tuple, list[tuple[str, str]]] = {}
    for (tr, te), d in data.items():
        groups.setdefault((tr, tr == te, tuple(d.cols)), []).append((tr, te))

    def fit(group):
        first = data[group[0]]
        return group, fit_model(first.train_rows, first.cols, model_type, **overrides)

    bundles = []
    with ThreadPoolExecutor(parallelism) as pool:
        for group, model in pool.map(fit, groups.values()):
            if model is not None:
                bundles += [Bundle(model_type, tr, te, data[tr, te].cols, model) for tr, te in group]
    scored = None
    for b in bundles:
        part = score(b.model, data[b.train, b.test].test_rows, ["user_id", "y"]).select(
            F.lit(b.train).alias("train"), F.lit(b.test).alias("test"), "*")
        scored = part if scored is None else scored.unionByName(part)
    return bundles, scored


def run_pairwise_experiment(
    df: DataFrame, contract: DataFrame, eras: list[str], model_type: str = "logreg",
    parallelism: int = 4, **overrides,
) -> Experiment:
    """All pairs of one model family.

    Pairs that train on the same rows and columns share one fit. The linear
    families are fitted and scored for all pairs in the same passes over the
    data; fits of trees are Spark jobs of their own, a few at a time. A pair
    whose training rows hold one class has no bundle and NULL metrics.
    """
    spark = df.sparkSession
    kept = kept_columns(contract)
    pairs = [(tr, te) for tr in eras for te in eras]
    used = sorted({c for p in pairs for c in kept.get(p, [])})
    rows = labelled(df).select("dataset", "user_id", "y", *[c for c in used if c in df.columns])
    split = cut(stratified_split(rows.filter(F.col("dataset").isin(eras))))
    data = {p: pair_data(split, kept, *p) for p in pairs}

    if model_type in fv.LINEAR_MODELS:
        bundles, scored = _linear_bundles(split, data, used, model_type, **overrides)
    else:
        bundles, scored = _tree_bundles(data, model_type, parallelism, **overrides)

    counts = pair_counts(split, eras).groupBy(*PAIR).agg(
        F.sum("n_train").alias("n_train"), F.sum("n_test").alias("n_test"))
    features = spark.createDataFrame(
        [(tr, te, len(data[tr, te].cols)) for tr, te in pairs], "train string, test string, n_features int")
    scope = F.when(F.col("train") == F.col("test"), fv.SCOPE_WITHIN).otherwise(fv.SCOPE_CROSS)
    results = features.join(counts, PAIR, "left")
    if scored is not None:
        scored = cut(scored)
        results = results.join(accuracy(scored, PAIR, threshold=None), PAIR, "left").join(
            auc_exact(scored, PAIR).select(*PAIR, "auc"), PAIR, "left")
    else:
        results = results.withColumns({m: F.lit(None).cast("double") for m in ("accuracy", "auc")})
    results = cut(results.withColumns({"model": F.lit(model_type), "scope": scope}).select(*RESULT_COLS))
    _note_metrics(bundles, results)
    return Experiment(bundles, scored, results)


_METRICS = ["accuracy", "auc", "n_features", "n_train", "n_test"]


def _note_metrics(bundles: list[Bundle], results: DataFrame) -> None:
    """Give each bundle its pair's row of metrics: one row per pair, cross_era 1 for two eras."""
    by_pair = {(r["train"], r["test"]): r for r in results.collect()}
    for b in bundles:
        row = by_pair[b.train, b.test]
        b.metrics = {m: float(row[m]) for m in _METRICS if row[m] is not None}
        b.metrics["cross_era"] = float(b.train != b.test)


def run_all_families(
    df: DataFrame, contract: DataFrame, eras: list[str], families: list[str] | None = None, **how,
) -> Experiment:
    """run_pairwise_experiment for several families (all by default), their rows in one table."""
    runs = [run_pairwise_experiment(df, contract, eras, m, **how) for m in families or fv.MODEL_FAMILIES]
    results = runs[0].results
    for r in runs[1:]:
        results = results.unionByName(r.results)
    return Experiment([b for r in runs for b in r.bundles], None, results)


def evaluate_bundle(bundle: Bundle, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ROC points and confusion counts of a bundle on any labelled frame, under its own pair."""
    rows = labelled(df)
    scored = cut(score(bundle.model, rows, ["user_id", "y"]).withColumns(
        {"train": F.lit(bundle.train), "test": F.lit(bundle.test)}))
    return roc_curve(scored), confusion_matrix(scored, threshold=None)


def train_and_evaluate_pair(
    df: DataFrame, contract: DataFrame, train: str, test: str, model_type: str = "logreg", **overrides,
) -> tuple[Bundle | None, DataFrame]:
    """One pair: its bundle and its row of metrics."""
    only = contract.filter((F.col("train") == train) & (F.col("test") == test))
    kept = kept_columns(only)
    rows = labelled(df.filter(F.col("dataset").isin(train, test)))
    split = cut(stratified_split(rows))
    d = pair_data(split, kept, train, test)
    model = fit_model(d.train_rows, d.cols, model_type, **overrides)
    sizes = (d.train_rows.count(), d.test_rows.count())
    scope = fv.SCOPE_WITHIN if train == test else fv.SCOPE_CROSS
    meta = df.sparkSession.createDataFrame(
        [(model_type, train, test, len(d.cols), *sizes, scope)],
        "model string, train string, test string, n_features int, n_train bigint, n_test bigint, scope string")
    if model is None:
        nothing = F.lit(None).cast("double")
        return None, meta.withColumns({"accuracy": nothing, "auc": nothing}).select(*RESULT_COLS)
    bundle = Bundle(model_type, train, test, d.cols, model)
    scored = cut(score(model, d.test_rows, ["y"]).withColumns({"train": F.lit(train), "test": F.lit(test)}))
    metrics = cut(meta.join(accuracy(scored, PAIR, None), PAIR, "left").join(
        auc_exact(scored).select(*PAIR, "auc"), PAIR, "left").select(*RESULT_COLS))
    _note_metrics([bundle], metrics)
    return bundle, metrics
