import pytest
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.operators import contracts, evaluation, importances, models
from erashift.plans import experiment
from erashift.sources import writers


def test_four_reasons(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None, 1.0, 2.0, 0.1), ("a", 2.0, None, 1.0, 3.0, 0.2), ("b", 1.0, 1.0, 1.0, 4.0, 0.1), ("b", 3.0, 2.0, 2.0, 5.0, 0.3)],
        "dataset string, good double, empty double, flat double, followers_count double, emb_0 double")
    cols = ["good", "empty", "flat", "followers_count", "emb_0", "ghost"]
    got = {r["col"]: r["reason"] for r in contracts.cross_era_features(df, cols).collect()}
    assert got == {
        "good": None, "empty": "NaN rate ≥ 0.99 in: ['a']", "flat": "zero variance in: ['a']",
        "followers_count": fv.REASON_DENY_COL, "emb_0": fv.REASON_DENY_PREFIX, "ghost": fv.REASON_ABSENT,
    }
    stats = contracts.column_stats(df, cols[:-1])
    pairs = contracts.pairwise_contract(stats, cols, ["a", "b"]).collect()
    kept = {(r["train"], r["test"]): set() for r in pairs}
    for r in pairs:
        if r["kept"]:
            kept[r["train"], r["test"]].add(r["col"])
    assert kept["b", "b"] == {"good", "empty", "flat", "followers_count", "emb_0"} and kept["a", "b"] == {"good"}
    everywhere = {c for c, reason in got.items() if reason is None}
    assert all(everywhere <= k for k in kept.values())


def test_matrices(spark, rows):
    df = spark.createDataFrame(
        [("a", "a", 0.9), ("a", "b", 0.6), ("b", "a", 0.5), ("b", "b", 0.8)], "train string, test string, auc double")
    assert evaluation.mean_cross_era(df).first()[0] == pytest.approx(0.55)
    assert rows(evaluation.degradation(df)) == [("a", "a", 0.0), ("a", "b", 0.3), ("b", "a", 0.3), ("b", "b", 0.0)]
    assert rows(evaluation.metric_matrix(df, ["a", "b"])) == [("a", 0.9, 0.6), ("b", 0.5, 0.8)]
    assert rows(evaluation.diagonal_vs_cross(df)) == [("a", 0.9, 0.6), ("b", 0.8, 0.5)]


def test_published_cross_era_mean(spark):
    """Logistic regression: mean of the twelve off-diagonal cells."""
    cells = [[0.9955, 0.2663, 0.7308, 0.5398], [0.6411, 0.9904, 0.3091, 0.4916],
             [0.5760, 0.7446, 0.8862, 0.4897], [0.3281, 0.8272, 0.7716, 0.8356]]
    data = [(fv.ERAS[i], fv.ERAS[j], v) for i, row in enumerate(cells) for j, v in enumerate(row)]
    df = spark.createDataFrame(data, "train string, test string, auc double")
    assert evaluation.mean_cross_era(df).first()[0] == pytest.approx(0.5597, abs=5e-5)


def test_confusion_has_all_cells(spark, rows):
    df = spark.createDataFrame([("a", "b", 1, 0.9), ("a", "b", 1, 0.2), ("a", "b", None, 0.2)], "train string, test string, y int, score double")
    assert rows(evaluation.confusion_matrix(df), "truth", "predicted", "n", "row_share") == [
        (0, 0, 0, None), (0, 1, 0, None), (1, 0, 1, 0.5), (1, 1, 1, 0.5)]


def test_importance_order(spark):
    df = spark.createDataFrame([("p", "x", -3.0), ("p", "y", 2.0), ("q", "x", 1.0)], "pair string, feature string, value double")
    assert importances.importance_topk(df, "logreg", 1).filter("pair = 'p'").first()["feature"] == "x"
    assert importances.importance_topk(df, "rf", 1).filter("pair = 'p'").first()["feature"] == "y"
    wide = importances.importance_matrix(df, ["p", "q"], "logreg", top_k=1).collect()
    assert [(r["feature"], r["p"], r["q"]) for r in wide] == [("x", -3.0, 1.0)]


def test_split_sizes_match_the_published_ones(spark):
    """5 301 rows: 1 061 held out, 4 240 left; classes in proportion."""
    rows = spark.range(5301).select(F.lit("e").alias("dataset"), (F.col("id") < 3986).cast("int").alias("y"), F.col("id").cast("string").alias("user_id"))
    split = models.stratified_split(rows)
    got = {(r["y"], r["is_test"]): r["count"] for r in split.groupBy("y", "is_test").count().collect()}
    assert got[0, 1] + got[1, 1] == 1061 and got[0, 0] + got[1, 0] == 4240
    assert abs(got[1, 1] - 0.2 * 3986) <= 1 and abs(got[0, 1] - 0.2 * 1315) <= 1


@pytest.fixture(scope="module")
def frame(spark):
    """Three eras; x separates the classes in two of them, era c has one class."""
    era = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c")
    bot = (F.col("id") % 2 == 0) & (era != "c")
    noise = F.pmod(F.xxhash64("id"), F.lit(100)) / 100.0
    return spark.range(360).select(
        era.alias("dataset"), F.col("id").cast("string").alias("user_id"), F.when(bot, " Bot").otherwise("human").alias("label"),
        (bot.cast("int") * 0.8 + noise).alias("x"), F.when(F.col("id") % 7 != 0, noise * 3 + 1).alias("z"))


@pytest.fixture(scope="module")
def contract(frame):
    return contracts.pairwise_contract(contracts.column_stats(frame, ["x", "z"]), ["x", "z"], ["a", "b", "c"])


@pytest.mark.parametrize("family,small", [
    ("logreg", {}), ("lasso", {}), ("svm", {"maxIter": 50}), ("rf", {"numTrees": 5, "maxDepth": 4}), ("xgb", {"maxIter": 3, "maxDepth": 2})])
def test_families_learn(frame, family, small):
    rows = models.labelled(frame.filter("dataset = 'a'"))
    model = models.fit_model(rows, ["x", "z"], family, **small)
    bundle = models.Bundle(family, "a", "a", ["x", "z"], model)
    scored = models.predict_with_bundle(bundle, models.labelled(frame.filter("dataset = 'b'")), ["dataset", "y"])
    assert evaluation.auc_exact(scored, ["dataset"]).first()["auc"] > 0.9
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low < high <= 1
    assert models.feature_importance(bundle)[0][0] == "x"


def test_experiment_and_bundles(spark, frame, contract, tmp_path):
    run = experiment.run_pairwise_experiment(frame, contract, ["a", "b", "c"], "logreg")
    results = {(r["train"], r["test"]): r for r in run.results.collect()}
    assert len(results) == 9 and results["a", "b"]["auc"] > 0.9 and results["a", "b"]["n_train"] == 120
    assert results["a", "a"]["n_test"] == 24 and results["a", "a"]["scope"] == fv.SCOPE_WITHIN
    assert results["c", "a"]["auc"] is None and results["a", "c"]["auc"] is None and results["a", "c"]["accuracy"] is not None
    writers.save_bundles(spark, run.bundles, str(tmp_path))
    again = writers.load_bundles(spark, str(tmp_path), "logreg", ["a", "b", "c"])
    assert {(b.train, b.test) for b in again} == {(b.train, b.test) for b in run.bundles}
    b = next(b for b in again if (b.train, b.test) == ("a", "b"))
    old = next(o for o in run.bundles if (o.train, o.test) == ("a", "b"))
    assert b.metrics == old.metrics and set(b.metrics) == {"accuracy", "auc", "n_features", "n_train", "n_test", "cross_era"}
    assert b.metrics["auc"] == results["a", "b"]["auc"] and b.metrics["cross_era"] == 1.0
    roc, confusion = experiment.evaluate_bundle(b, frame.filter("dataset = 'b'"))
    assert confusion.agg(F.sum("n")).first()[0] == 120 and roc.agg(F.max("tpr")).first()[0] == 1.0
    same = frame.filter("dataset = 'b'")
    assert models.predict_with_bundle(b, same, ["user_id"]).orderBy("user_id").collect() == \
        models.predict_with_bundle(old, same, ["user_id"]).orderBy("user_id").collect()
    with pytest.raises(ValueError):
        models.predict_with_bundle(b, same.drop("x"))
    writers.save_results(run.results, str(tmp_path / "results"))
    assert spark.read.parquet(str(tmp_path / "results")).count() == 9
    writers.save_contract(contract, str(tmp_path / "contract"))
    assert writers.load_contract(spark, str(tmp_path / "contract")).count() == contract.count()


def test_all_families_in_one_table(frame, contract):
    run = experiment.run_all_families(frame, contract, ["a", "b"], ["logreg", "ridge"])
    assert run.results.groupBy("model").count().collect() and run.results.count() == 8 and len(run.bundles) == 8
    by = {(r["model"], r["train"], r["test"]): r["auc"] for r in run.results.collect()}
    assert all(by["logreg", a, b] == by["ridge", a, b] for a in "ab" for b in "ab")


def test_single_pair(frame, contract):
    bundle, metrics = experiment.train_and_evaluate_pair(frame, contract, "a", "b", "logreg")
    assert metrics.first()["auc"] > 0.9 and bundle.feature_cols == ["x", "z"]
    nothing, empty = experiment.train_and_evaluate_pair(frame, contract, "c", "a")
    assert nothing is None and empty.first()["auc"] is None


def test_pair_errors(frame):
    split = frame.withColumn("y", F.lit(1)).withColumn("is_test", F.lit(0))
    with pytest.raises(KeyError):
        experiment.pair_data(split, {}, "a", "b")
    with pytest.raises(ValueError):
        experiment.pair_data(split, {("a", "b"): ["ghost"]}, "a", "b")
    with pytest.raises(ValueError):
        models.classifier("tree", 1)


def test_forest_walks_rows_down_once(spark):
    """Deep forests keep each row's node instead of walking it down every tree in every pass."""
    forest = models.classifier("rf")
    assert forest.getCacheNodeIds() and forest.getMaxDepth() == 30 and forest.getNumTrees() == 200


def test_validation_computes_the_frame_once(spark, monkeypatch):
    stored = []
    cut = contracts.cut
    monkeypatch.setattr(contracts, "cut", lambda df: (stored.append(df), cut(df))[1])
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [("a", str(i), float(i), 1.0) for i in range(20)]
    frame = spark.createDataFrame(rows, "dataset string, user_id string, x double, unused double")
    got = contracts.validate_frame(frame.mapInArrow(count, frame.schema), ["x"]).collect()
    assert len(stored) == 1 and seen.value == 20 and stored[0].columns == ["dataset", "user_id", "x"]
    assert [tuple(r) for r in got] == [("a", "x", 20, 0.0, 0)]
