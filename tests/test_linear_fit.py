"""Many linear fits from shared passes."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from erashift.operators import contracts, linear_fit, models
from erashift.plans import experiment


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    rows = []
    for era, n in (("a", 300), ("b", 200), ("one", 60)):
        x = rng.normal(size=(n, 3)) * [1, 50, 0.01] + [0, 1000, 5]
        y = (x[:, 0] + (x[:, 1] - 1000) / 80 + rng.normal(size=n) * 1.5 > 0.3).astype(int) if era != "one" else np.ones(n, int)
        for k in range(n):
            v = [float(c) for c in x[k]]
            rows.append((era, f"{era}{k}", int(y[k]), int(k % 5 == 0), v[0], None if k % 4 == 1 else v[1], v[2], 7.0, None if era == "a" else 1.0 * (k % 3)))
    return rows


COLS = ["p", "q", "r", "flat", "gone"]


@pytest.fixture(scope="module")
def split(spark, data):
    return spark.createDataFrame(data, "dataset string, user_id string, y int, is_test int, p double, q double, r double, flat double, gone double").repartition(5).cache()


def test_statistics_against_numpy(split, data):
    got = {(r["dataset"], r["part"], r["col"]): r for r in linear_fit.column_statistics(split, COLS).collect()}
    assert len(got) == 30
    for era in ("a", "b", "one"):
        for part in linear_fit.PARTS:
            for k, c in enumerate(COLS):
                v = np.array([np.nan if r[4 + k] is None else r[4 + k] for r in data if r[0] == era and (part == "all" or not r[3])])
                r = got[era, part, c]
                assert (r["n"], r["known"]) == (len(v), np.isfinite(v).sum())
                if c == "gone" and era == "a":
                    assert r["median"] is None and r["mean"] is None and r["std"] is None
                else:
                    full = np.where(np.isnan(v), np.nanmedian(v), v)
                    assert [r["median"], r["mean"], r["std"]] == pytest.approx([np.nanmedian(v), full.mean(), full.std()], rel=1e-12, abs=1e-12)


@pytest.fixture(scope="module")
def fitted(split):
    columns, classes = linear_fit.collect_statistics(split, COLS)
    sets = [linear_fit.TrainingSet(e, p, c) for e in ("a", "b", "one") for p in linear_fit.PARTS for c in (tuple(COLS), ("p",), ())]
    return columns, classes, {f: linear_fit.fit_sets(split, sets, f, columns, classes) for f in linear_fit.COST}


def test_sets_that_can_be_fitted(fitted):
    for problems in fitted[2].values():
        assert len(problems) == 8 and {s.era for s in problems} == {"a", "b"} and all(p.done for p in problems.values())


@pytest.mark.parametrize("family", list(linear_fit.COST))
def test_weights_are_optimal(fitted, family):
    for p in fitted[2][family].values():
        assert p.violation() < 1e-5


@pytest.mark.parametrize("family", ["logreg", "lasso", "svm"])
def test_optimality_recomputed_in_sql(fitted, data, family):
    """The gradient at the stored weights, from the raw rows, by DuckDB."""
    import pandas as pd

    columns, classes, fits = fitted
    frame = pd.DataFrame(data, columns=["dataset", "user_id", "y", "is_test", *COLS])  # noqa: F841
    for s, p in fits[family].items():
        st, theta = columns[s.era, s.part], p.theta.tolist()
        x = [f"((coalesce({c}, {st.median[c]!r}::double) - {st.mean[c]!r}::double) / {st.std[c]!r}::double)" for c in s.cols] + ["1::double"]
        z = " + ".join(f"{v!r}::double * {e}" for v, e in zip(theta, x))
        weight = {y: w for y, (_, w) in classes[s.era, s.part].items()}
        side, share = "(2 * y - 1)", f"(case when y = 1 then {weight[1]!r}::double else {weight[0]!r}::double end)"
        pull = f"(2 * greatest(0, 1 - {side} * ({z})))" if family == "svm" else f"(1 / (1 + exp({side} * ({z}))))"
        grads = duckdb.sql("select " + ", ".join(f"sum(-{share} * {side} * {pull} * {e})" for e in x) +
                           f" from frame where dataset = '{s.era}'" + (" and is_test = 0" if s.part == "train" else "")).fetchall()[0]
        for k, (g, v) in enumerate(zip(grads, theta)):
            g *= linear_fit.COST[family]
            if family == "lasso":
                assert abs(g + np.sign(v)) < 1e-5 if v else abs(g) <= 1 + 1e-9
            else:
                assert abs(g + (v if family == "svm" or k < len(theta) - 1 else 0)) < 1e-5


def test_lasso_drops_columns_and_penalises_the_intercept(fitted):
    p = fitted[2]["lasso"][linear_fit.TrainingSet("a", "all", tuple(COLS))]
    assert p.theta[3] == 0 and p.theta[4] == 0 and p.theta[0] != 0
    assert p.theta[-1] == 0 or abs(p.grad[-1] + np.sign(p.theta[-1])) < 1e-5


@pytest.mark.parametrize("family", ["logreg", "lasso", "svm"])
def test_shared_passes_equal_single_fits(split, fitted, family):
    s = linear_fit.TrainingSet("b", "train", tuple(COLS))
    alone = models.fit_model(split.filter("dataset = 'b' and is_test = 0"), COLS, family).stages[-1]
    theta = fitted[2][family][s].theta
    assert [*alone.coefficients, alone.intercept] == pytest.approx(theta.tolist(), rel=1e-7, abs=1e-9)


@pytest.mark.parametrize("family", ["ridge", "svm"])
def test_shared_scores_equal_those_of_the_bundles(split, spark, family):
    frame = split.withColumn("label", F.when(F.col("y") == 1, "bot").otherwise("human"))
    contract = contracts.pairwise_contract(contracts.column_stats(frame, COLS), COLS, ["a", "b"])
    run = experiment.run_pairwise_experiment(frame, contract, ["a", "b"], family)
    got = {(r["train"], r["test"], r["user_id"]): (r["score"], r["pred"]) for r in run.scored.collect()}
    assert len(run.bundles) == 4
    for b in run.bundles:
        for r in models.score(b.model, frame.filter(F.col("dataset") == b.test), ["user_id"]).collect():
            key = b.train, b.test, r["user_id"]
            if key in got:
                assert got[key][0] == pytest.approx(r["score"], rel=1e-9, abs=1e-12) and got.pop(key)[1] == r["pred"]
    assert not got


def test_passes_do_not_grow_with_the_sets(split, spark):
    columns, classes = linear_fit.collect_statistics(split, COLS)
    sets = [linear_fit.TrainingSet(e, p, c) for e in ("a", "b") for p in linear_fit.PARTS for c in (tuple(COLS), ("p", "q"), ("p", "r"), ("q", "r"))]
    jobs = []
    for some in (sets[:1], sets):
        spark.sparkContext.setJobGroup(f"fit-{len(some)}", "")
        linear_fit.fit_sets(split, some, "svm", columns, classes, maxIter=3)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{len(some)}")))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0


def test_separable_rows_and_few_rows(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 3.0)], "y int, x double")
    for family in linear_fit.COST:
        model = models.fit_model(rows, ["x"], family)
        pred = [r["pred"] for r in models.score(model, rows, ["y"]).orderBy("y").collect()]
        assert pred == ([0, 0, 0] if family == "lasso" else [0, 0, 1])  # too few rows to be worth a lasso weight
    assert models.fit_model(rows.limit(0), ["x"], "logreg") is None and models.fit_model(rows, [], "svm") is None
