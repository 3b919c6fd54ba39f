import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from erashift.operators import order_stats, skew
from erashift.operators.evaluation import auc_exact, roc_curve


@pytest.fixture(scope="module")
def hot_table(spark):
    """A third of the rows on one key."""
    rng = random.Random(1)
    data = [("hot" if i % 3 == 0 else f"k{rng.randrange(40)}", i) for i in range(900)]
    return spark.createDataFrame(data, "k string, v int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_splitting_hot_keys_changes_nothing(spark, hot_table, rows, how):
    lookup = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 40, 2)], "k string, w int")
    plain = hot_table.join(lookup, "k", how)
    assert rows(skew.skew_join(hot_table, lookup, ["k"], how, hot_rows=20)) == rows(plain)


def test_hot_key_is_really_spread(spark, hot_table):
    counts = skew._rows_per(hot_table, ["k"])
    hot = skew.hot_keys(counts, ["k"], hot_rows=100)
    assert [(r["k"], r["_parts"]) for r in hot.collect()] == [("hot", 3)]
    parts = skew.salt_rows(hot_table, hot, ["k"]).filter("k = 'hot'").groupBy("_salt").count().collect()
    assert len(parts) == 3 and max(r["count"] for r in parts) < 160
    assert skew.hot_keys(counts, ["k"], hot_rows=1000) is None


def test_large_lookup_is_not_broadcast(spark, hot_table, rows):
    lookup = hot_table.groupBy("k").count()
    joined = skew.lookup_join(hot_table, lookup, ["k"], "left", max_rows=3, hot_rows=50)
    assert rows(joined) == rows(hot_table.join(lookup, "k", "left"))


def test_many_eras(spark):
    eras = spark.range(1500).select(F.format_string("%05d", "id").alias("dataset"))
    assert skew.eras_of(eras) == [f"{i:05d}" for i in range(1500)]


def test_summary_beyond_the_broadcast_bound(spark, hot_table, rows):
    summary = skew.stored_small(hot_table.groupBy("k").count(), max_rows=1)
    assert rows(hot_table.join(summary, "k")) == rows(hot_table.join(hot_table.groupBy("k").count(), "k"))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 501])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    data = {g: rng.integers(0, 9, n) * rng.random(n) for g in ("a", "b")}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [("a", None)], "g string, x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in order_stats.exact_quantiles(df, ["g"], ["x"], probs).collect()}
    for g, vs in data.items():
        for p in probs:
            assert got[g, p] == pytest.approx(np.quantile(vs, p), abs=1e-12)


@pytest.mark.parametrize("k", [8, 2000])
def test_quantiles_order_no_more_than_hot_rows(spark, monkeypatch, k):
    """Also with a sketch so coarse that its proposals often miss."""
    monkeypatch.setattr(order_stats, "SKETCH_K", k)
    rng = np.random.default_rng(3)
    data = {"even": (np.arange(20001) * 7919) % 20001, "ties": np.where(rng.random(6000) < 0.4, 7, rng.integers(0, 4000, 6000)),
            "two": np.array([1.0] * 2500 + [2.0] * 2501), "few": np.array([3.0, 1.0, 2.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in data.items() for v in vs] + [(None, 5.0)] * 300, "g string, x double").cache()
    last, plain = [], order_stats._inside
    monkeypatch.setattr(order_stats, "_inside", lambda tall, places, group: last.append(plain(tall, places, group)) or last[-1])
    probs = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0]
    got = {(r["g"], r["prob"]): r["value"] for r in order_stats.exact_quantiles(df, ["g"], ["x"], probs, hot_rows=40).collect()}
    for g, vs in data.items():
        assert [got[g, p] for p in probs] == pytest.approx([np.quantile(vs, p) for p in probs], abs=1e-9)
    assert all(got[None, p] == 5.0 for p in probs)
    assert last[-1].groupBy("g", "at").count().agg(F.max("count")).first()[0] <= 40


def test_hash_sample_is_exact_and_repeatable(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"))
    want = sorted((str(i) for i in range(3000)), key=lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest())[:100]
    got = [r["k"] for r in order_stats.hash_sample(df.repartition(7), 100, ["k"], seed=7).collect()]
    assert sorted(got) == sorted(want)
    assert order_stats.hash_sample(df, 5000, ["k"]).count() == 3000


def test_hash_sample_with_equal_keys(spark):
    df = spark.range(50).select(F.lit("same").alias("k"), "id")
    assert order_stats.hash_sample(df, 20, ["k"]).count() == 20


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("hot_rows", [None, 10])
def test_auc_and_roc_over_buckets(spark, hot_rows):
    rng = random.Random(3)
    data = [(e, rng.randrange(2) if e != "one" else 1, round(rng.random(), 2)) for e in ("a", "b", "one") for _ in range(300)]
    df = spark.createDataFrame(data, "train string, y int, score double")
    got = {r["train"]: r["auc"] for r in auc_exact(df, ["train"], hot_rows=hot_rows).collect()}
    for era in ("a", "b"):
        assert got[era] == pytest.approx(brute_auc([(y, s) for e, y, s in data if e == era]), abs=1e-12)
    assert got["one"] is None
    flipped = df.withColumn("score", -F.col("score"))
    back = {r["train"]: r["auc"] for r in auc_exact(flipped, ["train"], hot_rows=hot_rows).collect()}
    assert back["a"] == pytest.approx(1 - got["a"])
    points = sorted((r["fpr"], r["tpr"]) for r in roc_curve(df, ["train"], hot_rows).filter("train = 'a'").collect())
    area = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(points, points[1:]))
    assert area == pytest.approx(got["a"], abs=1e-12) and points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)


def test_ranges_are_small_and_sums_run_through_three_levels(spark):
    rng = random.Random(6)
    data = [(g, rng.choice([0.5, rng.random(), rng.random()]), rng.randrange(2)) for g in ("a", "b") for _ in range(600)]
    df = spark.createDataFrame(data, "train string, score double, y int").cache()
    paths = order_stats.value_ranges(df, "score", hot_rows=30, fan_out=4).cache()
    assert paths.agg(F.max(F.length("path"))).first()[0] >= 3 * order_stats.PATH_DIGITS
    assert paths.groupBy("path").agg(F.count_distinct("score").alias("n"), F.count("*").alias("rows")).filter("rows > 30 and n > 1").count() == 0
    spans = sorted((r["path"], r["lo"], r["hi"]) for r in paths.groupBy("path").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    totals = paths.groupBy("train", "path").agg(F.sum("y").alias("v"))
    for descending in (False, True):
        got = {(r["train"], r["path"]): r["v"] for r in order_stats.tree_prefix_sums(totals, ["train"], ["v"], descending).collect()}
        known = {(r["train"], r["path"]): r["v"] for r in totals.collect()}
        assert got == {(g, p): sum(v for (h, q), v in known.items() if h == g and (q > p if descending else q < p)) for g, p in known}
    got = {r["train"]: r["auc"] for r in auc_exact(df, ["train"], 30, 4).collect()}
    want = {g: brute_auc([(y, s) for e, s, y in data if e == g]) for g in ("a", "b")}
    assert got == pytest.approx(want, abs=1e-12)
    assert {tuple(r) for r in roc_curve(df, ["train"], 30, 4).collect()} == {tuple(r) for r in roc_curve(df, ["train"]).collect()}


def test_auc_edge_cases(spark):
    data = [("equal", 1, 0.3), ("equal", 0, 0.3), ("perfect", 1, 0.9), ("perfect", 0, 0.1), ("one", 1, 0.5), ("one", None, 0.5)]
    got = auc_exact(spark.createDataFrame(data, "train string, y int, score double"), ["train"]).collect()
    assert {r["train"]: r["auc"] for r in got} == {"equal": 0.5, "perfect": 1.0, "one": None}
