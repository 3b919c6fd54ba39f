"""Decontamination, classifiers, mixing, sharding and the pipeline."""

import collections
import math
import re
import zlib

import pytest
from brute import crc, words

import corpus_pipeline
from erashift.llm import decontaminate, mixing, quality, sharding, toxicity
from erashift.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_values(spark, key):
    from check_queries import compare, connect

    assert compare(QUERIES[key](spark, SF), connect(SF), ORACLES[key]) is None


def test_every_operator_has_its_query():
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in QUERIES) == 1


def contained_brute(pairs, items):
    def shingles(t):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[a:a + 5]) for a in range(len(w) - 4)}

    out = []
    for j, u in items:
        want = shingles(u)
        for i, t in pairs:
            both = len(want & shingles(t))
            if want and 100 * both >= 80 * len(want):
                out.append((i, j, len(want), both, round(both / len(want), 9)))
    return sorted(out)


@pytest.fixture(scope="module")
def items(spark, pairs):
    long = max((t for _, t in pairs if t), key=len).split()
    rows = [(1, " ".join(long[500:530])), (2, " ".join(long[9000:9040]).upper()), (3, "four words are short"), (4, None), (5, ""),
            (6, " ".join(long[100:112] + ["x", "y"])), (7, " ".join(long[100:104] + ["x"] + long[105:110])), (8, " ".join(long[3:8]))]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def test_decontamination_against_brute_force(docs, pairs, items, rows):
    got = sorted(rows(decontaminate.find_contaminated(docs, items[0]), "doc_id", "item_id", "n_item", "n_shared", "containment"))
    want = contained_brute(pairs, items[1])
    assert got == want and {p[1] for p in want} >= {1, 2, 6, 8}
    bad = {p[0] for p in want}
    clean = decontaminate.decontaminate(docs, items[0])
    assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i, _ in pairs if i not in bad]


def test_decontamination_by_shuffle_and_odd_rows(docs, pairs, items, odd, empty, rows, monkeypatch, spark):
    no_items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(odd, no_items).count() == odd.count()
    assert decontaminate.find_contaminated(empty, items[0]).count() == 0
    seven = spark.createDataFrame([(1, "A, b c d e f g!")], "item_id long, text string")
    assert rows(decontaminate.find_contaminated(odd, seven), "doc_id", "item_id") == sorted([(7, 1), (None, 1)], key=repr)
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert sorted(rows(decontaminate.find_contaminated(docs, items[0]), "doc_id", "item_id")) == [p[:2] for p in contained_brute(pairs, items[1])]


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination_judges_each_row(spark, rows, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    ws = [f"w{i}" for i in range(20)]
    item = spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")
    halves = [" ".join(ws[:12]), " ".join(ws[8:])]  # together they hold the item, alone neither does
    table = [(i, t) for i in (None, 7) for t in ("x " + " ".join(ws), "a clean text of some more words", None, *halves, *halves[:1])]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(decontaminate.find_contaminated(docs, item), "doc_id", "item_id", "n_shared") == sorted([(7, 1, 16), (None, 1, 16)], key=repr)
    assert rows(decontaminate.decontaminate(docs, item)) == sorted((r for r in table if not (r[1] or "").startswith("x")), key=repr)


@pytest.mark.parametrize("key, label, folds, fold, cut", [("op4_toxicity", "toxic", 5, 0, 0.5), ("op7_quality", "quality", 4, 2, 0.7)])
def test_held_out_accuracy(spark, key, label, folds, fold, cut):
    sf = "/root/testdata/sf0.1" if label == "toxic" else "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES[key](spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (crc(r["doc_id"]) % folds == fold) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in got)
    judged = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in judged) / len(judged) > 0.94
    if label == "toxic":
        caught = [p for p, y in judged if y]
        assert sum(caught) / len(caught) > 0.85


def test_misspelt_words_are_caught():
    rude, kind = ["worthless", "disgusting", "pathetic"], ["garden", "morning", "letters", "window"]
    texts = [f"{kind[i % 4]} {kind[(i + 1) % 4]} {rude[i % 3]} {i}" for i in range(60)] + [f"{kind[i % 4]} {kind[i % 3]} {i}" for i in range(60)]
    score = toxicity.fit(texts, [1] * 60 + [0] * 60).scorer()
    assert score("morning worthles garden") > 0.5 > score("morning letters garden")


def test_classifiers_without_usable_labels(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(7, 1, 1), (9, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for train, score in ((toxicity.train_toxicity, toxicity.score_toxicity), (quality.train_quality, quality.score_quality)):
            model = train(odd, labels)
            got = score(odd, model).collect()
            assert len(got) == 7 and len({r["score"] for r in got}) == 1
            assert score(empty, model).count() == 0
    assert toxicity.drop_toxic(odd, toxicity.fit([], [])).count() == 7
    assert toxicity.drop_toxic(odd, toxicity.fit([], [])).columns == odd.columns


def test_pairs_rank_better_texts_higher():
    good = [f"Some plain text number {i} with several different words in it." for i in range(40)]
    bad = [f"SHOUT{i}!! AND!! SHOUT!! MORE!! ###" for i in range(40)]
    model = quality.fit(good + bad, [1] * 40 + [0] * 40)
    score = model.scorer()
    assert min(map(score, good)) >= 0.7 > max(map(score, bad))


def test_cut_with_tied_strengths():
    import numpy as np

    strengths = np.array([0.1] * 30 + [0.7 + 1e-13 * k for k in range(40)] + [0.9] * 30)
    for below, want in ((0.3, 0.4), (0.5, 0.8), (0.7, 0.8), (0.0, 0.4)):
        assert math.isclose(quality.cut_at(strengths, np.full(100, 0.01), below), want, abs_tol=1e-6)
    assert quality.cut_at(strengths, np.full(100, 0.01), 1.0) > 0.9


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_quality_is_learnt_from_every_label(spark, monkeypatch, few):
    import numpy as np

    from erashift.llm import labelled
    from erashift.operators.skew import is_bounded

    monkeypatch.setattr(labelled, "is_bounded", lambda df: is_bounded(df, few))
    monkeypatch.setattr(quality, "FEW", 50)
    good = [(i, f"{'plain words of a text ' * (1 + i % 9)}number {i}", 1) for i in range(7_000)]
    bad = [(i, f"SHOUT {i}! {'mixed words ' * (i % 7)}{'!' * (i % 5)}", 0) for i in range(7_000, 9_000)]
    table = good + bad
    docs = spark.createDataFrame([r[:2] for r in table], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in table], "doc_id long, quality int")
    used = [r for r in table if crc(r[0]) % 4 != 2]
    assert len(used) > 6_000
    model, plain = quality.train_quality(docs, labels), quality.fit([t for _, t, _ in used], [y for *_, y in used])
    assert np.allclose(model.mean, plain.mean, rtol=1e-9) and np.allclose(model.weight, plain.weight, rtol=1e-3, atol=1e-3)
    assert math.isclose(model.cut, plain.cut, rel_tol=1e-3, abs_tol=1e-3)


def test_quality_minimises_the_loss_over_all_pairs():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.random((300, 12))
    label = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 0.3, 300) > 0.6).astype(int)
    model = quality.fit_features(x, label)
    z = model.standard(x)
    diff = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, 24)
    pull = diff.T @ (1 / (1 + np.exp(diff @ model.weight))) / len(diff) - quality.DECAY * model.weight
    assert np.abs(pull).max() < 1e-3 and np.abs(model.weight).max() > 0.1


def test_training_reads_long_texts_and_one_text_of_an_id(spark):
    from erashift.llm.labelled import training_features, training_texts

    docs = spark.createDataFrame([(1, "a" * 2_000_000), (2, "first"), (2, "second"), (2, "first"), (3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 2, 3, 4)] + [(4, 1), (None, 1)], "doc_id long, toxic int")
    got = training_features(training_texts(docs, labels, "toxic", lambda i: i > 0, 100), lambda t: (len(t), t[:1]), "n int, c string").collect()
    first = min(("first", "second"), key=lambda t: __import__("hashlib").sha256(t.encode()).hexdigest())
    assert sorted(tuple(r) for r in got) == [(1, 1, 2_000_000, "a"), (2, 0, len(first), first[0]), (4, 1, 0, "")]


def test_distributed_toxicity_fit_equals_the_plain_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if crc(r["doc_id"]) % 5}
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in known and r["text"] is not None)
    plain = toxicity.fit([t for _, t in rows], [known[i] for i, _ in rows])
    model = toxicity.train_toxicity(docs, labels)
    assert model.weight.keys() == plain.weight.keys() and len(model.weight)
    assert all(math.isclose(model.weight[g], w, rel_tol=0.05, abs_tol=0.05) for g, w in plain.weight.items())


def mix_brute(pairs_with_source, weights, share, most):
    import hashlib

    by = {}
    for i, source, t in pairs_with_source:
        by.setdefault(source, []).append((hashlib.md5(str(i).encode()).hexdigest(), i, len(words(t))))
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[2] for x in by[s]) for s in names}
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(size.values())
    while open_:
        unit = left / sum(w[s] for s in open_)
        over = [s for s in open_ if unit * w[s] >= most * size[s]]
        for s in over or open_:
            target[s] = most * size[s] if over else unit * w[s]
        left -= sum(most * size[s] for s in over)
        open_ = open_ - set(over) if over else set()
    queue = []
    for s in names:
        at = 0
        for copy in range(most):
            for _, i, n in sorted(by[s]):
                at += n
                if target[s] > 0:
                    queue.append((at / target[s], i, n))
    taken, total, budget = {}, 0, sum(target.values())
    queue.sort()
    for f in sorted({q[0] for q in queue}):
        tied = [q for q in queue if q[0] == f]
        total += sum(q[2] for q in tied)
        if total > budget * (1 + 1e-12):
            break
        for _, i, n in tied:
            taken[i] = taken.get(i, 0) + n
    return sorted((i, len(words(t)), round(target[s], 4), taken.get(i, 0)) for i, s, t in pairs_with_source)


def test_mixing_against_brute_force(docs, rows):
    base = [(r["doc_id"], r["source"], r["text"]) for r in docs.select("doc_id", "source", "text").collect()]
    got = [(a, b, round(c, 4), d) for a, b, c, d in rows(mixing.mix_sources(docs), "doc_id", "size", "target", "taken")]
    assert sorted(got) == mix_brute(base, mixing.WEIGHTS, mixing.BUDGET_SHARE, mixing.MOST_REPEATS)


def test_mixing_odd_rows(odd, empty, spark):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 7 and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix_sources(empty).count() == 0
    wordless = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(r["target"], r["taken"]) for r in mixing.mix_sources(wordless).collect()] == [(0.0, 0)] * 2


def test_pipeline_mix_takes_rows_not_ids(spark):
    from collections import Counter

    table = [(i, f"text number {k} " + "word " * (k % 5), s) for i in (None, 7) for k in range(30) for s in ("a", "b")]
    table += [(None, "one and the same row", "c")] * 5 + [(k, f"other text {k}", "c") for k in range(10, 30)]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3).cache()
    got = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert not {tuple(r) for r in got} - set(table)
    assert all(n <= 2 * table.count(r) for r, n in Counter(tuple(r) for r in got).items())
    words_of, want = Counter(), Counter()
    for r in got:
        words_of[r["source"]] += len(words(r["text"]))
    for r in mixing.mix_sources(docs).collect():
        want[r["source"]] += r["taken"]
    assert words_of == want


def test_sharding_laws(docs, pairs, odd, empty):
    got = sharding.assign_shards(docs, 16).collect()
    by_id = dict(pairs)
    assert sorted(r["doc_id"] for r in got) == [i for i, _ in pairs]
    for r in got:
        raw = (by_id[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "key"
        assert 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.limit(10), 16).collect()}
    assert all(by == next(r["shard"] for r in got if r["doc_id"] == i) for i, by in again.items())
    assert sharding.assign_shards(odd).count() == 7 and sharding.assign_shards(empty).count() == 0
    assert {r["shard"] for r in sharding.assign_shards(docs, 1).collect()} == {0}


def test_sharding_follows_weights_and_moves_few(spark):
    from pyspark.sql import functions as F

    keys = spark.range(20_000).withColumnRenamed("id", "k")
    got = keys.select(sharding.rendezvous_shard(F.col("k"), [1, 1, 2]).alias("a"), sharding.rendezvous_shard(F.col("k"), [1, 1, 2, 1]).alias("b"))
    share = {r["a"]: r["count"] / 20_000 for r in got.groupBy("a").count().collect()}
    assert all(math.isclose(share[s], w / 4, abs_tol=0.02) for s, w in enumerate((1, 1, 2)))
    moved = got.where("a <> b")
    assert moved.where("b <> 3").count() == 0 and math.isclose(moved.count() / 20_000, 0.2, abs_tol=0.02)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).cache()
        old = {r["doc_id"]: r["text"] for r in before.collect()}
        new = [r["doc_id"] for r in after.collect()]
        if name != "sharding":
            assert after.columns == docs.columns
        if name == "near_dedup":
            from test_dedup import near_brute
            assert sorted(new) == [i for i, _, _, kept in near_brute(sorted(old.items()), 5, 80) if kept]
        elif name == "decontamination":
            bad = {p[0] for p in contained_brute(sorted(old.items()), items)}
            assert sorted(new) == sorted(set(old) - bad)
        elif name == "mixing":
            want = mix_brute([(r["doc_id"], r["source"], r["text"]) for r in before.collect()], mixing.WEIGHTS, 1.5, 2)
            assert sorted(new) == sorted(i for i, size, _, taken in want for _ in range(taken // size if size else 0))
        elif name == "sharding":
            assert sorted(new) == sorted(r["doc_id"] for r in before.collect())
        else:
            assert set(new) < set(old) and len(new) > 0.7 * len(old)
        before = after


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_random_misspellings_of_toxic_words_are_caught(spark):
    """Words that toxic texts hold far more often, each with one letter dropped, doubled or swapped at random."""
    import random

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if crc(r["doc_id"]) % 5}
    known = [(toxic[r["doc_id"]], r["text"]) for r in docs.collect() if r["doc_id"] in toxic and r["text"]]
    texts_of, share = collections.Counter(), collections.Counter()
    for y, t in known:
        for w in toxicity.words_of(t):
            texts_of[w] += 1
            share[w] += y
    rude = sorted(w for w in texts_of if len(w) >= 6 and share[w] >= 4 and share[w] / texts_of[w] > 0.8)
    assert rude
    score = toxicity.fit([t for _, t in known], [y for y, _ in known]).scorer()
    draw, judged = random.Random(5), []
    for w in rude * 5:
        i = draw.randrange(1, len(w) - 1)
        wrong = draw.choice([w[:i] + w[i + 1:], w[:i] + w[i] + w[i:], w[:i] + w[i + 1] + w[i] + w[i + 2:]])
        if wrong not in texts_of:
            judged.append(score(wrong) > 0.5)
    assert len(judged) >= 20 and sum(judged) / len(judged) > 0.9
