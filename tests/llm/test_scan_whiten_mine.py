"""License scans, embedding whitening and hard negatives."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from erashift.llm import hard_negatives, licenses, whitening

NOTICE = dict(licenses.NOTICES)
SMALL = (("mit", "Released under the MIT License"), ("own", "alpha beta gamma delta epsilon zeta"), ("own", "alpha beta gamma one two"), ("none", "...!"))


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def scan_brute(rows, templates, pct=80):
    out = []
    for i, text in rows:
        w = words_of(text)
        places = {}
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            places |= {at: label for at in range(len(w)) if w[at:at + len(p)] == p}
        labels, most = set(places.values()), 0.0
        for label, notice in templates:
            n = words_of(notice)
            h = licenses.size_class(len(n)) if n else 1
            for at in range(0, len(w) if n else 0, h):
                share = len(set(n) & set(w[at:at + 2 * h])) / len(set(n))
                if 100 * share >= pct - 1e-9:
                    labels, most = labels | {label}, max(most, share)
        out.append((i, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(set(places.values()))),
                    ",".join(sorted(labels)), 1.0 if places else round(most, 9)))
    return sorted(out, key=repr)


def license_rows():
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["the", "of", "and", "lorem", "ipsum", "any", "copy", "a", "dolor"]) for _ in range(n))
    out = [None, "", " .,!\n", "MIT License", "x MIT\nLicense mit-license y general Public\tLICENSE", "mit license mit license license",
           "the apache  license, mit", "generalpublic license", "CommİT license", "é mit license é", "ONE two alpha gamma beta", "alpha beta gamma one",
           "alpha beta gamma delta epsilon", "alpha beta gamma delta", "zeta epsilon\n* delta\n* gamma\n* beta\n* alpha"]
    for name in ("mit", "bsd", "gpl", "apache", "mpl", "isc"):
        w = NOTICE[name].split()
        out += [f"{filler(rng.randint(0, 300))} {NOTICE[name]} {filler(rng.randint(0, 300))}", " ".join(w[: len(w) * 9 // 10]), " ".join(w[: len(w) // 2]),
                "\n # ".join(w).upper(), " ".join(rng.sample(w, len(w)))]
    out += [filler(40_000) + " mit license " + filler(40_000) + " " + NOTICE["unlicense"], filler(5_000)]
    out += [filler(rng.randint(1, 200)) for _ in range(20)]
    return [(i + 50, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("templates", [licenses.NOTICES, SMALL, ()])
def test_license_scan_against_brute_force(spark, rows, templates):
    table = license_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in table], "doc_id long, text string, digest string, block int").repartition(3)
    got = rows(licenses.scan_licenses(docs, templates))
    assert got == scan_brute(table, templates)
    if templates:
        assert sum(1 for r in got if r[6] and not r[5]) > 3


def test_license_scan_odd_rows(spark, rows, empty):
    table = [(7, "MIT license"), (7, "MIT license"), (7, NOTICE["bsd"]), (None, NOTICE["bsd"]), (None, NOTICE["gpl"]), (None, None), (None, ""), (3, "x")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    assert rows(licenses.scan_licenses(docs)) == scan_brute(table, licenses.NOTICES)
    assert licenses.scan_licenses(empty).count() == 0


def test_prefix_words_are_the_rarest(spark):
    docs = spark.createDataFrame([(1, "alpha alpha beta"), (2, "ALPHA"), (3, None)], "doc_id long, text string")
    assert licenses.document_counts(docs, ["alpha", "beta", "gamma"]) == {"alpha": 2, "beta": 1}


def vectors_of(spark, table, schema="vec_id long, embedding array<float>, label int, x int, n string, score long"):
    return spark.createDataFrame([(*r, 1, "n", 2) for r in table], schema).repartition(3)


@pytest.fixture(scope="module")
def vector_table():
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.2, (400, 24)) @ np.diag(np.linspace(1, 3, 24))
    table = [(i, [float(np.float32(v)) for v in row], int(rng.integers(0, 4))) for i, row in enumerate(base)]
    table += [(1000 + i, table[5][1], 1) for i in range(200)]  # a third of all rows
    nan, inf = float("nan"), float("inf")
    table += [(2000, None, 1), (2001, [nan] + [0.1] * 23, 1), (2002, [inf] + [0.1] * 23, 1), (2003, [None] + [0.1] * 23, 1), (2004, [0.1, 0.2], 2),
              (2005, [], 2), (None, table[9][1], 0), (2100, table[9][1], None), (300, table[11][1], 0), (2200, [0.0] * 24, 3), (5, table[5][1], 1)]
    return table


def whole(vector, scale=64, offset=1_000_000):
    return [math.floor(scale * c) + offset for c in vector]


def usable(table, dim):
    return [(i, whole(v)) for i, v, _ in table if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]


def test_whitening_against_numpy(spark, vector_table):
    good = usable(vector_table, 24)
    fit = sorted({tuple(x) for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums) / n
    cov = centred.T @ centred / n
    value = np.linalg.eigvalsh(cov)[::-1]
    got = whitening.whiten(vectors_of(spark, vector_table)).collect()
    assert len(got) == 16 * len(good) and {r["n"] for r in got} == {n} and {r["component"] for r in got} == set(range(1, 17))
    want = {}
    for i, x in good:
        want.setdefault(i, set()).add(sum((n * a - s)**2 for a, s in zip(x, sums)))
    assert all(r["deviation"] in want[r["vec_id"]] for r in got)
    for k in range(16):
        assert math.isclose(next(r["explained"] for r in got if r["component"] == k + 1), value[k] / np.trace(cov), rel_tol=1e-9)
    white = {}
    for r in got:
        white.setdefault((r["vec_id"], r["deviation"]), {})[r["component"]] = r["whitened"]
    once = {tuple(x): (i, sum((n * a - s)**2 for a, s in zip(x, sums))) for i, x in good}
    w = np.array([[white[once[x]][k] for k in range(1, 17)] for x in fit])
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-9 and {r["identity_error"] for r in got} == {got[0]["identity_error"]}
    assert got[0]["identity_error"] < 1e-12
    vector = np.linalg.lstsq(centred, w, rcond=None)[0]  # the projection, up to its scale, is an eigenvector
    for k in range(16):
        assert np.abs(cov @ vector[:, k] - value[k] * vector[:, k]).max() < 1e-8


def test_whitening_does_not_depend_on_the_split(spark, vector_table, rows):
    v = vectors_of(spark, vector_table)
    assert rows(whitening.whiten(v), digits=17) == rows(whitening.whiten(v.repartition(7)), digits=17)


def test_whitening_few_directions_and_empty(spark):
    line = spark.createDataFrame([(i, [i / 64, 2 * i / 64, 0.5]) for i in range(5)], "vec_id long, embedding array<double>")
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 5 and math.isclose(got[0]["explained"], 1.0)
    assert math.isclose(sum(r["whitened"]**2 for r in got) / 5, 1.0)
    alike = spark.createDataFrame([(i, [0.5, 0.25]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(alike).count() == 0
    assert whitening.whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 0
    far = spark.createDataFrame([(1, [4e5, 0.0]), (2, [-4e5, 1.0]), (3, [0.0, 2.0]), (4, [1e30, 0.0])], "vec_id long, embedding array<double>")
    assert {r["vec_id"] for r in whitening.whiten(far).collect()} == {1, 2, 3}


@pytest.mark.parametrize("values", [[9, 9, 9, 4, 4, 1, 0, 0], [1, 1 + 1e-9, 1 + 2e-9, 0.5, 0.5 + 1e-13, 1e-3, 1e-6, 1e-9], [5] * 8, [3, 1e-7, 1e-7, 0, 0, 0, 0, 0]])
def test_refinement_of_clustered_eigenvalues(values):
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.normal(size=(8, 8)))[0].astype(np.longdouble)
    for _ in range(5):  # orthonormal in extended precision
        q = q + q @ (np.eye(8) - q.T @ q) / 2
    a = q @ np.diag(np.array(values, np.longdouble)) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.refined_eigen(a)
    assert np.abs(got - np.sort(np.array(values, np.longdouble))[::-1]).max() < 1e-16 * max(values)
    assert np.abs(x.T @ x - np.eye(8)).max() < 1e-15 and np.abs(a @ x - x * got).max() < 2e-16 * max(values)


def test_refinement_reaches_double_precision():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(64, 64))
    a = m @ m.T
    value, x = whitening.refined_eigen(a)
    exact = np.linalg.eigh(a)
    assert np.abs(a @ x - x * value).max() < 1e-16 * float(value[0]) and np.allclose(value.astype(float), exact[0][::-1], rtol=1e-12)


def mine_brute(table, is_anchor, relabel):
    good = [(i, relabel(i, y), [math.floor(256 * c) for c in v]) for i, v, y in table
            if i is not None and y is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, label, x in dict.fromkeys((i, y, tuple(v)) for i, y, v in good if is_anchor(i)):
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, y) for i, y, v in good)
        for s, i, _ in [r for r in scored if r[2] == label and r[1] != a][:5]:
            inside = [(t, j) for t, j, y in scored if y != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside)]
    return sorted(out)


@pytest.mark.parametrize("block, cells", [(4096, 1 << 20), (40, 300)])
def test_hard_negatives_against_brute_force(spark, vector_table, rows, monkeypatch, block, cells):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)  # several blocks of anchors and rows
    monkeypatch.setattr(hard_negatives, "CELLS", cells)
    vectors = vectors_of(spark, vector_table)
    got = rows(hard_negatives.mine_hard_negatives(vectors, vectors["vec_id"] % 10 == 0, F.when(vectors["vec_id"] % 7 == 0, (vectors["label"] + 1) % 10)
                                                  .otherwise(vectors["label"])))
    want = mine_brute(vector_table, lambda i: i % 10 == 0, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert sorted(got) == want and len(want) > 500


def test_hard_negatives_of_many_equal_rows(spark, rows):
    table = [(i, [1.0, 0.5], i % 2) for i in range(60)] + [(i, [0.9, 0.5], i % 2) for i in range(60, 70)] + [(100, [-1.0, 0.0], 0), (4, [1.0, 0.5], 0)]
    vectors = vectors_of(spark, table)
    got = rows(hard_negatives.mine_hard_negatives(vectors, vectors["vec_id"] % 10 == 0, vectors["label"]))
    assert sorted(got) == mine_brute(table, lambda i: i % 10 == 0, lambda i, y: y)


def test_hard_negatives_of_huge_entries_and_empty_tables(spark, rows):
    table = [(i, [1e12 * (i % 5 + 1), -3.5e11 * (i % 3)], i % 2) for i in range(20)]
    vectors = vectors_of(spark, table, "vec_id long, embedding array<double>, label int, x int, n string, score long")
    got = hard_negatives.mine_hard_negatives(vectors, vectors["vec_id"] % 10 == 0, vectors["label"])
    assert got.count() > 0  # scores beyond a long stop at 2^62
    fits = [(i, [3e4 * (i % 5 + 1), -3.5e3 * (i % 3)], i % 2) for i in range(20)]
    vectors = vectors_of(spark, fits, "vec_id long, embedding array<double>, label int, x int, n string, score long")
    assert sorted(rows(hard_negatives.mine_hard_negatives(vectors, vectors["vec_id"] % 10 == 0, vectors["label"]))) == mine_brute(fits, lambda i: i % 10 == 0, lambda i, y: y)
    none = vectors.limit(0)
    assert hard_negatives.mine_hard_negatives(none, none["vec_id"] % 10 == 0, none["label"]).count() == 0
    assert hard_negatives.mine_hard_negatives(vectors, vectors["vec_id"] < 0, vectors["label"]).count() == 0


def test_packed_keys_sort_as_their_parts():
    rng = random.Random(8)
    parts = [(rng.choice([-5, 0, 7, 2**62]), rng.choice([-3, 0, 2**63 - 1, -2**63]), rng.choice([-2**62 + 1, -1, 0, 1, 2**62 - 1]), rng.choice([0, 1]),
              rng.choice([-2**63, -1, 0, 2**63 - 1])) for _ in range(300)]
    keys = [hard_negatives.pack(*(np.array([v]) for v in p[:3]), p[3], np.array([p[4]])) for p in parts]
    import pyarrow as pa
    back = hard_negatives.unpack(pa.concat_arrays(keys))
    assert [tuple(int(c[k]) for c in back) for k in range(len(parts))] == parts
    order = sorted(range(len(parts)), key=lambda k: keys[k][0].as_py())
    assert [parts[k] for k in order] == sorted(parts, key=lambda p: (p[0], p[1] % 2**64, -p[2], p[3], p[4]))
