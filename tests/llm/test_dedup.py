"""The deduplicating operators against brute force."""

import pytest
from brute import SPACE, ascii_lower, sha, words

from erashift.llm import exact_dedup, line_dedup, near_dedup, substring_dedup, suffix_dedup


def test_exact_against_brute_force(docs, pairs, rows):
    groups = {}
    for i, t in pairs:
        groups.setdefault(ascii_lower(t), []).append(i)
    want = sorted((i, max(g), len(g), i == max(g), sha(t.encode())) for t, g in groups.items() for i in g)
    cols = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(rows(exact_dedup.exact_dedup(docs), *cols)) == want
    assert sorted(rows(exact_dedup.exact_dedup(docs, table_bytes=500), *cols)) == want  # texts larger than a table


def test_exact_levels_grow_with_the_logarithm(spark, rows, monkeypatch):
    made = []
    fresh = exact_dedup.session.fresh_dir
    monkeypatch.setattr(exact_dedup.session, "fresh_dir", lambda s, name: made.append(name) or fresh(s, name))
    depth = []
    resolve = exact_dedup._resolve
    monkeypatch.setattr(exact_dedup, "_resolve", lambda limit: depth.append(1) or resolve(limit))
    for n in (50, 200, 800):  # one step each, however many texts
        depth.clear()
        docs = spark.range(n * 2).selectExpr("id as doc_id", f"lpad(cast(id % {n} as string), 100, 'x') as text")
        got = exact_dedup.exact_groups(docs, table_bytes=8_000)
        assert (got.count(), got.where("group_size = 2").count(), got.where(f"keep_id >= {n}").count()) == (n, n, n)
        assert len(depth) <= 2
    made.clear()
    got = exact_dedup.exact_groups(docs, table_bytes=20_000, max_buckets=8)  # spill files first, then each on its own
    assert (got.count(), got.where("group_size = 2").count()) == (800, 800)
    assert any(name.startswith("grace-parts") for name in made)
    copies = spark.range(300).selectExpr("id as doc_id", "repeat('y', 5000) as text")
    got = exact_dedup.exact_groups(copies, table_bytes=500, max_buckets=2)
    assert [tuple(r) for r in got.select("keep_id", "group_size").collect()] == [(299, 300)]


def test_exact_compares_whole_content():
    table = exact_dedup.ContentTable(1 << 20)
    assert table.add("0" * 64, b"one", 1, 1) and table.add("0" * 64, b"two", 2, 1) and table.add("0" * 64, b"one", 5, 1)
    assert [(r[1], r[2], r[3]) for r in table.rows] == [(b"one", 5, 2), (b"two", 2, 1)]


def test_exact_odd_rows(odd, empty, rows):
    got = rows(exact_dedup.exact_dedup(odd), "doc_id", "keep_id", "group_size", "kept")
    assert got == sorted([(7, 7, 3, True), (7, 7, 3, True), (None, 7, 3, False), (None, None, 1, False), (None, 9, 3, False), (9, 9, 3, True), (3, 9, 3, False)], key=repr)
    assert exact_dedup.exact_dedup(empty).count() == 0


def near_brute(pairs, k, pct):
    sets, parent = {}, {}
    for i, t in pairs:
        w = words(ascii_lower(t))
        sets[i] = ({tuple(w[a:a + k]) for a in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, _ in pairs:
        for b, _ in pairs:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i, _ in pairs)


@pytest.mark.parametrize("k, pct", [(3, 85), (5, 80)])
def test_near_against_brute_force(docs, pairs, rows, k, pct):
    got = sorted(rows(near_dedup.near_components(docs, k, pct), "doc_id", "n_shingles", "component_id", "kept"))
    assert got == near_brute(pairs, k, pct)


def test_near_odd_rows(odd, empty, rows):
    got = rows(near_dedup.near_components(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted([(7, 3, 7, True), (7, 3, 7, True), (None, 3, 7, False), (None, 1, None, True), (None, 0, None, True), (9, 0, 9, True), (3, 0, 3, True)], key=repr)
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert rows(kept, "doc_id", "text") == sorted([(7, "a b c d e f g"), (None, "quite another text, this one"), (None, None), (9, None), (3, "")], key=repr)
    assert near_dedup.near_components(empty).count() == 0 and near_dedup.drop_near_copies(empty).count() == 0


def test_near_several_texts_under_one_id(spark, texts, rows):
    """Every row is linked by its own text, though ids repeat and many rows have none."""
    a, b = texts[8], texts[27] + " tail words here to make it long enough"
    near = lambda t: t + " appended"
    given = [(0, a), (1, near(a)), (1, b), (2, near(b)), (3, a), (3, near(b) + " again"), (None, a), (None, near(b)), (None, "clean " * 9), (5, b), (5, b)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = rows(near_dedup.near_components(docs), "doc_id", "component_id", "kept")
    assert got == sorted([(0, 0, True), (1, 0, False), (1, 1, True), (2, 1, False), (3, 0, False), (3, 1, False), (None, 0, False), (None, 1, False),
                          (None, None, True), (5, 1, False), (5, 1, False)], key=repr)
    assert rows(near_dedup.drop_near_copies(docs)) == sorted([(0, a), (1, b), (None, "clean " * 9)], key=repr)
    twice = spark.createDataFrame([(4, a), (4, near(a)), (4, "other " * 9)], docs.schema)
    assert near_dedup.drop_near_copies(twice).count() == 2  # near copies under one id: one of them stays


def test_bands_keep_the_promised_miss_rate():
    for pct in (80, 85):
        bands, rows = near_dedup.shape(pct)
        assert (1 - (pct / 100) ** rows) ** bands <= near_dedup.MISS


def test_sketches_never_overstate_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for size in (3, 300, 20_000):
        a = rng.integers(0, 2**64, size, dtype=np.uint64)
        b = np.concatenate([a[size // 5:], rng.integers(0, 2**64, size // 6, dtype=np.uint64)])
        x, y = near_dedup.parity_sketch(a).view(np.uint64), near_dedup.parity_sketch(b).view(np.uint64)
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def substring_brute(pairs):
    first, out = {}, []
    for i, t in pairs:
        w = words(t)
        for a in range(len(w) - 49):
            first.setdefault(tuple(w[a:a + 50]), i)
    for i, t in pairs:
        w = words(t)
        gone = {a + j for a in range(len(w) - 49) if first[tuple(w[a:a + 50])] < i for j in range(50)}
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        out.append((i, len(w), len(gone), sha(kept.encode())))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_units": 200}, {"max_variants": 1, "shard_units": 200}])
def test_substring_against_brute_force(docs, pairs, rows, sizes):
    got = rows(substring_dedup.substring_dedup(docs, **sizes), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(got) == substring_brute(pairs)


def suffix_brute(pairs):
    seen, out = set(), []
    for i, t in pairs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - 99):
            if raw[a:a + 100] in seen:
                gone[a:a + 100] = b"\1" * 100
            seen.add(raw[a:a + 100])
        spans = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        out.append((i, len(raw), sum(gone), spans, sha(bytes(c for c, g in zip(raw, gone) if not g))))
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_units": 500}, {"max_variants": 1, "shard_units": 500}])
def test_suffix_against_brute_force(docs, pairs, rows, sizes):
    got = rows(suffix_dedup.suffix_dedup(docs, **sizes), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(got) == suffix_brute(pairs)


def test_substring_and_suffix_odd_rows(odd, empty):
    for op in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup):
        got = op(odd)
        assert got.count() == 7 and got.where("n_removed > 0").count() == 0
        assert op(empty).count() == 0


def _shared_ids(spark):
    """Long rows without an id or with one in common: texts of their own, parts of smaller ids, and parts of each other."""
    import random

    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
    old, both, passage = prose(70), prose(65), prose(60)
    rows = [(1, f"{prose(90)} {old}"), (2, prose(130))]
    for i in (None, 5):
        rows += [(i, f"{prose(10 * k)} {old if k % 2 else prose(70)} {prose(60)} {both} {prose(k)}") for k in range(4)]
        rows += [(i, f"{prose(20)} {passage} {prose(7)} {passage} {prose(60)} {both}"), (i, prose(140)), (i, prose(140))]
        rows += [rows[-1]] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def _shared_brute(rows, units, window):
    """Removed units of each row: covered by windows of smaller ids or, where window positions count, further left."""
    first, out = {}, []
    rank = lambda i: (i is None, i or 0)
    for i, t in rows:
        u = units(t)
        for a in range(len(u) - window + 1):
            w = tuple(u[a:a + window])
            first[w] = min(first.get(w, rank(i)), rank(i))
    for i, t in rows:
        u, own, gone = units(t), set(), set()
        for a in range(len(u) - window + 1):
            w = tuple(u[a:a + window])
            if first[w] < rank(i) or window == 100 and w in own:
                gone.update(range(a, a + window))
            own.add(w)
        kept = [x for a, x in enumerate(u) if a not in gone]
        out.append((i, len(u), len(gone), sha(bytes(kept) if window == 100 else " ".join(kept).encode())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [{}, {"max_variants": 1, "shard_units": 200}])
def test_substring_and_suffix_rows_that_share_an_id(spark, rows, sizes):
    given, table = _shared_ids(spark)
    got = rows(substring_dedup.substring_dedup(table, **sizes), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == _shared_brute(given, words, 50)
    got = rows(suffix_dedup.suffix_dedup(table, **sizes), "doc_id", "n_bytes", "n_removed", "kept_sha256")
    assert got == _shared_brute(given, lambda t: t.encode(), 100)


def test_suffix_array_against_sorting():
    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(500):
        t = rng.integers(1, int(rng.integers(2, 6)), int(rng.integers(0, 40)))
        assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


def line_brute(pairs):
    def key(line):
        return ascii_lower(line.strip(SPACE))

    holders, out = {}, []
    for i, t in pairs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    for i, t in pairs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


@pytest.mark.parametrize("bits", [1 << 30, 1 << 16])
def test_lines_against_brute_force(docs, pairs, rows, bits):
    got = rows(line_dedup.line_dedup(docs, max_bits=bits), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(got) == line_brute(pairs)


def test_lines_with_a_full_filter(docs, pairs, rows, monkeypatch):
    import numpy as np

    monkeypatch.setattr(line_dedup, "repeat_filter", lambda d, m: np.full(1 << 10, 255, np.uint8))
    got = rows(line_dedup.line_dedup(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256")
    assert sorted(got) == line_brute(pairs)


def test_lines_odd_rows(odd, empty):
    assert line_dedup.line_dedup(odd).where("n_dropped = 0").count() == 6  # one of the NULL ids repeats the line of 7
    assert line_dedup.line_dedup(empty).count() == 0


def test_lines_of_many_rows_without_ids(spark, rows):
    shared = [f"a shared line with number {i}" for i in range(20)]
    given = [(1, "\n".join(shared))] + [(None, f"{shared[i % 20]}\nmy own line, number {i}\n{shared[(i + 3) % 20]}") for i in range(60)]
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = line_dedup.line_dedup(docs)
    assert rows(got, "doc_id", "n_lines", "n_dropped") == sorted([(1, 20, 0)] + [(None, 3, 2)] * 60, key=repr)
    assert sorted(r[0] for r in got.where("doc_id is null").select("kept_text").collect()) == sorted(f"my own line, number {i}" for i in range(60))


def test_substring_and_suffix_leave_no_shuffles_or_steps(docs, spark, tmp_path, monkeypatch):
    """Of all steps the disk holds the table of spans, and no shuffle files, when the texts are joined with it."""
    from erashift import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shuffles = lambda: {b.toString() for b in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        env.blockManager().diskBlockManager().getAllBlocks()) if b.toString().startswith("shuffle_") and b.toString().endswith(".data")}
    for op in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup):
        before = shuffles()
        op(docs)
        left = shuffles() - before
        assert len(left) <= 24, left  # those of the Bloom filter and of counts
        assert [p.name.rpartition("-")[0] for p in tmp_path.iterdir()] == ["spans-by-row"]
        for p in tmp_path.iterdir():
            p.rename(tmp_path.parent / p.name)
