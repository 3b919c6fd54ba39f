"""Near-duplicate detection by MinHash, banding, verification and connected components.

Rows with equal shingle sets are one class, so exact copies cost one row each. Classes
that share a band of minima are candidates. They are not paired all with all: first
every class is compared with the most central class of each of its buckets (linear in
the bucket), and components are formed. Only classes of different components that
still share a bucket are paired, and of these only pairs that can reach the threshold
when the shingles that no other such class has are set aside, and whose parity sketches
do not already differ in more bits than their sets may differ in shingles. A pair must
agree in its signature, within five standard errors, and is then confirmed on the full
sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import mix, stored, texts, window_hashes, word_hashes
from erashift.llm.components import components

ROWS_PER_BAND = 7
MISS = 1e-6                 # chance that a pair just at the threshold shares no band
BROADCAST_ROWS = 1_000_000  # of two or three numbers
NAMELESS = 2**62            # keys from here on stand for rows without a doc_id
_SKETCH_BITS = 4096
_SETS = 500_000             # shingle hashes times minima worked on at once


def document_key(doc_id: Column, text: Column) -> Column:
    """The doc_id; a row without one is known by its text and comes after all others."""
    nameless = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(text), 2)
    return F.coalesce(doc_id.cast("long"), nameless)


def shape(threshold_pct: int) -> tuple[int, int]:
    """Bands and rows per band for the allowed miss rate."""
    per_band = (threshold_pct / 100) ** ROWS_PER_BAND
    return math.ceil(math.log(MISS) / math.log1p(-per_band)), ROWS_PER_BAND


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted different hashes of k-word shingles, A-Z in lower case; of fewer words the whole sequence."""
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    if len(h) < k:
        return mix(window_hashes(h, len(h)) + np.uint64(len(h)))
    return np.unique(window_hashes(h, k))


def _coefficients(n: int):
    rng = np.random.default_rng(97)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**64, n, dtype=np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash a * x + b (upper 32 bits) over the set."""
    out = np.full(len(a), np.uint32(2**32 - 1))
    step = max(1, _SETS // len(a))
    for i in range(0, len(s), step):
        out = np.minimum(out, ((a[:, None] * s[None, i:i + step] + b[:, None]) >> np.uint64(32)).min(1).astype(np.uint32))
    return out


_SIGNED = "doc long, body long, n long, set_a long, set_b long, bands array<long>, signature binary"


def _sign(k: int, bands: int, rows: int):
    def run(batches):
        a, b = _coefficients(bands * rows)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            out = []
            for doc, body, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                s = shingle_set(text, k)
                if not len(s):
                    out.append((doc, body, 0, 0, 0, None, None))
                    continue
                m = minima(s, a, b)
                key = salt.copy()
                for part in m.reshape(bands, rows).T:
                    key = mix(key + part.astype(np.uint64))
                out.append((doc, body, len(s), *_set_hash(s), key.view(np.int64).tolist(), m.astype(np.uint8).tobytes()))
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                *[pa.int64()] * 5, pa.list_(pa.int64()), pa.binary()))],
                names=["doc", "body", "n", "set_a", "set_b", "bands", "signature"])

    return run


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    one = mix(s).sum(dtype=np.uint64)
    two = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return int(one.view(np.int64)), int(two.view(np.int64))


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """4096 bits, each the parity of the elements that hash to it.

    Sketches of two sets differ in at most as many bits as the sets in elements.
    """
    bits = np.bincount((s >> np.uint64(52)).astype(np.int64), minlength=_SKETCH_BITS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketch_distance(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _full_sets(k: int):
    """Of the rows given with their class's set hash: the set itself and its sketch."""
    def run(batches):
        for b in batches:
            node, data, sketch = [], [], []
            for key, text, one, two in zip(*(b.column(i).to_pylist() for i in range(4))):
                s = shingle_set(text, k)
                if _set_hash(s) == (one, two):
                    node.append(key)
                    data.append(s.tobytes())
                    sketch.append(parity_sketch(s).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary()), pa.array(sketch, pa.list_(pa.int64()))],
                                             names=["node", "set", "sketch"])

    return run


def _agree(batches, floor: float):
    """Keep pairs whose signatures agree often enough (equal low bytes, less those equal by chance)."""
    for b in batches:
        a, c = (b.column(i).to_pylist() for i in (2, 3))
        same = np.array([np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)) / len(x) for x, y in zip(a, c)])
        keep = (same - 1 / 256) / (1 - 1 / 256) >= floor
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep.astype(bool)))


def _confirm(batches, threshold_pct: int):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= threshold_pct * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """(u, v, value of u, value of v) for pairs (u, v)."""
    left = table.select(F.col("node").alias("_u"), F.col(value).alias("_a"))
    right = table.select(F.col("node").alias("_v"), F.col(value).alias("_b"))
    return pairs.join(left, F.col("u") == F.col("_u")).join(right, F.col("v") == F.col("_v")).select("u", "v", "_a", "_b")


def _shingles(batches):
    for b in batches:
        sets = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
        node = np.repeat(np.array(b.column(0).to_pylist(), np.int64), [len(s) for s in sets])
        every = np.concatenate(sets) if sets else np.empty(0, np.int64)
        for i in range(0, len(every), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(node[i:i + (1 << 18)]), pa.array(every[i:i + (1 << 18)])], names=["node", "shingle"])


def _links(pairs: DataFrame, classes: DataFrame, sets: DataFrame, threshold_pct: int, size: int) -> DataFrame:
    t = threshold_pct / 100
    floor = t - 5 * math.sqrt(t * (1 - t) / size)
    alike = _beside(pairs, classes, "signature").mapInArrow(lambda it: _agree(it, floor), "u long, v long")
    return _beside(alike, sets, "set").mapInArrow(lambda it: _confirm(it, threshold_pct), "u long, v long")


def _keyed_components(docs: DataFrame, k: int, threshold_pct: int) -> DataFrame:
    """(doc, body, n, component) for every row of (doc, text).

    body is a hash of the text: rows that share an id are told apart by it. component
    is the smallest (doc, body) reachable. Classes are known by a hash of their set,
    whatever ids their rows have.
    """
    bands, rows = shape(threshold_pct)
    docs = docs.select("doc", F.xxhash64("text").alias("body"), "text")
    signed = stored(docs.mapInArrow(_sign(k, bands, rows), _SIGNED), "signed")
    same = ["n", "set_a", "set_b"]
    classes = stored(signed.where("n > 0").groupBy(*same).agg(F.min(F.struct("doc", "body", "bands", "signature")).alias("c")).select(
        F.xxhash64(*same).alias("node"), *same, F.struct("c.doc", "c.body").alias("first"), "c.bands", "c.signature"), "classes")

    slots = classes.select("node", "n", F.explode("bands").alias("key"))
    full = slots.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("key", "_key")
    buckets = stored(slots.join(full, F.col("key") == F.col("_key")).select("key", "node", "n", "size"), "buckets")
    members = stored(buckets.groupBy("node").agg(F.sum("size").alias("central")).withColumnRenamed("node", "_node"), "members")
    n_members = members.count()

    def sized(df, n):
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    wanted = classes.select("node", "set_a", "set_b", F.col("first.doc").alias("_doc"), F.col("first.body").alias("_body")).join(sized(members, n_members), F.col("node") == F.col("_node"), "left_semi")
    wanted = sized(wanted, n_members)
    sets = stored(docs.join(wanted, (F.col("doc") == F.col("_doc")) & (F.col("body") == F.col("_body"))).select("node", "text", "set_a", "set_b").mapInArrow(
        _full_sets(k), "node long, set binary, sketch array<long>").dropDuplicates(["node"]), "sets")
    fits = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * threshold_pct

    ranked = buckets.join(sized(members, n_members), F.col("node") == F.col("_node")).select("key", "node", "n", "central")
    pivots = ranked.groupBy(F.col("key").alias("key2")).agg(F.min(F.struct(-F.col("central"), "node", "n")).alias("p")).select(
        "key2", F.col("p.node").alias("node2"), F.col("p.n").alias("n2"))
    stars = buckets.join(pivots, (F.col("key") == F.col("key2")) & (F.col("node") != F.col("node2")) & fits).select(
        F.col("node").alias("u"), F.col("node2").alias("v")).distinct()
    links = stored(_links(stars, classes, sets, threshold_pct, bands * rows), "star-links")
    labels = components(links)

    label = F.coalesce(F.col("v"), F.col("node"))
    placed = stored(buckets.join(labels, F.col("node") == F.col("u"), "left").select("key", "node", "n", label.alias("label")), "placed")
    mixed = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("key").alias("_key"))
    open_ = stored(placed.join(mixed, F.col("key") == F.col("_key"), "left_semi"), "open")
    open_sets = sets.select("node", "set").join(open_.select(F.col("node").alias("_node")).distinct(), F.col("node") == F.col("_node"), "left_semi")
    own = (open_sets.mapInArrow(_shingles, "node long, shingle long").groupBy("shingle")
           .agg(F.count("*").alias("c"), F.min("node").alias("_own")).where("c = 1").groupBy("_own").agg(F.count("*").alias("own")))
    left = open_.join(own, F.col("node") == F.col("_own"), "left").select(
        "key", "node", "n", "label", (F.col("n") - F.coalesce("own", F.lit(0))).alias("common"))
    left = left.where(F.col("common") * 100 >= F.col("n") * threshold_pct)
    sketches = sets.select(F.col("node").alias("_node"), "sketch")
    left = stored(left.join(sketches, F.col("node") == F.col("_node")).drop("_node"), "left")
    other = left.select(*[F.col(c).alias(c + "2") for c in left.columns])
    reach = F.least("common", "common2")  # of the intersection
    rest = left.join(other, (F.col("key") == F.col("key2")) & (F.col("node") < F.col("node2")) & (F.col("label") != F.col("label2")) & fits
                     & (reach * (100 + threshold_pct) >= (F.col("n") + F.col("n2")) * threshold_pct)
                     & (_sketch_distance("sketch", "sketch2") * (100 + threshold_pct) <= (F.col("n") + F.col("n2")) * (100 - threshold_pct))).select(
        F.col("node").alias("u"), F.col("node2").alias("v")).distinct()
    more = stored(_links(rest, classes, sets, threshold_pct, bands * rows), "more-links")
    if not more.isEmpty():
        labels = components(labels.unionByName(more))

    linked = labels.unionByName(labels.select(F.col("v").alias("u"), "v").distinct()).distinct()
    linked = linked.join(classes.select("node", "first"), F.col("u") == F.col("node")).select("u", "v", "first")
    least = linked.groupBy(F.col("v").alias("_v")).agg(F.min("first").alias("least"))
    named = linked.join(least, F.col("v") == F.col("_v")).select("u", "least")
    placed = classes.join(named, F.col("node") == F.col("u"), "left").select(
        *[F.col(c).alias("_" + c) for c in same], F.coalesce("least", "first").alias("component"))
    found = signed.select("doc", "body", *same).join(placed, [F.col(c) == F.col("_" + c) for c in same], "left")
    return found.select("doc", "body", "n", F.coalesce("component", F.struct("doc", "body")).alias("component"))


def near_components(docs: DataFrame, k: int = 5, threshold_pct: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Every row with doc_id, n_shingles, component_id, kept.

    Rows are linked if their sets of k-word shingles have a Jaccard similarity of at
    least threshold_pct; component_id is the smallest doc_id reachable. NULL, empty
    and blank texts have no shingles and stay alone. Rows without a doc_id come after
    all others and have a NULL component_id among themselves; repeated rows share a
    component. Rows that share a doc_id but not their text are linked each by its own
    text, so one of them can be kept and another not.
    """
    rows = texts(docs, id_col, text_col)
    found = _keyed_components(rows.select(document_key(F.col("doc_id"), F.col("text")).alias("doc"), "text"), k, threshold_pct)

    def name(key):
        return F.when(F.col(key) < NAMELESS, F.col(key))

    return found.select(name("doc").alias("doc_id"), F.col("n").alias("n_shingles"), name("component.doc").alias("component_id"),
                        (F.col("component.doc") == F.col("doc")).alias("kept"))


def drop_near_copies(docs: DataFrame, k: int = 5, threshold_pct: int = 80, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """docs without the rows that are near copies of a smaller one, with all their columns.

    Rows are ordered by doc_id and, with the same doc_id, by a hash of their text; each
    is judged by its own text. Of rows equal in id and text one stays.
    """
    text = docs[text_col].cast("string")
    key, body = document_key(docs[id_col], text), F.xxhash64(text)
    found = stored(_keyed_components(docs.select(key.alias("doc"), text.alias("text")), k, threshold_pct), "near-copies")
    own = F.struct("doc", "body")
    drop = found.where(F.col("component") != own).select("doc", "body").distinct()
    again = found.where(F.col("component") == own).groupBy("doc", "body").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", "body")
    n_drop, n_again = drop.count(), again.count()
    drop = F.broadcast(drop) if n_drop <= BROADCAST_ROWS else drop
    kept = docs.join(drop, (key == drop["doc"]) & (body == drop["body"]), "left_anti")
    if not n_again:
        return kept
    again = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
    repeated = (key == again["doc"]) & (body == again["body"])
    once = kept.join(again, repeated, "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, repeated, "left_anti").unionByName(once)
