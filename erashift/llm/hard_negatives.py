"""Hard negatives by a secondary sort of packed scores.

Anchors meet all rows in blocks: each block pair is one matrix product in one task, and a block keeps of an anchor's
scores only those that can still count (its own first positives, or the first negatives inside each positive's
window), so what is shuffled grows with anchors and blocks, not with pairs. Scores travel as packed keys
(anchor, falling score, positives first, id): rows are dealt by anchor and sorted within their partition by the key,
and one pass over the sorted stream opens a window at each positive and emits the negatives that fall into it. The
state of that pass is the open windows of one anchor, never the anchor's rows.

Two such sorts are made: the first finds every anchor's positives, the second its negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import stored

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW_PCT, HIGH_PCT = 80, 100
BLOCK = 4096              # anchors, and rows, of a block pair
CELLS = 1 << 20           # scores held at a time
NONE = -(2**62)           # below every score
EXACT = 2.0**51           # sums below this are exact in doubles and leave room for a tie's place
_KEY = 33


def minable(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """vec_id, label, vec of the rows that take part."""
    c = vectors[vector_col]
    finite = F.forall(c, lambda v: v.isNotNull() & (F.abs(v.cast("double") * SCALE) < float("inf")))
    usable = vectors[id_col].isNotNull() & label.isNotNull() & c.isNotNull() & F.coalesce(finite, F.lit(False))
    kind = c if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else c.cast("array<double>")
    return vectors.where(usable).select(vectors[id_col].cast("long").alias("vec_id"), label.cast("long").alias("label"), kind.alias("vec"))


def whole_matrix(column: pa.Array) -> np.ndarray:
    """floor(SCALE * x) of each vector as doubles; shorter vectors go on with zeros."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE)
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def scores_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Whole-number inner products of the rows of a and b, and whether they are small enough for a packed order.

    Beyond the exact range of doubles the products are made from Python's integers, and kept between -2^62 and 2^62.
    """
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(dim, 1) < EXACT:
        return (a @ b.T).astype(np.int64), True
    whole = [[int(v) for v in row] for row in b.tolist()]
    out = np.empty((len(a), len(b)), np.int64)
    for i, row in enumerate(a.tolist()):
        mine = [int(v) for v in row]
        out[i] = [max(NONE + 1, min(-NONE - 1, sum(x * y for x, y in zip(mine, other)))) for other in whole]
    return out, False


def first_places(score: np.ndarray, valid: np.ndarray, k: int, small: bool) -> np.ndarray:
    """For each line the columns of its k highest valid scores, the earlier column first among equals; -1 where there are fewer."""
    n = score.shape[1]
    if small and n > k:
        order = np.where(valid, score * n + np.arange(n)[::-1], NONE)
        at = np.argpartition(order, n - k, axis=1)[:, n - k:]
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(order, at, 1), axis=1), 1)
    else:
        at = np.argsort(-np.where(valid, score, NONE), axis=1, kind="stable")[:, :k]
    at = np.where(np.take_along_axis(valid, at, 1), at, -1)
    return np.pad(at, ((0, 0), (0, k - at.shape[1])), constant_values=-1)


class Kept:
    """The first k rows of each line so far: score, id and a number that tells rows apart."""

    def __init__(self, lines: int, k: int):
        self.k = k
        self.score = np.full((lines, k), NONE, np.int64)
        self.id, self.row = np.zeros((lines, k), np.int64), np.full((lines, k), -1, np.int64)

    def add(self, score: np.ndarray, valid: np.ndarray, ids: np.ndarray, row0: int, small: bool) -> None:
        """ids are ascending."""
        lines = np.flatnonzero(valid.any(1))
        if not len(lines):
            return
        at = first_places(score[lines], valid[lines], self.k, small)
        got = at >= 0
        new = np.where(got, np.take_along_axis(score[lines], np.maximum(at, 0), 1), NONE)
        s = np.hstack([self.score[lines], new])
        i = np.hstack([self.id[lines], np.where(got, ids[at], 0)])
        r = np.hstack([self.row[lines], np.where(got, row0 + at, -1)])
        order = np.lexsort((r, i, -s), axis=-1)[:, :self.k]
        self.score[lines], self.id[lines], self.row[lines] = (np.take_along_axis(v, order, 1) for v in (s, i, r))


def pack(anchor: np.ndarray, mark: np.ndarray, score: np.ndarray, kind: int, ids: np.ndarray) -> pa.Array:
    """Keys whose byte order is (anchor id, anchor mark, falling score, kind, id)."""
    out = np.empty((len(ids), _KEY), np.uint8)
    sign = np.uint64(1) << np.uint64(63)
    for at, v in ((0, anchor.astype(np.int64).view(np.uint64) ^ sign), (8, mark.astype(np.int64).view(np.uint64)),
                  (16, (2**62 - score).astype(np.uint64)), (25, ids.astype(np.int64).view(np.uint64) ^ sign)):
        out[:, at:at + 8] = v.astype(">u8").view(np.uint8).reshape(-1, 8)
    out[:, 24] = kind
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_KEY), len(ids), [None, pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpack(keys: pa.Array):
    """anchor id, anchor mark, score, kind, id of packed keys."""
    raw = np.frombuffer(b"".join(keys.to_pylist()), np.uint8).reshape(-1, _KEY)
    sign = np.uint64(1) << np.uint64(63)
    number = lambda at: np.ascontiguousarray(raw[:, at:at + 8]).view(">u8").ravel().astype(np.uint64)
    return ((number(0) ^ sign).view(np.int64), number(8).view(np.int64), 2**62 - number(16).astype(np.int64), raw[:, 24],
            (number(25) ^ sign).view(np.int64))


class _Block:
    """The anchors of one block pair and what is kept for them."""

    def __init__(self, first_group: bool):
        self.first_group, self.parts, self.rows = first_group, [], 0

    def add_anchors(self, b: pa.RecordBatch) -> None:
        self.parts.append(b)

    def start(self) -> None:
        t = pa.Table.from_batches(self.parts).combine_chunks()
        column = lambda n: t.column(n).combine_chunks()
        self.id, self.label, self.mark = (column(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label", "mark"))
        self.x = whole_matrix(column("vec"))
        self.positive = [p or [] for p in column("scores").to_pylist()], [p or [] for p in column("ids").to_pylist()]
        self.window = np.array([p + [NONE] * (POSITIVES - len(p)) for p in self.positive[0]], np.int64).reshape(len(self.id), POSITIVES)
        self.parts = []

    def add_rows(self, b: pa.RecordBatch, keep) -> None:
        ids = b.column("vec_id").to_numpy(zero_copy_only=False)
        label = b.column("label").to_numpy(zero_copy_only=False)
        x = whole_matrix(b.column("vec"))
        step = max(1, min(2048, CELLS // max(1, len(self.id))))
        for at in range(0, len(ids), step):
            order = at + np.argsort(ids[at:at + step], kind="stable")
            score, small = scores_of(self.x, x[order])
            keep(score, self.label[:, None] == label[order][None, :], ids[order], self.rows + at, small)
        self.rows += len(ids)


class _Positives(_Block):
    """Each anchor's first rows of its own label."""

    def start(self) -> None:
        super().start()
        self.best = Kept(len(self.id), POSITIVES)

    def feed(self, b: pa.RecordBatch) -> None:
        self.add_rows(b, lambda score, same, ids, row0, small: self.best.add(score, same & (self.id[:, None] != ids[None, :]), ids, row0, small))

    def keys(self):
        line, at = np.nonzero(self.best.row >= 0)
        yield pack(self.id[line], self.mark[line], self.best.score[line, at], 1, self.best.id[line, at])


class _Negatives(_Block):
    """The first rows of other labels inside the window of each positive, and the positives that open the windows."""

    def start(self) -> None:
        super().start()
        self.best = [Kept(len(self.id), NEGATIVES) for _ in range(POSITIVES)]

    def feed(self, b: pa.RecordBatch) -> None:
        def keep(score, same, ids, row0, small):
            for p, best in enumerate(self.best):
                high = self.window[:, p][:, None]
                inside = ~same & (score >= lowest(high)) & (score <= high) & (high >= 0)
                best.add(score, inside, ids, row0, small)

        self.add_rows(b, keep)

    def keys(self):
        found = np.concatenate([np.stack([np.nonzero(k.row >= 0)[0], k.row[k.row >= 0], k.score[k.row >= 0], k.id[k.row >= 0]]) for k in self.best], axis=1)
        found = np.unique(found, axis=1)  # a row inside several windows travels once
        yield pack(self.id[found[0]], self.mark[found[0]], found[2], 1, found[3])
        if self.first_group:  # the positives travel once, not once per block of rows
            line = np.repeat(np.arange(len(self.id)), [len(p) for p in self.positive[0]])
            flat = [np.array([v for p in part for v in p], np.int64) for part in self.positive]
            yield pack(self.id[line], self.mark[line], flat[0], 0, flat[1])


def lowest(score):
    """The smallest whole number n with LOW_PCT * score <= HIGH_PCT * n; for 80 and 100 without a product that could overflow."""
    return score - score // (HIGH_PCT // (HIGH_PCT - LOW_PCT))


def block_keys(rows: DataFrame, anchors: DataFrame, kind) -> DataFrame:
    """part (of the anchor), key: what the block pairs keep. anchors: vec_id, label, vec, mark, scores, ids."""
    n_rows, n_anchors = rows.count(), anchors.count()
    groups, blocks = max(1, -(-n_rows // BLOCK)), max(1, -(-n_anchors // BLOCK))
    spread = lambda df, n, name: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    # dealt in turn, so that rows that are alike don't meet in one group
    plain = rows.withColumn("group", F.pmod(F.monotonically_increasing_id(), F.lit(groups)).cast("int"))
    nothing = F.lit(None).cast("array<long>")
    plain = spread(plain, blocks, "block").select("block", "group", F.lit(1).alias("is_row"), "vec_id", "label", "vec",
                                                  F.lit(0).cast("long").alias("mark"), nothing.alias("scores"), nothing.alias("ids"))
    mine = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int"))
    mine = spread(mine, groups, "group").select("block", "group", F.lit(0).alias("is_row"), "vec_id", "label", "vec", "mark", "scores", "ids")
    pairs = mine.unionByName(plain).repartition(groups * blocks, "block", "group").sortWithinPartitions("block", "group", "is_row")

    def run(batches):
        now, pair = None, None

        def done():
            if now is None:
                return
            if now.parts:
                now.start()
            for keys in now.keys():
                yield pa.RecordBatch.from_arrays([pc.binary_slice(keys, 0, 16), keys], names=["anchor", "key"])

        for b in batches:
            head = np.stack([b.column(n).to_numpy(zero_copy_only=False) for n in ("block", "group", "is_row")])
            cuts = [0, *(np.flatnonzero((np.diff(head, axis=1) != 0).any(0)) + 1).tolist(), b.num_rows]
            for at, to in zip(cuts, cuts[1:]):
                if at == to:
                    continue
                block, group, is_row = head[:, at].tolist()
                if (block, group) != pair:
                    yield from done()
                    pair, now = (block, group), None
                part = b.slice(at, to - at)
                if not is_row:
                    now = now or kind(group == 0)
                    now.add_anchors(part)
                elif now is not None:  # a block without anchors has nothing to find
                    if now.parts:
                        now.start()
                    now.feed(part)
        yield from done()

    return pairs.mapInArrow(run, "anchor binary, key binary")


def _sorted_stream(keys: DataFrame) -> DataFrame:
    """The secondary sort: keys dealt by anchor, in order inside each partition."""
    return keys.repartition("anchor").sortWithinPartitions("key")


def positives_of(keys: DataFrame) -> DataFrame:
    """vec_id, mark, scores, ids: the first POSITIVES keys of each anchor."""
    def run(batches):
        anchor, taken = None, ([], [])

        def row():
            return pa.RecordBatch.from_arrays([pa.array([anchor[0]], pa.int64()), pa.array([anchor[1]], pa.int64()),
                                               *(pa.array([t], pa.list_(pa.int64())) for t in taken)], names=["vec_id", "mark", "scores", "ids"])

        for b in batches:
            for a, mark, score, _, i in zip(*(v.tolist() for v in unpack(b.column("key")))):
                if (a, mark) != anchor:
                    if anchor is not None:
                        yield row()
                    anchor, taken = (a, mark), ([], [])
                if len(taken[0]) < POSITIVES:
                    taken[0].append(score)
                    taken[1].append(i)
        if anchor is not None:
            yield row()

    return _sorted_stream(keys).mapInArrow(run, "vec_id long, mark long, scores array<long>, ids array<long>")


def windows_of(keys: DataFrame) -> DataFrame:
    """The result: a positive opens a window, a negative belongs to every window that is still open at its score."""
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        anchor, windows = None, []
        for b in batches:
            out = []
            for a, mark, score, kind, i in zip(*(v.tolist() for v in unpack(b.column("key")))):
                if (a, mark) != anchor:
                    anchor, windows = (a, mark), []
                if kind == 0:
                    windows.append([score, i, 0])
                    continue
                windows = [w for w in windows if w[2] < NEGATIVES and score >= lowest(w[0])]
                for w in windows:
                    w[2] += 1
                    out.append((a, w[1], w[2], i, w[0], score))
            columns = list(zip(*out)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return _sorted_stream(keys).mapInArrow(
        run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine_hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, id_col: str = "vec_id",
                        vector_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    is_anchor and label are columns of vectors. Rows without an id, label or vector, or with a NULL or non-finite
    entry, take no part. Scores are inner products of floor(SCALE * x), the higher first, ties by the smaller id; shorter
    vectors go on with zeros, empty ones score 0. An anchor's positives are the first rows of its label that have
    another id; a negative has another label and a score of LOW_PCT to HIGH_PCT percent of the positive's, so a
    positive with a score below 0 has none. Repeated rows count as often as they are there, but an anchor that is
    repeated with the same label and vector is asked once; with another label or vector it is asked for each. Tables
    without rows or anchors give no rows.
    """
    rows = minable(vectors, id_col, vector_col, label)
    marked = minable(vectors.where(F.coalesce(is_anchor, F.lit(False))), id_col, vector_col, label)
    anchors = stored(marked.withColumn("mark", F.xxhash64("label", "vec")).dropDuplicates(["vec_id", "label", "vec"]), "mining-anchors")
    none = F.lit(None).cast("array<long>")
    first = block_keys(rows, anchors.withColumns({"scores": none, "ids": none}), _Positives)
    positives = stored(positives_of(first), "mining-positives")
    asked = anchors.join(positives, ["vec_id", "mark"])  # an anchor without a positive has no window
    return windows_of(block_keys(rows, asked, _Negatives))
