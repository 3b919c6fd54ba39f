"""Repeated windows of a corpus, shared by the two substring deduplications.

A window of W units (words or bytes) is anchored at its smallest hashed run of G units.
Equal windows have equal anchors, so a window can only repeat where its anchor does,
and consecutive windows with one anchor travel together as a segment of W to 2W units.

1. Segments are folded by content; only anchors that occur more than once go on.
2. Where an anchor has one content only, the first occurrence is known. Otherwise the
   different contents of a shard of anchors are resolved together by the caller's index
   (a suffix automaton, a suffix array), which says where each window first starts.
3. Every occurrence of a segment looks up its content's first starts; windows that
   started earlier cover their units.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from erashift.llm.common import ORPHAN, Steps, mix, powers
from erashift.llm.line_dedup import Bloom, merged_filter

SHARD_UNITS = 400_000       # units one index is built over, about
MAX_VARIANTS = 2_000        # different contents of one anchor in a shard; more are grouped window by window
MAX_BITS = 1 << 28          # of the filter that keeps segments without a repeated anchor from being shuffled
BROADCAST_ROWS = 1_000_000  # document numbers
_CHUNK = 1 << 19
_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LOW = np.uint64((1 << 20) - 1)


class Runs:
    """Polynomial hashes of any runs of a sequence of 64-bit units, from prefix sums."""

    def __init__(self, h: np.ndarray):
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers(len(h), _BASE), dtype=np.uint64)])
        self.back = powers(len(h) + 1, _INVERSE)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def segments(h: np.ndarray, window: int, gram: int):
    """anchor, segment hash, start, number of windows of each segment of one document."""
    out = []
    for base in range(0, max(0, len(h) - window + 1), _CHUNK):
        part = h[base:base + _CHUNK + window - 1]
        runs, n = Runs(part), len(part) - window + 1
        at = np.arange(len(part) - gram + 1)
        grams = runs.of(at, at + gram)
        keyed = (grams & ~_LOW) | at.astype(np.uint64)  # ties go to the leftmost
        span = window - gram + 1
        padded = np.full(-(-len(keyed) // span) * span + span, np.uint64(2**64 - 1))
        padded[:len(keyed)] = keyed
        blocks = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        count = np.diff(first, append=n)
        out.append((grams[place[first]], runs.of(first, first + count + window - 1), first + base, count))
    if not out:
        none = np.empty(0, np.uint64)
        return none, none, np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


_SEGMENT = "anchor long, seg long, n int, doc long, row long, start long, copies long"


def _batch(anchor, seg, n, doc, row, start, copies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(n.astype(np.int32)), pa.array(doc), pa.array(row), pa.array(start), pa.array(copies)],
        names=["anchor", "seg", "n", "doc", "row", "start", "copies"])


def _found(batch, units, window, gram):
    """Segment columns of a batch, in (doc, row, start) order."""
    rows = sorted((r for r in zip(*(batch.column(i).to_pylist() for i in range(3))) if r[2]), key=lambda r: r[:2])
    size, part = 0, []
    for doc, row, text in rows:
        anchor, seg, start, n = segments(units(text.encode()), window, gram)
        part.append((anchor, seg, n, np.full(len(n), doc, np.int64), np.full(len(n), row, np.int64), start))
        size += len(n)
        if size > 400_000:
            yield tuple(np.concatenate(x) for x in zip(*part))
            size, part = 0, []
    if part:
        yield tuple(np.concatenate(x) for x in zip(*part))


def _folded(units, window, gram):
    """One row per different segment of a batch: its first occurrence and its copies."""
    def run(batches):
        for b in batches:
            for anchor, seg, n, doc, row, start in _found(b, units, window, gram):
                order = np.argsort(anchor * _BASE + seg, kind="stable")  # rows are in (doc, row, start) order
                anchor, seg, n, doc, row, start = (x[order] for x in (anchor, seg, n, doc, row, start))
                head = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])])) if len(n) else np.empty(0, np.int64)
                copies = np.diff(head, append=len(n))
                yield _batch(anchor[head], seg[head], n[head], doc[head], row[head], start[head], copies.astype(np.int64))

    return run


def _suspected(units, window, gram, bits):
    """All segments whose anchor the filter knows."""
    def run(batches):
        known = Bloom(data=bits.value)
        for b in batches:
            for found in _found(b, units, window, gram):
                hit = known.has(found[0])
                picked = [x[hit] for x in found]
                yield _batch(*picked, np.ones(len(picked[0]), np.int64))

    return run


def _contents(cut: Callable):
    """The content of each wanted segment of a row."""
    def run(batches):
        done = None
        for b in batches:
            for doc, row, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (doc, row) == done:  # equal rows of one doc_id, which a shuffle brings together
                    continue
                done = doc, row
                data = cut((text or "").encode(), [(w["start"], w["start"] + w["len"]) for w in wanted])
                cols = [[w[k] for w in wanted] for k in ("anchor", "seg", "n", "start")]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()),
                     pa.array([doc] * len(wanted), pa.int64()), pa.array([row] * len(wanted), pa.int64()), pa.array(cols[3], pa.int64()),
                     pa.array(data, pa.binary())], names=["anchor", "seg", "n", "doc", "row", "start", "content"])

    return run


_FIRST = "anchor long, seg long, off int, len int, fdoc long, frow long, fstart long"


def _resolver(index: Callable, window: int):
    """First starts of all windows of a shard's segments, as runs of equal shift."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["anchor", "seg"]).sort_values(["doc", "row", "start"], kind="stable")
        n, doc, row, start = pdf["n"].to_numpy(np.int64), pdf["doc"].to_numpy(), pdf["row"].to_numpy(), pdf["start"].to_numpy()
        nth = np.cumsum(np.concatenate([[False], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])]))  # the texts by number
        seg = np.repeat(np.arange(len(n)), n)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
        # first: for each window the number of the window, in this order, at which its content first starts
        first = index(pdf["content"].tolist(), n, nth[seg], start[seg] + off)
        fnth, fstart = nth[seg][first], (start[seg] + off)[first]
        head = np.concatenate([[True], (seg[1:] != seg[:-1]) | (fnth[1:] != fnth[:-1]) | (np.diff(fstart) != 1)])
        head = np.flatnonzero(head)
        return pd.DataFrame({
            "anchor": pdf["anchor"].to_numpy()[seg[head]], "seg": pdf["seg"].to_numpy()[seg[head]], "off": off[head].astype(np.int32),
            "len": np.diff(head, append=len(seg)).astype(np.int32), "fdoc": doc[seg][first][head], "frow": row[seg][first][head], "fstart": fstart[head]})

    return run


def _windows(hashed: Callable, window: int):
    """Each window of the given segments with two hashes of its content."""
    def run(batches):
        for b in batches:
            for anchor, seg, n, doc, row, start, content in zip(*(b.column(i).to_pylist() for i in range(7))):
                h = hashed(content)
                at = np.arange(n)
                one, two = (Runs(x).of(at, at + window).view(np.int64) for x in (h, mix(h)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, anchor)), pa.array(np.full(n, seg)), pa.array(at.astype(np.int32)), pa.array(one), pa.array(two),
                     pa.array(np.full(n, doc)), pa.array(np.full(n, row)), pa.array(start + at)],
                    names=["anchor", "seg", "off", "w1", "w2", "doc", "row", "start"])

    return run


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(doc, row, doc_id, text): doc orders the rows, row tells rows of one or no doc_id apart by their text."""
    return docs.select(F.coalesce("doc_id", F.lit(ORPHAN)).alias("doc"), F.xxhash64("text").alias("row"), "doc_id", "text")


def repeated_spans(steps: Steps, docs: DataFrame, units: Callable, cut: Callable, hashed: Callable, index: Callable, window: int,
                   gram: int, shard_units: int = SHARD_UNITS, max_variants: int = MAX_VARIANTS) -> DataFrame:
    """(doc, row, fdoc, frow, from, to, fstart): spans of (doc, row, text) whose windows first start elsewhere.

    A window's first start is that of the smallest (doc, row, start); it lies at fstart
    of (fdoc, frow), and further windows of the span follow there. A text is addressed by
    (doc, row), so rows that share a doc must differ in row unless their texts are equal.
    units(bytes) gives 64-bit units, cut(bytes, spans) the content of spans of units,
    hashed(content) its units again, and index(contents, windows per content, number of
    the text, start) for each window the number of the first equal one. The spans read
    tables of steps.
    """
    def sized(df, n):
        return F.broadcast(df) if n <= BROADCAST_ROWS else df

    first = F.min(F.struct("doc", "row", "start")).alias("first")
    folded = docs.mapInArrow(_folded(units, window, gram), _SEGMENT).repartition("anchor").groupBy("anchor", "seg", "n").agg(
        first, F.sum("copies").alias("copies"))
    own = Window.partitionBy("anchor")  # the layout is there already, and copies are folded
    repeated = folded.withColumn("all", F.sum("copies").over(own)).withColumn("variants", F.count("*").over(own)).where("all > 1").select(
        "anchor", "seg", "n", "first.doc", "first.row", "first.start", "variants")
    repeated = steps.stored(repeated, "repeated-segments")

    single = repeated.where("variants = 1").select(
        "anchor", "seg", F.lit(0).alias("off"), F.col("n").alias("len"), F.col("doc").alias("fdoc"), F.col("row").alias("frow"), F.col("start").alias("fstart"))
    several = repeated.where("variants > 1").withColumn("len", F.col("n") + window - 1)
    per_row = several.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(
        F.collect_list(F.struct("anchor", "seg", "n", "start", "len")).alias("wanted"))
    ids = several.select(F.col("doc").alias("_doc"), F.col("row").alias("_row")).distinct()
    same = (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row"))
    holders = docs.join(sized(ids, ids.count()), same, "left_semi")
    contents = holders.join(per_row, same).select("doc", "row", "text", "wanted").mapInArrow(
        _contents(cut), "anchor long, seg long, n int, doc long, row long, start long, content binary")
    contents = steps.stored(contents, "segment-contents")
    sizes = several.agg(F.sum("len").alias("units")).collect()[0]["units"] or 0
    crowded = several.where(F.col("variants") > max_variants).select(F.col("anchor").alias("_a")).distinct()
    crowded = sized(crowded, crowded.count())
    usual = contents.join(crowded, F.col("anchor") == F.col("_a"), "left_anti")
    large = several.where(F.col("variants") * window > shard_units // 4).select(F.col("anchor").alias("_l")).distinct()
    large = sized(large, large.count())
    dealt = F.concat(F.lit("s"), F.pmod(F.xxhash64("anchor"), F.lit(max(1, sizes // shard_units))))
    shard = F.when(F.col("_l").isNull(), dealt).otherwise(F.concat(F.lit("a"), "anchor"))  # large anchors have their own
    resolved = usual.join(large, F.col("anchor") == F.col("_l"), "left").withColumn("shard", shard).groupBy("shard").applyInPandas(_resolver(index, window), _FIRST)
    split = contents.join(crowded, F.col("anchor") == F.col("_a"), "left_semi").dropDuplicates(["anchor", "seg"]).mapInArrow(
        _windows(hashed, window), "anchor long, seg long, off int, w1 long, w2 long, doc long, row long, start long")
    split = steps.stored(split, "crowded-windows")
    starts = split.groupBy(F.col("w1").alias("_1"), F.col("w2").alias("_2")).agg(first)
    alone = split.join(starts, (F.col("w1") == F.col("_1")) & (F.col("w2") == F.col("_2"))).select(
        "anchor", "seg", "off", F.lit(1).alias("len"), F.col("first.doc").alias("fdoc"), F.col("first.row").alias("frow"), F.col("first.start").alias("fstart"))
    firsts = steps.stored(single.unionByName(resolved).unionByName(alone), "first-starts")
    steps.drop("segment-contents", "crowded-windows")

    anchors = repeated.select(F.col("anchor").alias("h")).distinct()
    bits = docs.sparkSession.sparkContext.broadcast(merged_filter(anchors, repeated.count(), MAX_BITS))
    occurrences = docs.mapInArrow(_suspected(units, window, gram, bits), _SEGMENT).select("anchor", "seg", "doc", "row", "start")
    looked_up = firsts.select(F.col("anchor").alias("_a"), F.col("seg").alias("_s"), "off", "len", "fdoc", "frow", "fstart")
    at = F.col("start") + F.col("off")
    elsewhere = occurrences.join(looked_up, (F.col("anchor") == F.col("_a")) & (F.col("seg") == F.col("_s"))).where(
        (F.col("fdoc") < F.col("doc")) | (F.col("frow") != F.col("row")) | (F.col("fstart") < at))
    return elsewhere.select("doc", "row", "fdoc", "frow", at.alias("from"), (at + F.col("len") + F.lit(window - 1)).alias("to"), "fstart")


def spans_by_row(steps: Steps, spans: DataFrame) -> DataFrame:
    """(_doc, _row, spans, shared): each row's spans that start earlier, packed into one number each (a text has
    fewer than 2^31 units), and those that first start in another row of the same doc, which is not earlier.

    It is the only table of steps that is left: the texts are shuffled after this, and no segments beside them.
    """
    earlier = (F.col("fdoc") < F.col("doc")) | (F.col("frow") == F.col("row"))
    packed = F.shiftleft(F.col("from").cast("long"), 31) + F.col("to")
    # sets, because equal rows of one doc_id find the same spans
    by_row = spans.groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_row")).agg(
        F.collect_set(F.when(earlier, packed)).alias("spans"), F.collect_set(F.when(~earlier, F.struct(packed.alias("span"), "frow", "fstart"))).alias("shared"))
    by_row = steps.stored(by_row, "spans-by-row")
    steps.drop("repeated-segments", "first-starts")
    return by_row


def repeats_inside(shared: list[dict], window: int) -> np.ndarray:
    """Packed spans of the windows of one row that also start further left in it.

    Windows are equal if they first start at the same place, here in another row.
    """
    packed, frow, fstart = (np.array([x[k] for x in shared], np.int64) for k in ("span", "frow", "fstart"))
    start = packed >> 31
    n = (packed & (2**31 - 1)) - start - window + 1
    off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at, frow, fstart = np.repeat(start, n) + off, np.repeat(frow, n), np.repeat(fstart, n) + off
    order = np.lexsort((at, fstart, frow))
    at, frow, fstart = at[order], frow[order], fstart[order]
    head = np.concatenate([[True], (frow[1:] != frow[:-1]) | (fstart[1:] != fstart[:-1])])
    again = at[at > at[np.flatnonzero(head)][np.cumsum(head) - 1]]
    return (again << 31) + again + window


def merged_spans(column: pa.ListArray):
    """For each row of packed spans the overlapping or touching ones joined, in order: (starts, ends)."""
    flat, none = column.flatten().to_numpy(zero_copy_only=False), np.empty(0, np.int64)
    at = 0
    for n in column.value_lengths().to_pylist():
        if not n:
            yield none, none
            continue
        packed = np.sort(flat[at:at + n])
        at += n
        start, end = packed >> 31, np.maximum.accumulate(packed & (2**31 - 1))
        head = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        yield start[head], np.append(end[head[1:] - 1], end[-1])
