"""Line deduplication with two Bloom filters.

The first filter holds the line hashes seen once, the second those seen again.
Each builder task streams its documents through its own pair; pairs merge slice
by slice, where a hash in both "once" filters counts as seen again. The merged
second filter has a fixed largest size and is broadcast. Only lines it suspects
are shuffled: their full keys confirm the repeat and choose the first document.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import ORPHAN, SPACE, stored, texts

MIN_CODE_POINTS = 10
BITS_PER_LINE = 16
MAX_BITS = 1 << 30  # 128 MB; with more lines the filter only suspects more of them
_SLICE = 1 << 18


class Bloom:
    """Two probes per 64-bit hash in a bit array of 2^n bits."""

    def __init__(self, bits: int | None = None, data: np.ndarray | None = None):
        self.data = np.zeros(bits // 8, np.uint8) if data is None else data
        self.mask = np.uint64(8 * len(self.data) - 1)

    def _probes(self, h: np.ndarray):
        return h & self.mask, (h >> np.uint64(32)) & self.mask

    def add(self, h: np.ndarray) -> None:
        for at in self._probes(h):
            np.bitwise_or.at(self.data, at >> np.uint64(3), np.left_shift(1, at & np.uint64(7), dtype=np.uint8, casting="unsafe"))

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = ((self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 for at in self._probes(h))
        return (a & b).astype(bool)


def line_key(line: bytes) -> bytes | None:
    """The line without space at its ends and with A-Z in lower case; None if too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < MIN_CODE_POINTS or len(key) < 4 * MIN_CODE_POINTS and len(key.decode()) < MIN_CODE_POINTS:
        return None
    return key


def _keys(text: str | None) -> set[bytes]:
    found = {line_key(line) for line in (text or "").encode().split(b"\n")}
    found.discard(None)
    return found


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _build(bits: int):
    def run(batches):
        once, again = Bloom(bits), Bloom(bits)
        for b in batches:
            found = [_hashes(_keys(t)) for t in b.column(1).to_pylist()]
            h, n = np.unique(np.concatenate(found or [np.empty(0, np.uint64)]), return_counts=True)
            again.add(h[(n > 1) | once.has(h)])
            once.add(h)
        for at in range(0, bits // 8, _SLICE):
            o, t = once.data[at:at + _SLICE], again.data[at:at + _SLICE]
            if o.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.array([zlib.compress(o.tobytes(), 1)]), pa.array([zlib.compress(t.tobytes(), 1)])],
                    names=["at", "once", "again"])

    return run


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    once = again = None
    for o, t in zip(pdf["once"], pdf["again"]):
        o, t = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (o, t))
        again = t.copy() if once is None else again | t | (once & o)
        once = o.copy() if once is None else once | o
    return pd.DataFrame({"at": [pdf["at"].iloc[0]], "again": [zlib.compress(again.tobytes(), 1)]})


def repeat_filter(docs: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """The bits of the merged "seen again" filter, at most max_bits / 8 bytes."""
    spark = docs.sparkSession
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n")))
    lines = docs.agg(F.sum(F.coalesce(breaks, F.lit(0)) + 1).alias("n")).collect()[0]["n"] or 1
    bits = min(max_bits, max(1 << 16, 1 << (BITS_PER_LINE * lines - 1).bit_length()))
    builders = max(1, spark.sparkContext.defaultParallelism)  # one pair of filters per core, however many input splits
    pairs = docs.coalesce(builders).mapInArrow(_build(bits), "at long, once binary, again binary")
    return _assembled(pairs, bits)


def _add_all(bits: int):
    def run(batches):
        once = Bloom(bits)
        for b in batches:
            once.add(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        for at in range(0, bits // 8, _SLICE):
            o = once.data[at:at + _SLICE]
            if o.any():
                packed = zlib.compress(o.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([packed]), pa.array([packed])], names=["at", "once", "again"])

    return run


def _assembled(pairs: DataFrame, bits: int) -> np.ndarray:
    merged = np.zeros(bits // 8, np.uint8)
    for row in pairs.groupBy("at").applyInPandas(_merge, "at long, again binary").toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["again"]), np.uint8)
        merged[row["at"]:row["at"] + len(part)] = part
    return merged


def merged_filter(hashes: DataFrame, n: int, max_bits: int) -> np.ndarray:
    """The bits of one Bloom filter over a table of n hashes, at most max_bits / 8 bytes."""
    bits = min(max_bits, max(1 << 16, 1 << (BITS_PER_LINE * max(1, n) - 1).bit_length()))
    builders = max(1, hashes.sparkSession.sparkContext.defaultParallelism)
    return _assembled(hashes.coalesce(builders).mapInArrow(_add_all(bits), "at long, once binary, again binary"), bits)


def _suspects(filter_bits, fold: bool):
    """Suspected (key, doc, text hash), folded to (key, first doc, last doc) of a batch if asked for."""
    def run(batches):
        again = Bloom(data=filter_bits.value)
        for b in batches:
            keys, docs = [], []
            for doc, text, body in zip(*(b.column(i).to_pylist() for i in range(3))):
                own = _keys(text)
                keys.extend(own)
                docs.extend([(doc, body)] * len(own))
            if not keys:
                continue
            hit = again.has(_hashes(keys))
            pairs = [(keys[i], *docs[i]) for i in np.flatnonzero(hit)]
            if fold:
                spans: dict[bytes, tuple[int, int]] = {}
                for k, d, _ in pairs:
                    lo, hi = spans.get(k, (d, d))
                    spans[k] = (min(lo, d), max(hi, d))
                pairs = [(k, *v) for k, v in spans.items()]
            if pairs:
                cols = list(zip(*pairs))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary())] + [pa.array(c, pa.int64()) for c in cols[1:]],
                                                 names=["key", "first", "last"] if fold else ["key", "_doc", "_body"])

    return run


def _drop_lines(batches):
    for b in batches:
        out = []
        for text, drop in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            lines = (text or "").encode().split(b"\n")
            drop = set(drop or ())
            kept = [x for x in lines if line_key(x) not in drop] if drop else lines
            body = b"\n".join(kept)
            out.append((len(lines), len(lines) - len(kept), hashlib.sha256(body).hexdigest(), body.decode()))
        n, dropped, sha, body = zip(*out) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [b.column(1), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string()), pa.array(body, pa.string())],
            names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Every row with doc_id, n_lines, n_dropped, kept_sha256, kept_text.

    A line's key is the line without space at its ends, A-Z in lower case. Keys of
    at least ten code points found in two or more documents lose all their lines
    except in the smallest doc_id that holds them. NULL and empty texts are one
    empty line. Rows that share a doc_id are one document; rows without one are a
    document after all others. What a row loses is kept by doc_id and text, so it is
    never more than its own lines, however many rows share an id or have none.
    """
    rows = texts(docs, id_col, text_col)
    rows = rows.select(F.coalesce("doc_id", F.lit(ORPHAN)).alias("_doc"), "text", F.xxhash64("text").alias("_body"), "doc_id")
    bits = docs.sparkSession.sparkContext.broadcast(repeat_filter(rows.select("_doc", "text"), max_bits))
    pairs = rows.select("_doc", "text", "_body")
    repeats = pairs.mapInArrow(_suspects(bits, True), "key binary, first long, last long").groupBy("key").agg(
        F.min("first").alias("first"), F.max("last").alias("last")).where("first < last").select("key", "first")
    found = pairs.mapInArrow(_suspects(bits, False), "key binary, _doc long, _body long")
    drops = found.join(stored(repeats, "repeated-lines"), "key").where("_doc > first").groupBy("_doc", "_body").agg(
        F.collect_set("key").alias("drop"))
    return rows.join(drops, ["_doc", "_body"], "left").select("_doc", "doc_id", "text", "drop").mapInArrow(
        _drop_lines, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
