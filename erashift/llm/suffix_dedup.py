"""Removal of long repeated byte strings with suffix arrays by the difference cover algorithm.

Strings that can repeat are gathered in shards (see anchors); each shard's suffixes are
sorted by the difference cover modulo 3: the triples at positions 1 and 2 modulo 3 are
sorted and named, the names sorted recursively, and the remaining suffixes merged in.
Neighbours that agree in their first 100 bytes are equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.llm.anchors import keyed_rows, merged_spans, repeated_spans, repeats_inside, spans_by_row
from erashift.llm.common import Steps, mix, texts

WINDOW_BYTES, GRAM_BYTES = 100, 20
MAX_VARIANTS = 8_000  # of at most 180 bytes each: 1.4 million units
_UNIT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_NAME_BITS, _RANK_BITS = 21, 22


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of t (positive numbers below 2^21), in order."""
    n = len(t)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    if n >= 1 << _NAME_BITS:
        raise ValueError("a shard holds at most two million units")
    padded = np.concatenate([t.astype(np.uint64), np.zeros(4, np.uint64)])
    sample = np.arange(n + (n % 3 == 1))  # with a mod-1 suffix of nothing if the last position is 0 modulo 3
    sample = np.concatenate([sample[sample % 3 == 1], sample[sample % 3 == 2]])
    triple = (padded[sample] << np.uint64(2 * _NAME_BITS)) | (padded[sample + 1] << np.uint64(_NAME_BITS)) | padded[sample + 2]
    names, name = np.unique(triple, return_inverse=True)
    order = np.argsort(name, kind="stable") if len(names) == len(sample) else suffix_array(name + 1)
    rank = np.zeros(n + 5, np.uint64)
    rank[sample[order]] = np.arange(1, len(order) + 1, dtype=np.uint64)
    sampled = sample[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    r = np.uint64(_RANK_BITS)
    pair = lambda i: (padded[i] << r) | rank[i + 1]
    wide = lambda i: (((padded[i] << np.uint64(_NAME_BITS)) | padded[i + 1]) << r) | rank[i + 2]
    rest = rest[np.argsort(pair(rest), kind="stable")]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    slot = np.arange(len(rest)) + np.searchsorted(pair(one), pair(rest)) + np.searchsorted(wide(two), wide(rest))
    out = np.full(n, -1, np.int64)
    out[slot] = rest
    out[out < 0] = sampled
    return out


def suffix_index(contents: list[bytes], n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of the first equal window, for all windows of the given segments."""
    t = np.frombuffer(b"".join(contents), np.uint8)
    begins = np.cumsum([0, *(len(c) for c in contents)])[:-1]
    at = np.repeat(begins, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    number = np.full(len(t), -1, np.int64)
    number[at] = np.arange(len(at))
    order = suffix_array(t.astype(np.int64) + 1)
    order = order[number[order] >= 0]  # only suffixes that begin a window inside its segment
    eight = np.zeros(max(0, len(t) - 7), np.uint64)  # the eight bytes from each position on
    for k in range(8):
        eight = (eight << np.uint64(8)) | t[k:k + len(eight)]
    equal = np.ones(len(order) - 1, bool)
    for k in [*range(0, WINDOW_BYTES - 8, 8), WINDOW_BYTES - 8]:
        equal &= eight[order[1:] + k] == eight[order[:-1] + k]
    group = np.concatenate([[0], np.cumsum(~equal)])
    windows = number[order]
    age = np.empty(len(at), np.int64)
    age[np.lexsort((start, doc))] = np.arange(len(at))
    by_age = np.lexsort((age[windows], group))
    heads = np.flatnonzero(np.diff(group[by_age], prepend=-1))
    first = np.empty(len(at), np.int64)
    first[windows] = windows[by_age][heads][group]
    return first


def byte_units(text: bytes) -> np.ndarray:
    return _UNIT[np.frombuffer(text, np.uint8)]


def cut_bytes(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    return [text[a:b] for a, b in spans]


def _remove(batches):
    for b in batches:
        out = []
        spans = b.column(3)
        if pc.any(pc.greater(pc.list_value_length(b.column(4)), 0)).as_py():
            spans = pa.array([np.concatenate([np.array(x or [], np.int64), repeats_inside(y, WINDOW_BYTES)]) if y else x
                              for x, y in zip(spans.to_pylist(), b.column(4).to_pylist())], pa.list_(pa.int64()))
        for text, (starts, ends) in zip(b.column(2).to_pylist(), merged_spans(spans)):
            raw = (text or "").encode()
            kept, at = [], 0
            for x, y in zip(starts.tolist(), ends.tolist()):
                kept.append(raw[at:x])
                at = y
            body = b"".join([*kept, raw[at:]])
            out.append((len(raw), len(raw) - len(body), len(starts), hashlib.sha256(body).hexdigest(), body))
        cols = list(zip(*out)) or [()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_variants: int = MAX_VARIANTS,
                 **sizes) -> DataFrame:
    """Every row with doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    A byte goes if a string of 100 bytes that covers it also starts earlier: in a smaller
    doc_id or further to the left in the same text, overlaps included, judged on the
    input. NULL texts are empty. What stays need not be valid UTF-8. Rows without a doc_id
    come after all others. Every row is judged by itself; of rows that share a doc_id, or
    have none, no one is earlier than another.
    """
    rows = keyed_rows(texts(docs, id_col, text_col))
    steps = Steps(docs.sparkSession)
    spans = repeated_spans(steps, rows.select("doc", "row", "text"), byte_units, cut_bytes, byte_units, suffix_index, WINDOW_BYTES, GRAM_BYTES,
                           max_variants=max_variants, **sizes)
    gone = spans_by_row(steps, spans)
    return rows.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left").select(
        "doc", "doc_id", "text", "spans", "shared").mapInArrow(
        _remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
