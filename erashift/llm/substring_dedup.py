"""Removal of long repeated word sequences with suffix automata.

Segments that can repeat are gathered in shards (see anchors). Each shard's different
segments are the reference: one suffix automaton is built over them in document order,
so a state knows where its strings first ended. The same segments stream through it;
as soon as the matching statistic reaches the window length, the state that holds the
last window's words tells its first start. An automaton over all references would not
fit a broadcast of bounded size, and most segments could not match most automata, so
instead of sending every automaton everywhere, segments meet the one of their anchor.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.llm.anchors import keyed_rows, merged_spans, repeated_spans, spans_by_row
from erashift.llm.common import Steps, texts, word_hashes

WINDOW_WORDS, GRAM_WORDS = 50, 8


class SuffixAutomaton:
    """Suffix automaton of a growing sequence; first[s] is where the strings of state s first ended."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [-1]
        self.last = 0

    def _state(self, nxt: dict, link: int, length: int, first: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.first.append(first)
        return len(self.link) - 1

    def extend(self, symbol, at: int) -> None:
        nxt, link, length = self.next, self.link, self.length
        new = self._state({}, 0, length[self.last] + 1, at)
        p, self.last = self.last, new
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p < 0:
            return
        q = nxt[p][symbol]
        if length[q] == length[p] + 1:
            link[new] = q
            return
        clone = self._state(dict(nxt[q]), link[q], length[p] + 1, self.first[q])
        while p >= 0 and nxt[p].get(symbol) == q:
            nxt[p][symbol] = clone
            p = link[p]
        link[q] = link[new] = clone

    def first_ends(self, symbols, window: int) -> list[int]:
        """For each window of a sequence that the automaton holds: where it first ended."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state, matched, out = 0, 0, []
        for symbol in symbols:
            while state and symbol not in nxt[state]:
                state = link[state]
                matched = length[state]
            state = nxt[state].get(symbol, 0)
            matched = matched + 1 if state else 0
            while state and length[link[state]] >= window:
                state = link[state]
            if matched >= window:
                out.append(first[state])
        return out


def automaton_index(contents: list[bytes], n: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Number of the first equal window, for all windows of segments given in document order."""
    words = [c.split() for c in contents]
    automaton, number_at, window, at = SuffixAutomaton(), {}, 0, 0
    for i, ws in enumerate(words):
        for k, w in enumerate(ws):
            automaton.extend(w, at)
            if k >= WINDOW_WORDS - 1:
                number_at[at] = window
                window += 1
            at += 1
        automaton.extend(-1 - i, at)  # ends the segment: no window reaches into the next
        at += 1
    return np.array([number_at[e] for ws in words for e in automaton.first_ends(ws, WINDOW_WORDS)], np.int64)


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    words = text.split()
    return [b" ".join(words[a:b]) for a, b in spans]


def _remove(batches):
    for b in batches:
        out = []
        for text, (starts, ends) in zip(b.column(2).to_pylist(), merged_spans(b.column(3))):
            words = (text or "").encode().split()
            kept, at = [], 0
            for x, y in zip(starts.tolist(), ends.tolist()):
                kept.extend(words[at:x])
                at = y
            kept.extend(words[at:])
            body = b" ".join(kept)
            out.append((len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body.decode()))
        cols = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [b.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """Every row with doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of 50 words that covers it also starts in a document with a
    smaller doc_id, judged on the input. NULL and empty texts have no words. Rows without
    a doc_id come after all others. Every row is judged by itself; of rows that share a
    doc_id, or have none, no one is earlier than another.
    """
    rows = keyed_rows(texts(docs, id_col, text_col))
    steps = Steps(docs.sparkSession)
    spans = repeated_spans(steps, rows.select("doc", "row", "text"), word_hashes, cut_words, word_hashes, automaton_index, WINDOW_WORDS, GRAM_WORDS, **sizes)
    gone = spans_by_row(steps, spans.where("fdoc < doc"))
    return rows.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row")), "left").select("doc", "doc_id", "text", "spans").mapInArrow(
        _remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
