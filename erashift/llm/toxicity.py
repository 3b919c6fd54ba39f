"""Toxicity by averaged subword embeddings and a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams, a text the mean of its
different words, so a misspelling that training never saw still shares most of its
n-grams with the word it hides.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
import zlib
from array import array
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import stored
from erashift.llm.labelled import MAX_TRAIN_ROWS, remainder, remainder_of, score_rows, training_features, training_texts

FOLDS, HELD_OUT_FOLD, THRESHOLD = 5, 0, 0.5
BUCKETS, DIM, EPOCHS, RATE, DECAY = 1 << 20, 8, 250, 0.05, 1e-5
PRIOR_TEXTS, PRIOR_POWER = 10.0, 2  # see evidence()
GRAMS = (3, 4, 5)
_WORD = re.compile(r"\w+")
_CACHED_WORDS = 300_000
CHUNK = 1 << 20  # entries the fit takes at a time


def words_of(text: str) -> list[str]:
    """The different words of a text, in a fixed order."""
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def gram_buckets(word: str) -> list[int]:
    marked = f"<{word}>"
    grams = dict.fromkeys([marked, *(marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1))])
    return [zlib.crc32(g.encode()) % BUCKETS for g in grams]


_known_buckets = functools.lru_cache(20_000)(gram_buckets)  # common words come in most texts


class MeanMatrix:
    """Averages over the entries of each row: the next count[i] columns in of are those of row i.

    No row and no column is empty, so that both directions are sums over neighbours. Entries are 32-bit numbers and
    are taken about CHUNK at a time, so that no array of doubles is as long as all of them.
    """

    def __init__(self, of: np.ndarray, count: np.ndarray):
        self.of, self.share = of.astype(np.int32), 1 / count
        by_column = np.argsort(self.of, kind="stable").astype(np.int32)
        self.row = np.repeat(np.arange(len(count), dtype=np.int32), count)[by_column]
        del by_column
        self.row_blocks, self.column_blocks = _blocks(count), _blocks(np.bincount(self.of))

    def times(self, x: np.ndarray) -> np.ndarray:
        return _neighbour_sums(x, self.of, self.row_blocks) * self.share

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        return _neighbour_sums(g * self.share, self.row, self.column_blocks)


def _blocks(count: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """Of runs of count[i] entries: (first entry, end, starts inside) of consecutive blocks of about CHUNK entries."""
    ends = np.cumsum(count)
    starts = ends - count
    edges = np.unique(np.append(np.searchsorted(ends, np.arange(CHUNK, ends[-1], CHUNK)), len(count)))
    out, at = [], 0
    for edge in edges[edges > 0].tolist():
        out.append((int(starts[at]), int(ends[edge - 1]), (starts[at:edge] - starts[at]).astype(np.int32)))
        at = edge
    return out


def _neighbour_sums(x: np.ndarray, of: np.ndarray, blocks: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    return np.concatenate([np.add.reduceat(x[of[a:b]], starts) for a, b, starts in blocks])


class Adam:
    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.step = value, rate, 0
        self.m, self.v = np.zeros_like(value), np.zeros_like(value)

    def move(self, grad_of: Callable[[slice], np.ndarray]) -> None:
        """One step; grad_of(rows) is asked for some rows at a time."""
        self.step += 1
        for at in range(0, len(self.value), CHUNK // 16):
            rows = slice(at, at + CHUNK // 16)
            grad, m, v = grad_of(rows), self.m[rows], self.v[rows]
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            self.value[rows] -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def _normal(rng: np.random.Generator, n: int) -> np.ndarray:
    """n x DIM small numbers, drawn some rows at a time."""
    out = np.empty((n, DIM), np.float32)
    for at in range(0, n, CHUNK // 16):
        part = out[at:at + CHUNK // 16]
        part[:] = rng.normal(0, 0.1, part.shape)
    return out


@dataclass
class ToxicityModel:
    """What each n-gram bucket of the labelled texts adds to the log odds of label 1, and the bias."""

    buckets: np.ndarray
    adds: np.ndarray
    bias: float

    @functools.cached_property
    def weight(self) -> dict[int, float]:
        return dict(zip(self.buckets.tolist(), self.adds.tolist()))

    def scorer(self):
        cache: dict[str, float] = {}
        all_buckets = np.zeros(BUCKETS, np.float32)
        all_buckets[self.buckets] = self.adds
        adds_of = array("f", all_buckets.tobytes()).__getitem__

        def score(text: str) -> float:
            words = words_of(text)
            total = 0.0
            for w in words:
                v = cache.get(w)
                if v is None:
                    if len(cache) >= _CACHED_WORDS:
                        cache.clear()
                    grams = gram_buckets(w)
                    v = cache[w] = sum(map(adds_of, grams)) / len(grams)
                total += v
            z = self.bias + (total / len(words) if words else 0.0)
            return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))

        return score


def evidence(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far from zero an n-gram's vector may move before the penalty holds it, against the others.

    seen[c, i] of the n[c] texts of class c have n-gram i. The difference of the
    smoothed log odds in its standard errors, to the power PRIOR_POWER: every n-gram
    has a vector, but thousands of chance n-grams don't add up in a long text.
    PRIOR_TEXTS texts of the usual mix are added to what was seen. (The README tells
    how the power was chosen.)
    """
    prior = PRIOR_TEXTS * (n / n.sum())[:, None]
    odds = np.log(seen + prior) - np.log(n[:, None] - seen + PRIOR_TEXTS)
    z = (odds[1] - odds[0]) / np.sqrt((1 / (seen + prior)).sum(0))
    return (np.abs(z) / 4) ** PRIOR_POWER


def word_number(word: str) -> int:
    """A word's 64-bit number."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


def bag_of_text(text: str) -> tuple[list[int], list[str], list[int]]:
    """A text's different words, their numbers before them, and the different n-gram buckets of all."""
    bag = words_of(text)
    return [word_number(w) for w in bag], bag, sorted({g for w in bag for g in _known_buckets(w)})


@dataclass
class Labelled:
    """The labelled texts that have words, as flat arrays of numbers."""

    label: np.ndarray        # of each text
    word_count: np.ndarray   # its different words
    word_of: np.ndarray      # their numbers, text after text
    number: np.ndarray       # the different words, ascending
    gram_count: np.ndarray   # the n-grams of each
    gram_of: np.ndarray      # their buckets, word after word
    bucket: np.ndarray       # the different buckets, ascending
    seen: np.ndarray         # seen[c, i] texts of class c have bucket[i]


def constant(y: np.ndarray) -> ToxicityModel:
    """The model that answers the share of label 1 (0 if there is no label)."""
    share = min(max(float(np.mean(y)) if len(y) else 0.0, 1e-9), 1 - 1e-9)
    return ToxicityModel(np.zeros(0, np.int32), np.zeros(0, np.float32), math.log(share / (1 - share)))


def fit(texts: list[str], y: list[int], epochs: int = EPOCHS, seed: int = 7) -> ToxicityModel:
    """fit_flat() on a few texts at hand.

    Without texts of both classes the model answers the share of label 1 (0 if there is no label).
    """
    full = [(*bag_of_text(t), k) for t, k in zip(texts, y) if words_of(t)]
    if not np.bincount([k for *_, k in full], minlength=2).all():
        return constant(np.array(y))
    words = {i: w for numbers, ws, *_ in full for i, w in zip(numbers, ws)}
    number = sorted(words)
    grams = [gram_buckets(words[i]) for i in number]
    bucket = np.unique(np.concatenate([np.array(g) for g in grams]))
    seen = np.zeros((2, BUCKETS))
    for _, _, found, k in full:
        seen[k, found] += 1
    flat = lambda lists: np.array([x for values in lists for x in values], np.int64)
    return fit_flat(Labelled(
        np.array([k for *_, k in full]), np.array([len(ws) for _, ws, *_ in full]), flat(numbers for numbers, *_ in full),
        np.array(number), np.array([len(g) for g in grams]), flat(grams), bucket, seen[:, bucket]), epochs, seed)


def _places(ranked: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value stands in ranked."""
    out = np.empty(len(values), np.int32)
    for at in range(0, len(values), CHUNK):
        out[at:at + CHUNK] = np.searchsorted(ranked, values[at:at + CHUNK])
    return out


def fit_flat(data: Labelled, epochs: int = EPOCHS, seed: int = 7) -> ToxicityModel:
    """Fit embeddings and softmax together, both classes weighing the same.

    A text is the mean of its words, a word the mean of its n-grams' vectors, each
    vector times its evidence. As the softmax is linear, the averages are taken of
    what a vector adds to the log odds, one number instead of DIM; its gradient
    comes back the same way.
    """
    label, bucket, n = data.label, data.bucket.astype(np.int32), len(data.bucket)
    words = MeanMatrix(_places(data.number, data.word_of), data.word_count)
    chars = MeanMatrix(_places(data.bucket, data.gram_of), data.gram_count)
    classes = np.bincount(label, minlength=2)
    held = evidence(data.seen, classes)
    del data
    rng = np.random.default_rng(seed)
    grams = Adam(_normal(rng, n), RATE)
    head = Adam(rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), RATE)
    bias = Adam(np.zeros(2, np.float32), RATE)
    weight = (0.5 / classes)[label]
    for _ in range(epochs):
        toward = head.value[:, 1] - head.value[:, 0]
        z = words.times(chars.times(held * (grams.value @ toward))) + bias.value[1] - bias.value[0]
        miss = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * weight
        back = (held * chars.transposed_times(words.transposed_times(miss))).astype(np.float32)
        turn = grams.value.T @ back
        grams.move(lambda rows: np.outer(back[rows], toward) + DECAY * grams.value[rows])
        head.move(lambda rows: (np.stack([-turn, turn], axis=1) + DECAY * head.value)[rows])
        bias.move(lambda rows: np.array([-miss.sum(), miss.sum()], np.float32)[rows])
    adds = held * (grams.value @ (head.value[:, 1] - head.value[:, 0]))
    return ToxicityModel(bucket, adds.astype(np.float32), float(bias.value[1] - bias.value[0]))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> ToxicityModel:
    """A model from the labelled rows outside the held-out fold, at most max_rows of them.

    The executors split the texts and count n-grams. The driver gets numbers only: the buckets of each different word
    once, the numbers of the words of each text, and each bucket's texts per class.
    """
    labelled = training_texts(docs, labels, "toxic", lambda i: remainder(i, FOLDS) != HELD_OUT_FOLD, max_rows)
    bags = stored(training_features(labelled, bag_of_text, "numbers array<bigint>, words array<string>, grams array<int>"), "toxicity-bags")
    n = {(r["y"], r["full"]): r["n"] for r in bags.groupBy("y", (F.size("words") > 0).alias("full")).agg(F.count("*").alias("n")).collect()}
    if not all(n.get((y, True)) for y in (0, 1)):
        return constant(np.repeat([0, 1], [n.get((y, True), 0) + n.get((y, False), 0) for y in (0, 1)]))
    full = bags.where(F.size("words") > 0)
    counts = full.select("y", F.explode("grams").alias("bucket")).groupBy("bucket").agg(
        F.count_if(F.col("y") == 0).alias("c0"), F.count_if(F.col("y") == 1).alias("c1")).orderBy("bucket").toArrow()  # at most BUCKETS rows
    per_text = full.select("doc_id", "y", "numbers").orderBy("doc_id").drop("doc_id").toArrow()
    both = F.explode(F.arrays_zip("numbers", "words")).alias("w")
    words = full.select(both).select("w.numbers", "w.words").dropDuplicates(["numbers"])
    words = words.mapInArrow(_word_grams, "number long, grams array<int>").orderBy("number").toArrow()
    flat = _flat(per_text, words, counts)
    del per_text, words, counts
    return fit_flat(flat)


def _flat(per_text: pa.Table, words: pa.Table, counts: pa.Table) -> Labelled:
    flat = lambda table, name: table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sizes = lambda table, name: pc.list_value_length(table[name]).to_numpy()
    plain = lambda table, name: table[name].to_numpy()
    return Labelled(plain(per_text, "y"), sizes(per_text, "numbers"), flat(per_text, "numbers"), plain(words, "number"),
                    sizes(words, "grams"), flat(words, "grams"), plain(counts, "bucket"),
                    np.stack([plain(counts, "c0"), plain(counts, "c1")]).astype(np.float64))


def _word_grams(batches):
    for b in batches:
        grams = pa.array([gram_buckets(w) for w in b.column(1).to_pylist()], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([b.column(0), grams], names=["number", "grams"])


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row and its whole text.

    NULL and empty texts get the score of the bias alone. Only the text is scored;
    repeated rows get equal scores. The model is broadcast: one number per n-gram bucket, at most BUCKETS.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return score_rows(docs, lambda: shared.value.scorer(), lambda i: remainder_of(i, FOLDS) == HELD_OUT_FOLD, THRESHOLD)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows below the threshold, with all their columns; one pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        score_of = shared.value.scorer()
        for b in batches:
            yield b.filter(pa.array([score_of(t or "") < threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
