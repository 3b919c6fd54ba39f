"""Helpers shared by the text operators: column handling, word hashing, prefix sums."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from erashift import session

SPACE = b" \t\n\x0b\x0c\r"  # what separates words; bytes.split() and bytes.strip() use the same six
ORPHAN = 2**63 - 1          # rows without an id count as one document after all others

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE)] = True
_BYTE[_IS_SPACE] = 0
_CHUNK = 1 << 20
_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only: extra columns, whatever their names, stay out of the operators."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df below the cluster's shared folder and go on from the written table."""
    return _written(df, session.fresh_dir(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables that one job stores one after another.

    The shuffle files of a table go when it is written, not when the driver happens to collect
    its garbage; the tables go when the job drops them. So the disk holds one step at a time.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = session.fresh_dir(self.spark, name)
        was = self.spark.conf.get(_CLEAN_SHUFFLES, "false")
        self.spark.conf.set(_CLEAN_SHUFFLES, "true")
        try:
            return _written(df, path)
        finally:
            self.spark.conf.set(_CLEAN_SHUFFLES, was)

    def drop(self, *names: str) -> None:
        """Delete stored tables, of which nothing is read any more."""
        for name in names:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def powers(n: int, base=_BASE) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hash_run(buf: bytes) -> np.ndarray:
    a = np.frombuffer(buf, np.uint8)
    space = _IS_SPACE[a]
    first = ~space
    first[1:] &= space[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.empty(0, np.uint64)
    a = a[starts[0]:]
    starts -= starts[0]
    lengths = np.diff(starts, append=len(a))
    offset = np.arange(len(a)) - np.repeat(starts, lengths)
    return mix(np.add.reduceat(_BYTE[a] * powers(int(lengths.max()))[offset], starts))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word, in order. Long texts are hashed in runs cut at a space."""
    if len(text) <= _CHUNK:
        return _hash_run(text)
    parts, at = [], 0
    while at < len(text):
        end = min(len(text), at + _CHUNK)
        while end < len(text) and text[end] not in SPACE:
            end += 1
        parts.append(_hash_run(text[at:end]))
        at = end
    return np.concatenate(parts)


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k consecutive entries."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _MIX2 + h[j:j + n]
    return mix(out)


def digits_for(rows: int, per_bucket: int = 50_000) -> int:
    """Hex digits of a hash prefix that leave at most about per_bucket rows to each prefix."""
    return max(1, math.ceil(math.log(max(1, rows / per_bucket), 16)))


def running_total(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column,
                  out: str) -> DataFrame:
    """Running sum of value inside each group, in the order (bucket, order), this row included.

    A group never meets in one task: each (group, bucket) is summed on its own and
    raised by the totals of the buckets before it, of which there is one row each.
    """
    keys = [*group, bucket]
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    offsets = totals.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
                            F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    joined = df.join(offsets, same, "left").drop(*[f"_key{i}" for i in range(len(keys))])
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(value).over(inside)).drop("_before")
