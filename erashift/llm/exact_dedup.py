"""Exact deduplication by Grace hashing.

Records are partitioned by a hash of their normalised text into as many buckets as
their bytes ask for, so that a bucket fits the open-addressing table of a task, which
compares complete content. Where that takes more buckets than one shuffle should have,
the records first go to spill files by another hash, and each file is partitioned again.
A text that does not fit its table after all goes, with all its copies, to a spill file
too. Copies inside one input batch are folded before the shuffle, so a group that holds
a third of all rows reaches its bucket as a few partial rows.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift import session
from erashift.llm.common import texts

TABLE_BYTES = 64 << 20
MAX_BUCKETS = 20_000  # of one shuffle
_ROW = 200            # bytes counted for a record beside its content
_RECORD = "text_sha256 string, content binary, keep_id long, n long, spilled boolean"


class ContentTable:
    """Open addressing with linear probing; two records are equal only if all their bytes are."""

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0
        self.slots = [-1] * 1024
        self.rows: list[list] = []

    def _find(self, h: int, content: bytes) -> int:
        mask = len(self.slots) - 1
        i = h & mask
        while self.slots[i] >= 0 and self.rows[self.slots[i]][1] != content:
            i = (i + 1) & mask
        return i

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        for k, row in enumerate(self.rows):
            self.slots[self._find(int(row[0][:15], 16), row[1])] = k

    def add(self, sha: str, content: bytes, keep: int | None, n: int) -> bool:
        """Fold a record in; False if its content is new and the table is full."""
        i = self._find(int(sha[:15], 16), content)
        if self.slots[i] >= 0:
            row = self.rows[self.slots[i]]
            row[2] = keep if row[2] is None else row[2] if keep is None else max(row[2], keep)
            row[3] += n
            return True
        if self.rows and self.used + len(content) > self.limit:
            return False
        self.slots[i] = len(self.rows)
        self.rows.append([sha, content, keep, n])
        self.used += len(content) + _ROW
        if 2 * len(self.rows) > len(self.slots):
            self._grow()
        return True


def _batch(rows: list, spilled: bool, with_content: bool) -> pa.RecordBatch:
    sha, content, keep, n = zip(*rows)
    return pa.RecordBatch.from_arrays([
        pa.array(sha, pa.string()), pa.array(content if with_content else [None] * len(rows), pa.binary()),
        pa.array(keep, pa.int64()), pa.array(n, pa.int64()), pa.array([spilled] * len(rows), pa.bool_()),
    ], names=["text_sha256", "content", "keep_id", "n", "spilled"])


def _emit(rows: list, spilled: bool, with_content: bool):
    """Batches of at most about 8 MB."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[1]) if with_content else 100
        if size > 8 << 20:
            yield _batch(part, spilled, with_content)
            part, size = [], 0
    if part:
        yield _batch(part, spilled, with_content)


def normalise(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _fold(batches):
    """One record for each different text of an input batch."""
    for b in batches:
        table, rest = ContentTable(TABLE_BYTES), []
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            content = normalise(text)
            sha = hashlib.sha256(content).hexdigest()
            if not table.add(sha, content, doc, 1):
                rest.append([sha, content, doc, 1])
        yield from _emit(table.rows + rest, True, True)


def _fingerprints(batches):
    for b in batches:
        shas = [hashlib.sha256(normalise(t)).hexdigest() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.string())], names=["doc_id", "text_sha256"])


def _resolve(limit: int):
    def run(batches):
        table = ContentTable(limit)
        for b in batches:
            over = []
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if not table.add(*row):
                    over.append(row)
            yield from _emit(over, True, True)
        yield from _emit(table.rows, False, False)

    return run


def _bytes(content: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.octet_length(content), F.lit(0)) + _ROW), F.lit(0))


def exact_groups(docs: DataFrame, table_bytes: int = TABLE_BYTES, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """One row per different text: text_sha256, keep_id (largest doc_id), group_size.

    table_bytes bounds what a task holds, max_buckets the partitions of a shuffle. The
    depth grows with the logarithm of the data: a level has two buckets for every table
    its bytes fill, or spills into parts of that many buckets. A bucket resolves at least
    one text each time, so it ends. max_buckets is at least 2.
    """
    spark = docs.sparkSession
    root = session.fresh_dir(spark, "grace")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pending = [(docs.mapInArrow(_fold, _RECORD), docs.agg(_bytes("text")).collect()[0][0], 0, False)]
    step = 0
    while pending:
        records, size, level, one_text = pending.pop()
        buckets = math.ceil(2 * size / table_bytes)
        step += 1
        if buckets > max_buckets and not one_text:
            parts = min(max_buckets, math.ceil(buckets / max_buckets))
            spilled = _spill(records, level, parts, max_buckets, session.fresh_dir(spark, f"grace-parts-{step}"))
            pending += [(part, n, level + 1, len(spilled) == 1) for part, n in spilled]  # copies cannot be parted
            continue
        path = f"{root}/step={step}"
        dealt = records.repartition(min(max_buckets, max(1, buckets, least)), F.xxhash64(F.lit(level), "text_sha256"))
        dealt.mapInArrow(_resolve(table_bytes), _RECORD).write.partitionBy("spilled").parquet(path)
        over = spark.read.schema(_RECORD).parquet(path).where("spilled")
        size = over.agg(_bytes("content")).collect()[0][0]
        if size:
            pending.append((over, size, level + 1, False))
    return spark.read.schema(_RECORD + ", step int").parquet(root).where(~F.col("spilled")).select(
        "text_sha256", "keep_id", F.col("n").alias("group_size"))


def _spill(records: DataFrame, level: int, parts: int, tasks: int, path: str) -> list[tuple[DataFrame, int]]:
    """Spill files by a hash of the level: a table for each part that has records, with its bytes."""
    part = F.pmod(F.xxhash64(F.lit(level), "text_sha256"), F.lit(parts))
    inside = F.xxhash64(F.lit(f"{level} inside"), "text_sha256")
    share = F.pmod(inside, F.lit(max(1, tasks // parts)))  # several tasks write a part, each task few parts
    records.withColumn("part", part).repartition(tasks, "part", share).write.partitionBy("part").parquet(path)
    out = records.sparkSession.read.schema(_RECORD + ", part long").parquet(path)
    sizes = out.groupBy("part").agg(_bytes("content").alias("size")).collect()  # one row a part
    return [(out.where(F.col("part") == row["part"]).drop("part"), row["size"]) for row in sizes]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Every row with its group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after lower-casing A-Z; NULL counts as empty. Of a
    group the row with the largest doc_id stays. Rows without a doc_id never stay
    unless the whole group has none; then keep_id is NULL and none is kept. A row
    that is repeated with its doc_id counts each time.
    """
    docs = texts(docs, id_col, text_col)
    groups = exact_groups(docs, table_bytes)
    rows = docs.mapInArrow(_fingerprints, "doc_id long, text_sha256 string")
    return rows.join(groups, "text_sha256").select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
