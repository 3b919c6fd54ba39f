"""Shards by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import digits_for, running_total

_HASH_RANGE = float(2**53)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the highest score -weight / ln(u), u drawn from (key, shard).

    A key's scores do not depend on the other shards, so one more shard only takes
    keys into itself. A NULL key scores like any other key.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    scores = []
    for i, w in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11) + F.lit(0.5)) / F.lit(_HASH_RANGE)
        scores.append(F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(i).alias("shard")))
    return F.array_max(F.array(*scores))["shard"] if len(scores) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, shards: int | Sequence[float] = 16, grown_weight: float = 1.0,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    shards: a number of equal shards or their weights; grown_weight: that of the
    shard added for grown_shard. size is the text's UTF-8 bytes plus 1 (NULL: 1), text_crc32
    that of the text (NULL as empty: 0). Slots of a shard run from 0 without gaps,
    ordered by a hash of the id, so no shard is ever ordered in one task. Repeated
    rows share a shard and have slots of their own.
    """
    weights = [1.0] * shards if isinstance(shards, int) else list(shards)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.col("doc_id")
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    digits = digits_for(docs.count())
    rows = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        rendezvous_shard(key, weights).alias("shard"), rendezvous_shard(key, [*weights, grown_weight]).alias("grown_shard"),
        F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, digits).alias("_bucket"))
    placed = running_total(rows, ["shard"], "_bucket", [key, F.col("text_crc32"), F.col("size")], F.lit(1), "_nth")
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", (F.col("_nth") - 1).cast("long").alias("slot"),
                         "grown_shard")
