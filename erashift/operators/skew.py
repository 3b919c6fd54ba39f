"""Joins and broadcasts that stay balanced when one key holds much of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift.session import cut

HOT_ROWS = 1_000_000        # a key with more rows than this is split
MAX_HOT_KEYS = 10_000       # size of the broadcast list of split keys
MAX_BROADCAST_ROWS = 1_000_000


def _rows_per(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def hot_keys(counts: DataFrame, keys: list[str], rows: str = "_rows", hot_rows: int | None = None) -> DataFrame | None:
    """Keys with more than hot_rows rows and into how many parts to split each,
    from a table of row counts; None when there is none.

    At most MAX_HOT_KEYS rows, stored once. A hot key beyond that is joined
    unsplit, so the limit never changes a result.
    """
    hot_rows = hot_rows or HOT_ROWS
    parts = F.ceil(F.col(rows) / hot_rows).cast("int").alias("_parts")
    hot = cut(
        counts.filter(F.col(rows) > hot_rows).orderBy(F.desc(rows), *keys).limit(MAX_HOT_KEYS).select(*keys, parts)
    )
    return None if hot.isEmpty() else hot


def salt_rows(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Spread the rows of each hot key over its parts by a hash of the row."""
    spread = F.pmod(F.xxhash64(*df.columns), F.coalesce("_parts", F.lit(1)))
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", spread.cast("int")).drop("_parts")
    )


def salt_lookup(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """Repeat the lookup row of each hot key once per part."""
    parts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    return (
        df.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(parts)).drop("_parts")
    )


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], hot: DataFrame | None, how: str = "left",
) -> DataFrame:
    """Join a table with hot keys to a lookup table (inner, left or left_semi)."""
    if hot is None:
        return left.join(right, keys, how)
    return (
        salt_rows(left, hot, keys).join(salt_lookup(right, hot, keys), [*keys, "_salt"], how).drop("_salt")
    )


def skew_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", hot_rows: int | None = None,
) -> DataFrame:
    """salted_join() after counting the rows of every key of `left`."""
    return salted_join(left, right, keys, hot_keys(_rows_per(left, keys), keys, hot_rows=hot_rows), how)


def is_bounded(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    # a plain count: one number per task, while limit() would first move the
    # rows it keeps of every partition to one task
    return df.count() <= max_rows


def lookup_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
    max_rows: int = MAX_BROADCAST_ROWS, hot_rows: int | None = None,
) -> DataFrame:
    """Broadcast the lookup side after counting it; beyond max_rows, skew_join."""
    if is_bounded(right, max_rows):
        return left.join(F.broadcast(right), keys, how)
    return skew_join(left, right, keys, how, hot_rows)


def stored_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Compute a per-group summary once; broadcast it if it is small, else let joins shuffle it."""
    stored = cut(df)
    return F.broadcast(stored) if is_bounded(stored, max_rows) else stored


def eras_of(df: DataFrame) -> list[str]:
    """The distinct eras, sorted: one name per release."""
    rows = df.select("dataset").filter("dataset is not null").distinct().collect()
    return sorted(r["dataset"] for r in rows)
