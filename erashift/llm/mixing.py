"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erashift.llm.common import digits_for, running_total, stored

WEIGHTS = (3, 1, 2)
BUDGET_SHARE = 1.5
MOST_REPEATS = 2
_PER_SLICE = 5_000


def source_targets(sizes: DataFrame, weights: Sequence[float], budget_share: float, most: int) -> DataFrame:
    """source, source_size, target from (source, source_size), one row per source.

    Sources in code point order, NULL last, take the weights in turn and share
    budget_share of all words. A target stops at most times its source; what it
    leaves is shared again by weight. Sorted by the level at which each source is
    full, the full ones are a prefix, so one running sum finds them.
    """
    ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = ranked.select("source", "source_size", (F.lit(float(most)) * F.col("source_size")).alias("_cap"),
                           F.get(turn, F.col("_n") % len(weights)).alias("_w"), "_n")
    order = [F.col("_cap") / F.col("_w"), F.col("_n")]
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))
    left = F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(earlier), F.lit(0.0))
    level = (F.lit(float(budget_share)) * F.sum("source_size").over(all_rows) - before) / left
    ranked = ranked.withColumn("_level", level).withColumn("_full", F.col("_cap") / F.col("_w") <= F.col("_level"))
    shared = F.max(F.when(~F.col("_full"), F.col("_level"))).over(all_rows)  # levels fall from the first open source on
    return ranked.withColumn("_shared", shared).select(
        "source", "source_size", F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_shared") * F.col("_w")).alias("target"))


def last_finish(copies: DataFrame, budget: float, slices: int) -> float | None:
    """The largest virtual finish time up to which all copies fit the budget; None if all fit.

    Finish times are cut into ranges; only the range in which the budget runs out
    is sorted.
    """
    timed = copies.where(F.col("finish").isNotNull()).select("finish", "size", F.floor(F.col("finish") * slices).alias("range"))
    per_range = timed.groupBy("range").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    crossing = per_range.withColumn("upto", upto).where(F.col("upto") > budget).orderBy("range").limit(1).collect()
    if not crossing:
        return None
    cut = crossing[0]
    inside = Window.orderBy("finish").rangeBetween(Window.unboundedPreceding, 0)
    fits = (timed.where(F.col("range") == cut["range"])
            .withColumn("upto", F.sum("size").over(inside) + F.lit(cut["upto"] - cut["n"]))
            .where(F.col("upto") <= budget).agg(F.max("finish").alias("f")).collect()[0]["f"])
    return fits if fits is not None else math.nextafter(cut["range"] / slices, -1.0)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, budget_share: float = BUDGET_SHARE,
                most: int = MOST_REPEATS, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", row_key: Column | None = None) -> DataFrame:
    """Every row with doc_id, source, size, source_size, target, copies, taken, and row_key if one is given.

    size counts the words of the text (NULL: 0). A source's documents queue in the
    order of a hash of their id, the whole queue up to most times; a copy's finish
    time is the queued words of its source up to and with it, divided by the
    source's target. Copies are served in the order of finish times until the
    total budget is reached, so every source ends near its target. Documents
    without words are taken zero times over. Reruns agree; which of several rows equal
    in id and size is taken is definite only with a row_key.
    """
    extra = [] if row_key is None else [row_key.cast("long").alias("row_key")]
    keys = ["row_key"] * len(extra)
    rows = docs.select(
        *extra, docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))
    rows = stored(rows.withColumn("_order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-rows")
    n = rows.count()
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, budget_share, most), "mix-targets")
    rows = rows.withColumn("_bucket", F.substring("_order", 1, digits_for(n)))
    queued = running_total(rows, ["source"], "_bucket", [F.col(c) for c in ("_order", "doc_id", "size", *keys)], F.col("size"), "_queued")
    targets = targets.withColumnRenamed("source", "_source")
    queued = queued.join(targets, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_order", "_bucket")
    queued = stored(queued, "mix-queue")

    def finish(copy):
        return F.when(F.col("target") > 0, (copy * F.col("source_size") + F.col("_queued")) / F.col("target"))

    copies = queued.select("size", "source_size", "target", "_queued", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_copy"))
    budget = targets.agg(F.sum("target").alias("t")).collect()[0]["t"] or 0.0
    end = last_finish(copies.select("size", finish(F.col("_copy")).alias("finish")), budget, max(1, n * most // _PER_SLICE))
    served = [F.coalesce(finish(F.lit(c)) <= F.lit(end), F.lit(False)) if end is not None else F.col("target") > 0 for c in range(most)]
    taken = sum((s.cast("long") for s in served[1:]), served[0].cast("long"))
    return queued.select(*keys, "doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"),
                         "target", F.coalesce(taken, F.lit(0)).alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """Each row of docs, with all its columns, as many times as the mix takes that row; equal rows share their copies."""
    def key(df):
        return F.xxhash64(*[df[c] for c in df.columns])

    def repeated(df, taken):
        same = (key(df) == F.col("_mix_key")) & df[id_col].cast("long").eqNullSafe(F.col("_mix_id")) & df[source_col].cast("string").eqNullSafe(F.col("_mix_source"))
        copies = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))
        return df.join(taken, same).select(*[df[c] for c in df.columns], copies.alias("_copy")).drop("_copy")

    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, row_key=key(docs), **how)
    taken = stored(mixed.groupBy(F.col("row_key").alias("_mix_key"), F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source")).agg(
        F.sum("copies").alias("_mix_copies"), F.count("*").alias("_mix_rows")).where("_mix_copies > 0"), "mix-taken")
    out, several = repeated(docs, taken.where("_mix_rows = 1")), taken.where("_mix_rows > 1")
    if several.isEmpty():
        return out
    alike = docs.join(several.select(F.col("_mix_key").alias("_mix_several")), key(docs) == F.col("_mix_several"), "left_semi").dropDuplicates()
    return out.unionByName(repeated(alike, several))
