"""Benchmark decontamination by size-partitioned MinHash containment search.

A document contains a test item if it has at least a threshold share of the item's
different five-word shingles. Items are short and documents long, so signatures of
whole documents would never agree with an item's; instead each item is represented
by its smallest shingle hashes, as many as its size class needs: of any
(1 - threshold) of an item's shingles plus one, a document that contains the item
has at least one. Documents probe these minima with all their shingles, and the
candidates are verified by counting the item's shingles, compared as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift.llm.common import ORPHAN, stored

SHINGLE_WORDS = 5
THRESHOLD_PCT = 80
BROADCAST_ROWS = 1_000_000  # of numbers or short shingles; larger tables are joined by shuffle
_NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), _NOT_WORD), "")


def _starts(ws: Column) -> Column:
    n = F.size(ws) - SHINGLE_WORDS
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(ws: Column) -> Column:
    # ws must be a stored column: a lambda computes its outer expressions for each element. For the same
    # reason the arrays are unpacked by explode_outer, for which no filter is inferred and pushed into ws.
    return F.transform(_starts(ws), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(SHINGLE_WORDS)]))


def shingle_texts(ws: Column) -> Column:
    return F.transform(_starts(ws), lambda i: F.array_join(F.slice(ws, i + 1, SHINGLE_WORDS), " "))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def item_shingles(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """item_id, shingle, n: the different shingles of every item and their number.

    Rows that share an item_id are one item. Items of under five words have none
    and are never found.
    """
    rows = items.select(items[item_id].cast("long").alias("item_id"), words(items[item_text]).alias("w"))
    each = rows.select("item_id", F.explode_outer(shingle_texts(F.col("w"))).alias("shingle")).where("shingle is not null").distinct()
    sizes = each.groupBy("item_id").agg(F.count("*").alias("n"))
    return each.join(sizes.withColumnRenamed("item_id", "_item"), F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "shingle", "n")


def minima(shingles: DataFrame, threshold_pct: int) -> DataFrame:
    """item_id, hash, least: each item's smallest hashes, and the shingles a document needs at least.

    Items of one size class (n up to the same power of two) keep the same number.
    """
    hashed = shingles.select("item_id", "n", F.xxhash64(*[F.get(F.split("shingle", " "), i) for i in range(SHINGLE_WORDS)]).alias("hash"))
    upper = F.pow(F.lit(2), F.ceil(F.log2("n"))).cast("long")
    kept = F.floor(upper * (100 - threshold_pct) / 100) + 1
    by_item = hashed.groupBy("item_id", "n").agg(F.sort_array(F.collect_list("hash")).alias("all"))  # an item's own, short
    return by_item.select("item_id", F.explode(F.slice("all", 1, kept.cast("int"))).alias("hash"),
                          F.ceil(upper / 2 * threshold_pct / 100).cast("int").alias("least"))


def _row_key(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """What a row is judged by: its id and a hash of its text, so that rows of one or no id stay apart."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(ORPHAN)), F.xxhash64(docs[text_col].cast("string"))


def _contaminated(docs: DataFrame, items: DataFrame, threshold_pct: int, id_col: str, text_col: str, item_id: str, item_text: str) -> DataFrame:
    """_doc, _row, item_id, n, n_shared of the pairs at or above the threshold."""
    shingles = stored(item_shingles(items, item_id, item_text), "item-shingles")
    index = stored(minima(shingles, threshold_pct), "item-minima")
    n_index, n_shingles = index.count(), shingles.count()
    doc, row = _row_key(docs, id_col, text_col)
    rows = docs.select(doc.alias("_doc"), row.alias("_row"), words(docs[text_col]).alias("_w"))
    probes = rows.select("_doc", "_row", shingle_hashes(F.col("_w")).alias("_all"))
    probes = probes.select("_doc", "_row", F.size("_all").alias("_n"), F.explode_outer("_all").alias("_hash"))
    hits = probes.join(_sized(index, n_index), F.col("_hash") == F.col("hash"))
    candidates = stored(hits.groupBy("_doc", "_row", "item_id").agg(F.sum("_n").alias("_room"), F.max("least").alias("least"))
                        .where("_room >= least").drop("_room", "least"), "candidates")
    ids = candidates.select(F.col("_doc").alias("_cand"), F.col("_row").alias("_cand_row")).distinct()
    n_ids = ids.count()
    suspected = rows.join(_sized(ids, n_ids), (F.col("_doc") == F.col("_cand")) & (F.col("_row") == F.col("_cand_row")), "left_semi")
    texts = suspected.select("_doc", "_row", F.explode_outer(F.array_distinct(shingle_texts(F.col("_w")))).alias("_shingle"))
    shared = texts.join(_sized(shingles, n_shingles), F.col("_shingle") == F.col("shingle")).groupBy("_doc", "_row", "item_id", "n").agg(
        F.count_distinct("shingle").alias("n_shared"))
    found = shared.where(F.col("n_shared") * 100 >= F.col("n") * threshold_pct)
    pairs = candidates.select(F.col("_doc").alias("_d"), F.col("_row").alias("_r"), F.col("item_id").alias("_i"))
    same = (F.col("_doc") == F.col("_d")) & (F.col("_row") == F.col("_r")) & F.col("item_id").eqNullSafe(F.col("_i"))
    return found.join(pairs, same, "left_semi")


def find_contaminated(docs: DataFrame, items: DataFrame, threshold_pct: int = THRESHOLD_PCT, id_col: str = "doc_id",
                      text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) at or above the threshold.

    NULL, empty and very short texts contain nothing. Every row is judged by itself,
    whether it shares its doc_id or has none; rows equal in id and text give one pair.
    The query's SQL takes rows of one doc_id together, which is the same for unique ids.
    """
    found = _contaminated(docs, items, threshold_pct, id_col, text_col, item_id, item_text)
    return found.select(F.nullif("_doc", F.lit(ORPHAN)).alias("doc_id"), "item_id", F.col("n").alias("n_item"), "n_shared",
                        (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold_pct: int = THRESHOLD_PCT, id_col: str = "doc_id",
                  text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with all their columns; every row is judged by itself."""
    found = _contaminated(docs, items, threshold_pct, id_col, text_col, item_id, item_text)
    bad = stored(found.select(F.col("_doc").alias("_bad"), F.col("_row").alias("_bad_row")).distinct(), "contaminated")
    doc, row = _row_key(docs, id_col, text_col)
    return docs.join(_sized(bad, bad.count()), (doc == F.col("_bad")) & (row == F.col("_bad_row")), "left_anti")
