"""What the two classifiers share: the split by id, the labelled rows, scoring."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from erashift.llm.common import stored, texts
from erashift.operators.skew import is_bounded

MAX_TRAIN_ROWS = 6_000  # labelled rows the toxicity model is fitted on, at most


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a missing id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def remainder_of(doc_id: int | None, n: int) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def _known(labels: DataFrame, label: str, usable: Callable[[Column], Column]) -> DataFrame:
    """_doc, _y: one row per usable labelled id."""
    known = labels.select(labels["doc_id"].cast("long").alias("_doc"), labels[label].cast("int").alias("_y")).dropna()
    return known.where(usable(F.col("_doc"))).groupBy("_doc").agg(F.max("_y").alias("_y"))


def all_training_features(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column],
                          features: Callable[[str], tuple], schema: str) -> DataFrame:
    """doc_id, y and what features(text) returns for every labelled document.

    No text is shuffled: the labels are broadcast if they are few, else features are made first and labels join them.
    """
    known = stored(_known(labels, label, usable).where(F.col("_y").isin(0, 1)), f"{label}-known")
    rows = texts(docs).where("text is not null").where(usable(F.col("doc_id")))
    few = is_bounded(known)
    if few:
        rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_doc"))
    given = F.col("_y") if few else F.lit(0)
    made = training_features(rows.select("doc_id", given.alias("y"), F.sha2("text", 256).alias("digest"), "text"), features, schema)
    if few:
        return made
    return made.drop("y").join(known, F.col("doc_id") == F.col("_doc")).withColumn("y", F.col("_y")).drop("_doc", "_y")


def training_texts(docs: DataFrame, labels: DataFrame, label: str, usable: Callable[[Column], Column], max_rows: int) -> DataFrame:
    """doc_id, y, digest (SHA-256), text of at most max_rows labelled documents, chosen by a hash of their id.

    Half of the sample goes to each class if it has that many; a document that is labelled more than once counts as 1
    if any row says so. Texts are whole, of any length, stay on the executors and are dealt evenly to them.
    """
    known = _known(labels, label, usable)
    by_hash = F.xxhash64("_doc")
    parts = [known.where(F.col("_y") == y).orderBy(by_hash, "_doc").limit(max_rows // 2) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most max_rows pairs of numbers
    rows = texts(docs).where("text is not null").join(chosen, F.col("doc_id") == F.col("_doc"))
    spread = 4 * docs.sparkSession.sparkContext.defaultParallelism
    return stored(rows.select("doc_id", F.col("_y").alias("y"), F.sha2("text", 256).alias("digest"), "text").repartition(spread, "doc_id"), f"{label}-texts")


def training_features(rows: DataFrame, features: Callable[[str], tuple], schema: str) -> DataFrame:
    """doc_id, y and what features(text) returns for each document of training_texts(); no text goes further.

    Of several texts with one id the one with the smallest SHA-256 counts.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [t.type for t in to_arrow_schema(StructType.fromDDL(schema))]

    def run(batches):
        for b in batches:
            made = list(zip(*map(features, b.column(3).to_pylist()))) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(m, t) for m, t in zip(made, kinds))],
                                             names=["doc_id", "y", "digest", *names])

    made = rows.mapInArrow(run, f"doc_id long, y int, digest string, {schema}")
    first = F.min(F.struct("digest", *names)).alias("first")
    return made.groupBy("doc_id", "y").agg(first).select("doc_id", "y", *[F.col(f"first.{n}").alias(n) for n in names])


def score_rows(docs: DataFrame, scorer: Callable[[], Callable[[str], float]], held_out: Callable[[int | None], bool],
               threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; scorer() is made once per task."""
    def run(batches):
        score_of = scorer()
        for b in batches:
            ids = b.column(0).to_pylist()
            scores = [score_of(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(scores, pa.float64()),
                pa.array([int(s >= threshold) for s in scores], pa.int32()),
            ], names=["doc_id", "held_out", "score", "predicted"])

    return texts(docs).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
