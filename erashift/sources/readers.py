"""Readers for raw releases and canonical tables. Schemas are explicit."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from erashift import schemas
from erashift.sources.records import csv_columns, read_csv_split, read_json_array_split


def read_text_csv(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """A CSV under its own header, every column as text; one file is shared by several tasks."""
    return read_csv_split(spark, path, encoding)


def read_users(spark: SparkSession, path: str) -> DataFrame:
    """Canonical users CSV. Columns it lacks are absent, not NULL."""
    return _known(read_text_csv(spark, path), schemas.USERS_CSV)


def read_tweets(spark: SparkSession, path: str) -> DataFrame:
    return _known(read_text_csv(spark, path), schemas.TWEETS_CSV)


def as_tables(frames: dict[str, DataFrame]) -> None:
    """Make frames available to spark.sql() under their names."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def _known(df: DataFrame, schema: T.StructType) -> DataFrame:
    names = [c for c in schema.names if c in df.columns]
    return df.select(*names, *[c for c in df.columns if c not in names])


def read_subset_csv(
    spark: SparkSession, folder: str, subsets: dict[str, str] | list[str], file: str,
    encoding: str = "UTF-8", suffix: str = "",
) -> DataFrame:
    """<folder>/<subset><suffix>/<file> for each subset, tagged with subset and,
    where subsets carry labels, with label. Subsets with the same header are read together."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for subset in subsets:
        path = f"{folder}/{subset}{suffix}/{file}"
        by_header.setdefault(tuple(csv_columns(spark, path, encoding)), []).append(path)
    home = F.regexp_extract("_file", rf"/([^/]+){re.escape(suffix)}/{re.escape(file)}(?:/[^/]*)?$", 1)
    parts = []
    for header, paths in by_header.items():
        df = read_csv_split(spark, paths, encoding, list(header), "_file").withColumn("subset", home).drop("_file")
        if isinstance(subsets, dict):
            names = F.create_map(*[F.lit(x) for pair in subsets.items() for x in pair])
            df = df.withColumn("label", F.try_element_at(names, F.col("subset")))
        parts.append(df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_nested_records(
    spark: SparkSession, folder: str, splits: list[str] | None = None, multi_line: bool = True,
) -> DataFrame:
    """<folder>/<split>.json; `subset` is the split. Arrays (multi_line) and JSON lines are both shared by several
    tasks per file."""
    paths = [f"{folder}/{s}.json" for s in splits] if splits else f"{folder}/*.json"
    if multi_line:
        raw = read_json_array_split(spark, paths, schemas.NESTED_RECORD).withColumnRenamed("_file_name", "_name")
    else:
        raw = spark.read.schema(schemas.NESTED_RECORD).json(paths).withColumn("_name", F.col("_metadata.file_name"))
    return raw.withColumn("subset", F.regexp_extract("_name", r"^(.*)\.json$", 1)).drop("_name")


def read_v2_users(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array_split(spark, path, schemas.V2_USER).drop("_file_name")


def read_v2_tweets(spark: SparkSession, path, multi_line: bool = True) -> DataFrame:
    """Tweet shards: JSON arrays (multi_line) or JSON lines, both shared by several tasks per file."""
    if multi_line:
        return read_json_array_split(spark, path, schemas.V2_TWEET).drop("_file_name")
    return spark.read.schema(schemas.V2_TWEET).json(path)


def read_pairs_csv(spark: SparkSession, path: str, second: str) -> DataFrame:
    """Two-column CSV (labels, splits) as (user_id, second), whatever its header."""
    df = read_text_csv(spark, path)
    return df.select(F.col(df.columns[0]).alias("user_id"), F.col(df.columns[1]).alias(second))


def read_edge_csv(spark: SparkSession, path: str) -> DataFrame:
    header = spark.read.option("header", True).csv(path).columns
    if set(header) != {"source_id", "relation", "target_id"}:
        raise ValueError(f"unexpected edge columns: {header}")
    kinds = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(kinds).option("header", True).csv(path).select("source_id", "target_id", "relation")


# Column names that hold (source, target) in the two kinds of edge file.
_LAYOUTS = {
    "friends.csv": [("source_id", "target_id"), ("user_id", "friend_id")],
    "followers.csv": [("source_id", "target_id"), ("follower_id", "user_id")],
}
_RELATIONS = {"friends.csv": "friend", "followers.csv": "follower"}


def resolve_edge_columns(columns: list[str], file: str) -> tuple[str, str] | None:
    """Named layouts first, else the first two columns."""
    lower = {c.lower(): c for c in columns}
    for source, target in _LAYOUTS[file]:
        if source in lower and target in lower:
            return lower[source], lower[target]
    return (columns[0], columns[1]) if len(columns) >= 2 else None


def read_edge_dirs(spark: SparkSession, folder: str) -> DataFrame:
    """friends.csv and followers.csv of every subset directory below folder.

    Directories are listed through the file system Spark itself uses, so any
    store works.
    """
    parts = []
    for path in _list_files(spark, f"{folder}/*/*.csv"):
        file = path.rsplit("/", 1)[-1]
        if file not in _RELATIONS:
            continue
        df = spark.read.option("header", True).csv(path)
        ends = resolve_edge_columns(df.columns, file)
        if ends is None:
            continue
        parts.append(df.select(
            F.col(ends[0]).cast("string").alias("source_id"), F.col(ends[1]).cast("string").alias("target_id"),
            F.lit(_RELATIONS[file]).alias("relation"), F.lit(path.rsplit("/", 2)[-2]).alias("subset"),
        ))
    if not parts:
        return spark.createDataFrame([], "source_id string, target_id string, relation string, subset string")
    return reduce(DataFrame.unionByName, parts)


def _list_files(spark: SparkSession, pattern: str) -> list[str]:
    files = spark.read.format("binaryFile").load(pattern).select("path").collect()
    return sorted(r["path"] for r in files)
