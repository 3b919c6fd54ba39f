"""Large CSV files and JSON arrays read in parts: one file is shared by as many tasks as it has blocks.

Spark's text source cuts a file into blocks at a separator. A piece between two separators need not be a record: a
quoted field may hold line breaks, an object may hold braces. What a piece means depends only on a count carried from
the pieces before it (quotes so far, open braces so far), so every block is summed by itself, the sums of the earlier
blocks of its file are added, and the records fall out. Records inside a block are put together where the block is;
only the fragments at block borders, at most two per block, meet across blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRING = r'"(?:[^"\\]|\\.)*+(?:"|$)'  # a JSON string, or what is left of one that goes on in the next piece


def _pieces(spark: SparkSession, path, separator: str, encoding: str) -> DataFrame:
    """file, block, at (order inside the block), piece."""
    raw = spark.read.option("lineSep", separator).text(path)
    piece = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), piece.alias("piece"))


def _before(df: DataFrame, value: Column, out: str) -> DataFrame:
    """Adds the sum of value over the earlier pieces of the same file."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    inside = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    counted = df.withColumn("_v", value)
    carried = counted.groupBy("file", "block").agg(F.sum("_v").alias("_sum")).select(
        "file", "block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"))
    return counted.join(carried, ["file", "block"]).withColumn(
        out, F.col("_carried") + F.coalesce(F.sum("_v").over(inside), F.lit(0))).drop("_carried", "_v")


def _records(pieces: DataFrame, ends: Column, separator: str) -> DataFrame:
    """file, record (its number in the file), text: the pieces up to and with one that ends a record, joined again.

    Pieces after a file's last end are a record too.
    """
    numbered = _before(pieces.withColumn("ends", ends.cast("int")), F.col("ends"), "record")
    fragments = numbered.groupBy("file", "block", "record").agg(
        F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("p"), F.max("ends").alias("ends"))
    fragments = fragments.select("file", "block", "record", "ends", F.array_join("p.piece", separator).alias("text"))
    # the first fragment of a block may begin, and the last one end, in another block
    outer = Window.partitionBy("file", "block")
    fragments = fragments.withColumn("border", (F.col("record") == F.min("record").over(outer)) | (F.col("ends") == 0))
    whole = fragments.where(~F.col("border")).select("file", "record", "text")
    split = fragments.where("border").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p")).select(
        "file", "record", F.array_join("p.text", separator).alias("text"))
    return whole.unionByName(split)


def csv_records(spark: SparkSession, path, encoding: str = "UTF-8") -> DataFrame:
    """file, record, text of every CSV record; a line ends a record if the quotes up to its end are even."""
    lines = _pieces(spark, path, "\n", encoding)
    quotes = F.octet_length("piece") - F.octet_length(F.replace("piece", F.lit('"'), F.lit("")))
    counted = _before(lines.withColumn("quotes", quotes), F.col("quotes"), "quotes_before")
    return _records(counted, (F.col("quotes_before") + F.col("quotes")) % 2 == 0, "\n").withColumn("text", F.regexp_replace("text", "\r$", ""))


_CSV = {"quote": '"', "escape": '"', "multiLine": "true"}


def csv_columns(spark: SparkSession, path, encoding: str = "UTF-8") -> list[str]:
    """The header of a CSV file; only its first lines are read."""
    return spark.read.options(header=True, inferSchema=False, encoding=encoding, **_CSV).csv(path).columns


def read_csv_split(spark: SparkSession, path, encoding: str = "UTF-8", columns: list[str] | None = None, file_col: str | None = None) -> DataFrame:
    """A CSV file, or files of one header, every column as text; equal rows for every block size.

    As with Spark's own multi-line reader, quotes inside a field are doubled, blank lines are no records, and an empty
    field is NULL, quoted or not. columns saves reading the header; file_col adds the path of the file.
    """
    columns = columns or csv_columns(spark, path, encoding)
    fields = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(columns))])
    rows = csv_records(spark, path, encoding).where((F.col("record") > 0) & (F.trim("text") != ""))
    parsed = rows.select("file", F.from_csv("text", fields.simpleString()[7:-1].replace(":", " "), _CSV).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(c) for k, c in enumerate(columns)], *([F.col("file").alias(file_col)] if file_col else []))


def json_array_records(spark: SparkSession, path) -> DataFrame:
    """file, record, text of every object of a JSON array, or of objects one after the other.

    The text is cut at closing braces. Quotes before a piece tell whether it begins inside a string; outside of strings
    opening braces are counted, and a closing one that leaves none open ends an object. A brace is never escaped in
    JSON, so no escape is cut apart.
    """
    pieces = _pieces(spark, path, "}", "UTF-8")
    bare = F.regexp_replace("piece", r"\\.", "")
    quotes = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit('"'), F.lit("")))
    counted = _before(pieces.withColumn("quotes", quotes), F.col("quotes"), "quotes_before")
    closed = (F.col("quotes_before") + F.col("quotes")) % 2 == 0  # the brace after the piece is no part of a string
    inside = F.when(F.col("quotes_before") % 2 == 1, F.concat(F.lit('"'), "piece")).otherwise(F.col("piece"))
    opened = F.regexp_count(F.regexp_replace(inside, _STRING, ""), F.lit(r"\{"))
    change = (opened - closed.cast("int")).cast("long")
    deep = _before(counted.withColumn("change", change).withColumn("closed", closed), F.col("change"), "depth")
    ends = F.col("closed") & (F.col("depth") + F.col("change") == 0)
    found = _records(deep.select("file", "block", "at", "piece", ends.alias("ends")), F.col("ends"), "}")
    return found.withColumn("text", F.concat(F.regexp_replace("text", r"^[\s,\[]+", ""), F.lit("}"))).where(F.col("text").startswith("{"))


def read_json_array_split(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """The objects of JSON arrays under a schema, with the name of their file."""
    rows = json_array_records(spark, path).select("file", F.from_json("text", schema).alias("r")).where("r is not null")
    return rows.select("r.*", F.element_at(F.split("file", "/"), -1).alias("_file_name"))


def csv_table(spark: SparkSession, name: str, path, encoding: str = "UTF-8") -> None:
    """Make a CSV file a table of spark.sql() under its own header."""
    read_csv_split(spark, path, encoding).createOrReplaceTempView(name)
