"""Incremental ingest of tweet shards, shard by shard, with running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from erashift import schemas
from erashift.operators.cleaning import known_ids, v2_tweet_columns
from erashift.operators.skew import is_bounded

MAX_STATIC_IDS = 5_000_000
SPREAD = 16


def shard_stream(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """New shards below path, one file per micro-batch."""
    return (
        spark.readStream.schema(schemas.V2_TWEET).option("multiLine", multi_line)
        .option("maxFilesPerTrigger", 1).json(path)
    )


def known_only(tweets: DataFrame, labels: DataFrame) -> DataFrame:
    """Tweets of labelled accounts. The labels are broadcast once they are known
    to be few enough; otherwise both sides are shuffled, every account over
    SPREAD parts, since a stream cannot be searched for hot accounts first."""
    ids = known_ids(labels)
    if is_bounded(ids, MAX_STATIC_IDS):
        return tweets.join(F.broadcast(ids), "user_id", "left_semi")
    part = F.pmod(F.xxhash64("tweet_id"), F.lit(SPREAD)).cast("int")
    parts = ids.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return tweets.withColumn("_part", part).join(parts, ["user_id", "_part"], "left_semi").drop("_part")


def stream_tweet_ingest(
    raw: DataFrame, labels: DataFrame, out: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Append the normalised tweets of labelled accounts to Parquet, exactly once."""
    tweets = known_only(v2_tweet_columns(raw), labels)
    return start_append(tweets, out, checkpoint, available_now)


def start_append(tweets: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = tweets.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(out)


def stream_running_totals(
    tweets: DataFrame, out: str, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Per micro-batch a row (batch, tweets, retweets, replies), keyed by batch so
    that a replayed batch overwrites itself; running_totals() adds them up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.agg(
            F.count(F.lit(1)).alias("tweets"), F.coalesce(F.sum("is_retweet"), F.lit(0)).alias("retweets"),
            F.coalesce(F.sum("is_reply"), F.lit(0)).alias("replies"),
        ).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = tweets.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def running_totals(spark: SparkSession, out: str) -> DataFrame:
    """Totals so far after each batch (one small row per shard)."""
    so_far = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    per_batch = spark.read.parquet(out)
    return per_batch.select("batch", *[F.sum(c).over(so_far).alias(c) for c in ("tweets", "retweets", "replies")])
