"""Streaming ingest: the sink must equal the batch result."""

from pyspark.sql import functions as F

from erashift import session
from erashift.catalog.ingest import V2_TWEETS_SQL, _v2_labels, v2_raw_tweets
from erashift.catalog.registry import query
from erashift.operators.cleaning import v2_tweet_columns
from erashift.streaming import tweets as streaming


def _tweet_stream(t):
    events = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{t.sf_dir}/events*.parquet")
    return v2_raw_tweets(events)


@query("stream_tweet_ingest", V2_TWEETS_SQL)
def stream_tweet_ingest(t):
    out, state = session.fresh_dir(t.spark, "tweets"), session.fresh_dir(t.spark, "state")
    streaming.stream_tweet_ingest(_tweet_stream(t), _v2_labels(t), out, state).awaitTermination()
    return t.spark.read.parquet(out)


@query("stream_running_totals", f"""
select count(*) as tweets, cast(sum(is_retweet) as bigint) as retweets, cast(sum(is_reply) as bigint) as replies from ({V2_TWEETS_SQL})
""")
def stream_running_totals(t):
    out, state = session.fresh_dir(t.spark, "totals"), session.fresh_dir(t.spark, "state")
    tweets = streaming.known_only(v2_tweet_columns(_tweet_stream(t)), _v2_labels(t))
    streaming.stream_running_totals(tweets, out, state).awaitTermination()
    totals = streaming.running_totals(t.spark, out)
    return totals.agg(*[F.max(c).alias(c) for c in ("tweets", "retweets", "replies")])
