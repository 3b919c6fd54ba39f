"""From the subsets of a CSV release to its canonical users and tweets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.functions import values
from erashift.functions.ids import canonical_id
from erashift.operators.cleaning import drop_float_ids, keep_columns, normalise_tweets
from erashift.plans.features import round1_features
from erashift.sources import readers


def with_subset_labels(users: DataFrame, era: str) -> DataFrame:
    """Add the label that the users' subset stands for; NULL for a subset the release does not list."""
    labels = F.create_map(*[F.lit(x) for pair in fv.SUBSET_LABELS[era].items() for x in pair])
    return users.withColumn("label", F.try_element_at(labels, F.col("subset")))


def release_users(raw: DataFrame, era: str) -> DataFrame:
    """Profiles of all subsets (column subset) under canonical names, labelled, times in ISO form."""
    users = with_subset_labels(raw, era).withColumn("user_id", canonical_id(F.col("id"))).withColumn("source", F.lit(era))
    if "created_at" in users.columns:
        users = users.withColumn("created_at", values.long_suffix_time(F.col("created_at")))
    return keep_columns(users, [*fv.USER_KEEP_COLS, "source"])


def release_tweets(raw: DataFrame, users: DataFrame) -> DataFrame:
    """Tweets of the release's users, ids freed from float columns, with retweet and reply flags."""
    tweets = normalise_tweets(drop_float_ids(raw), users)
    return keep_columns(tweets, fv.TWEET_KEEP_COLS)


def read_csv_release(spark: SparkSession, folder: str, era: str) -> tuple[DataFrame, DataFrame]:
    """Users and tweets of a release of CSV subsets; subsets without a tweet file are left out of the tweets."""
    subsets = list(fv.SUBSET_LABELS[era])
    suffix = "" if subsets[0].endswith(".csv") else ".csv"
    told = [s for s in subsets if s not in fv.SUBSETS_WITHOUT_TWEETS]
    users = release_users(readers.read_subset_csv(spark, folder, subsets, "users.csv", suffix=suffix), era)
    tweets = readers.read_subset_csv(spark, folder, told, "tweets.csv", "ISO-8859-1", suffix)
    return users, release_tweets(tweets, users)


def csv_release_features(spark: SparkSession, folder: str, era: str, reference_date: str) -> DataFrame:
    """From a release's CSV folders to its Round 1 features."""
    users, tweets = read_csv_release(spark, folder, era)
    return round1_features(users, tweets, reference_date, dataset=era)
