"""Profiling tables over the users and tweets of all eras.

Rows whose group key is NULL are left out, as a cross-tabulation would.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.functions import text, values
from erashift.operators.order_stats import exact_quantiles, hash_order

def _count() -> Column:
    return F.count(F.lit(1))


def _with_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.dropna(subset=keys)


def users_union(frames: dict[str, DataFrame]) -> DataFrame:
    """All eras' users in one frame; a column an era lacks is NULL there."""
    tagged = [df.withColumn("dataset", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def tweets_union(frames: dict[str, DataFrame]) -> DataFrame:
    cols = ["tweet_id", "user_id", "text", "created_at", "in_reply_to_user_id"]
    tagged = [df.select(*cols, F.lit(name).alias("dataset")) for name, df in frames.items()]
    return reduce(DataFrame.unionByName, tagged)


def distinct_tweeters(tweets: DataFrame) -> DataFrame:
    return tweets.select("dataset", "user_id").distinct()


def dataset_sizes(users: DataFrame, tweets: DataFrame) -> DataFrame:
    """Users, rows, tweets, tweeting users and their ratios per era.

    Distinct counts run in two steps, per user and then per era, so an era
    that holds most rows is spread over its users.
    """
    def per_user(df: DataFrame, rows: str, distinct: str) -> DataFrame:
        by_user = _with_keys(df, ["dataset"]).groupBy("dataset", "user_id").agg(_count().alias("n"))
        known = F.col("user_id").isNotNull()
        return by_user.groupBy("dataset").agg(
            F.count_if(known).alias(distinct), F.sum("n").alias(f"all_{rows}"),
            F.sum(F.when(known, F.col("n")).otherwise(0)).alias(rows),
        )

    u = per_user(users, "user_rows", "users").drop("all_user_rows")
    t = per_user(tweets, "known", "tweeting_users").drop("known").withColumnRenamed("all_known", "tweets")
    return u.join(t, "dataset", "left").withColumns({
        "tweets_per_user": F.round(F.try_divide(F.col("tweets"), F.col("users")), 2),
        "pct_users_with_tweets": F.round(F.try_divide(F.col("tweeting_users"), F.col("users")) * 100, 2),
    })


def crosstab(df: DataFrame, keys: list[str], total: str = "All") -> DataFrame:
    """Counts by all keys, with totals per key: (keys..., n). Totals read 'All'.

    Counts once, then adds grouping sets over the few counted rows.
    """
    counts = _with_keys(df, keys).groupBy(*keys).agg(_count().alias("n"))
    cubed = counts.cube(*keys).agg(
        F.sum("n").alias("total"), *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    return cubed.select(
        *[F.when(F.col(f"_g_{k}") == 1, total).otherwise(F.col(k).cast("string")).alias(k) for k in keys],
        F.col("total").alias("n"),
    )


def crosstab_wide(df: DataFrame, row: str, col: str, col_values: list[str]) -> DataFrame:
    """crosstab() with one column per value of `col` and an 'All' column."""
    tall = crosstab(df, [row, col])
    return tall.groupBy(row).pivot(col, [*col_values, "All"]).agg(F.first("n")).fillna(0)


def label_percentages(df: DataFrame) -> DataFrame:
    counts = _with_keys(df, ["dataset", "label"]).groupBy("dataset", "label").agg(_count().alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("dataset"))
    return counts.select("dataset", "label", F.round(share * 100, 2).alias("pct"))


def header_presence(frames: dict[str, DataFrame]) -> dict[str, dict[str, bool]]:
    """column -> {era: is it in the header?}"""
    columns = sorted({c for df in frames.values() for c in df.columns})
    return {c: {name: c in df.columns for name, df in frames.items()} for c in columns}


def column_presence(users: DataFrame, eras: list[str]) -> DataFrame:
    """Which column holds any value in which era, and in how many eras."""
    cols = [c for c in users.columns if c != "dataset"]
    held = users.groupBy("dataset").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in cols])
    tall = held.unpivot(["dataset"], cols, "column", "present")
    wide = tall.groupBy("column").pivot("dataset", eras).agg(F.max(F.col("present").cast("int"))).fillna(0)
    count = reduce(lambda a, b: a + b, [F.col(f"`{e}`") for e in eras])
    return wide.withColumn("num_datasets", count).orderBy(F.desc("num_datasets"), "column")


def missingness(users: DataFrame) -> DataFrame:
    """Missing values per era and column, only where any is missing."""
    cols = users.columns
    users = _with_keys(users, ["dataset"])
    counted = users.groupBy("dataset").agg(
        _count().alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols])
    tall = counted.unpivot(["dataset", "_rows"], [f"n_{c}" for c in cols], "column", "missing_count")
    pct = F.round(F.col("missing_count") / F.col("_rows") * 100, 2)
    return (
        tall.select("dataset", F.expr("substring(column, 3)").alias("column"), "missing_count",
                    pct.alias("missing_pct"))
        .filter("missing_pct > 0").orderBy("dataset", F.desc("missing_pct"))
    )


def tweet_coverage(users: DataFrame, tweets: DataFrame) -> DataFrame:
    """users with a has_tweets_in_file flag."""
    seen = distinct_tweeters(tweets).withColumn("_seen", F.lit(True))
    return users.join(seen, ["dataset", "user_id"], "left").withColumn(
        "has_tweets_in_file", F.coalesce("_seen", F.lit(False))).drop("_seen")


def coverage_by_label(covered: DataFrame) -> DataFrame:
    share = F.avg(F.col("has_tweets_in_file").cast("int")) * 100
    return _with_keys(covered, ["dataset", "label"]).groupBy("dataset", "label").agg(
        F.round(share, 2).alias("pct_with_tweets"))


def metadata_stats(users: DataFrame) -> DataFrame:
    """Mean, exact median and sample deviation of the counts by (dataset, label):
    rows (dataset, label, col, mean, median, std)."""
    keys = ["dataset", "label"]
    cols = [c for c in fv.COUNT_COLS if c in users.columns]
    counts = _with_keys(users, keys).select(*keys, *[values.number_column(users, c).alias(c) for c in cols])
    tall = counts.unpivot(keys, cols, "col", "value").groupBy(*keys, "col").agg(
        F.round(F.avg("value"), 2).alias("mean"), F.round(F.stddev_samp("value"), 2).alias("std"))
    medians = exact_quantiles(counts, keys, cols, [0.5])
    return tall.join(medians, [*keys, "col"], "left").select(
        *keys, "col", "mean", F.round("value", 2).alias("median"), "std")


def preview_features(users: DataFrame) -> DataFrame:
    """Mean follower ratio (NULL friends give NULL) and bio rate by group."""
    followers, friends = (values.number_column(users, c) for c in ("followers_count", "friends_count"))
    ratio = F.try_divide(followers, friends + 1)
    return _with_keys(users, ["dataset", "label"]).groupBy("dataset", "label").agg(
        F.round(F.avg(ratio), 3).alias("ff_ratio_preview"),
        F.round(F.avg(values.has_text(F.col("description"))), 3).alias("has_bio_preview"),
    )


def tweet_preview(tweets: DataFrame, users: DataFrame) -> DataFrame:
    """Tweet text rates by (dataset, label).

    Tweets are summed up per user first, so the join sees one row per user.
    """
    body = text.text_or_empty(F.col("text"))
    reply = F.coalesce(F.length(F.col("in_reply_to_user_id").cast("string")) > 0, F.lit(False))
    per_user = tweets.groupBy("dataset", "user_id").agg(
        _count().alias("n"),
        F.sum(F.length(body)).alias("chars"),
        F.count_if(body.rlike(fv.URL_PREVIEW_PATTERN)).alias("urls"),
        F.count_if(body.startswith(fv.RETWEET_PREFIX)).alias("retweets"),
        F.count_if(reply).alias("replies"),
    )
    labels = _with_keys(users.select("dataset", "user_id", "label"), ["label"])
    n = F.sum("n")
    return per_user.join(labels, ["dataset", "user_id"]).groupBy("dataset", "label").agg(
        F.round(F.sum("chars") / n, 3).alias("avg_text_length_preview"),
        F.round(F.sum("urls") / n, 3).alias("url_rate_preview"),
        F.round(F.sum("retweets") / n, 3).alias("retweet_rate_preview"),
        F.round(F.sum("replies") / n, 3).alias("reply_rate_preview"),
        n.alias("sampled_tweets"),
    )


def duplicate_keys(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier (dataset, user_id)."""
    per_key = df.groupBy("dataset", "user_id").agg(_count().alias("n")).filter("n > 1")
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def graph_summary(df: DataFrame) -> DataFrame:
    """Mean, median and max of in-degree and PageRank per era."""
    cols = ["graph_in_degree", "graph_pagerank"]
    return group_summary(df, ["dataset"], cols)


def group_summary(df: DataFrame, keys: list[str], cols: list[str], digits: int = 4) -> DataFrame:
    df = _with_keys(df, keys)
    tall = (
        df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot(keys, cols, "col", "value").groupBy(*keys, "col")
        .agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.max("value"), digits).alias("max"))
    )
    medians = exact_quantiles(df, keys, cols, [0.5])
    return tall.join(medians, [*keys, "col"], "left").select(
        *keys, "col", "mean", F.round("value", digits).alias("median"), "max")


def describe_columns(df: DataFrame, cols: list[str], digits: int = 3) -> DataFrame:
    """count, mean, std, min, exact quartiles and max per column."""
    base = df.select(F.lit("all").alias("scope"), *[F.col(c).cast("double").alias(c) for c in cols])
    tall = base.unpivot(["scope"], cols, "col", "value").groupBy("scope", "col").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    marks = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    quartiles = exact_quantiles(base, ["scope"], cols, list(marks.values())).groupBy("scope", "col").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name) for name, p in marks.items()])
    rounded = [F.round(c, digits).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")]
    return tall.join(quartiles, ["scope", "col"], "left").select("col", "n", *rounded)


def round1_rates(df: DataFrame) -> DataFrame:
    """Share of users with tweets and of unknown retweet and reply ratios."""
    return _with_keys(df, ["dataset"]).groupBy("dataset").agg(
        F.round(F.avg("has_tweet_data"), 3).alias("has_tweet_data_rate"),
        F.round(F.avg(F.col("retweet_ratio").isNull().cast("int")), 3).alias("retweet_null_rate"),
        F.round(F.avg(F.col("reply_ratio").isNull().cast("int")), 3).alias("reply_null_rate"),
    )


def flag_rates(tweets: DataFrame) -> DataFrame:
    """One row: mean of the two tweet flags."""
    return tweets.agg(
        F.round(F.avg("is_retweet"), 3).alias("is_retweet_rate"),
        F.round(F.avg("is_reply"), 3).alias("is_reply_rate"),
    )


def stratum_sample(
    frames: dict[tuple[str, str], tuple[DataFrame, str]], n: int = fv.STRATUM_SAMPLE_SIZE, seed: int = fv.SEED,
) -> DataFrame:
    """Up to n rows per (dataset, file type): {(dataset, file_type): (frame, key column)}.

    A limit of n per stratum is cut on every partition before anything moves.
    """
    parts = []
    for (dataset, file_type), (df, key) in frames.items():
        rest = sorted(df.columns)
        picked = df.withColumn("_h", hash_order(seed, F.col(key))).orderBy("_h", *rest).limit(n).drop("_h")
        parts.append(picked.select(F.lit(dataset).alias("dataset"), F.lit(file_type).alias("file_type"), "*"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def stratum_sample_by(df: DataFrame, strata: list[str], key: str, n: int, seed: int = fv.SEED) -> DataFrame:
    """The same for strata that are columns; Spark prunes to n rows per stratum
    and partition before the shuffle (window group limit)."""
    order = Window.partitionBy(*strata).orderBy("_h", key)
    return (
        df.withColumn("_h", hash_order(seed, F.col(key))).withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n).drop("_h", "_n")
    )
