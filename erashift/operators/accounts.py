"""Round 1: account features, per-user tweet aggregates and their merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.functions import text, values
from erashift.functions.ids import canonical_id

_RATES = {
    "followers_per_day": "followers_count",
    "friends_per_day": "friends_count",
    "statuses_per_day": "statuses_count",
    "listed_per_day": "listed_count",
}
_LOGS = {
    "log1p_followers": "followers_count",
    "log1p_friends": "friends_count",
    "log1p_statuses": "statuses_count",
    "log1p_listed": "listed_count",
}


def _literal_map(by_era: dict[str, str] | str) -> Column:
    if isinstance(by_era, str):
        return F.lit(by_era)
    out = None
    for era, value in by_era.items():
        hit = F.col("dataset") == era
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def account_features(
    users: DataFrame, reference_date: str | dict[str, str], dataset: str | None = None,
) -> DataFrame:
    """Meta columns and the 18 account features; absent inputs give NULL columns.

    One era (`dataset` given) or all eras at once (`dataset` column in the
    frame, one reference date or one per era). A pure projection: no shuffle.
    """
    have = set(users.columns)
    if dataset is not None:
        users = users.withColumn("dataset", F.lit(dataset))

    def if_present(name: str, expr: Column, kind: str) -> Column:
        return expr if name in have else F.lit(None).cast(kind)

    base = users.withColumns(
        {c: values.number_column(users, c) if c in have else F.lit(None).cast("double") for c in fv.COUNT_COLS}
    )
    if "created_at" in have:
        day = _literal_map(reference_date).cast("timestamp")
        age = values.whole_days_between(day, values.time_column(users, "created_at"))
        age = values.clip_low(age, 0).cast("double")
    else:
        age = F.lit(None).cast("double")
    base = base.withColumn("account_age_days", age)

    per_day = F.coalesce("account_age_days", F.lit(0.0)) + 1
    features = {
        **{name: values.log1p_clipped(F.col(c)) for name, c in _LOGS.items()},
        **{name: F.col(c) / per_day for name, c in _RATES.items()},
        # a friends count of -1 makes the divisor zero
        "ff_ratio": F.try_divide(
            F.col("followers_count"), F.coalesce("friends_count", F.lit(0.0)) + 1),
        "has_bio": if_present("description", values.has_text(F.col("description")), "int"),
        "has_location": if_present("location", values.has_text(F.col("location")), "int"),
        "has_default_pic": if_present(
            "default_profile_image", values.flag(F.col("default_profile_image")), "int"),
        "verified": if_present("verified", values.flag(F.col("verified")), "int"),
    }
    meta = [c for c in ("label", "subset", "source") if c in have]
    return base.select(
        "dataset", canonical_id(F.col("user_id")).alias("user_id"), *meta,
        *[features[c].alias(c) if c in features else F.col(c) for c in fv.ACCOUNT_COLS],
    )


def era_headers(tweets: DataFrame) -> dict[str, list[str]]:
    """Which optional tweet columns each era of a frame has.

    In a union of releases every era has every column, so an era counts as having
    one if any of its rows has a value there. One pass over the optional columns,
    one row per era.
    """
    optional = sorted({*fv.PROOF_COLUMN.values(), "is_retweet", "is_reply", "in_reply_to_user_id"} & set(tweets.columns))
    if not optional:
        return {r["dataset"]: [] for r in tweets.select("dataset").distinct().collect()}
    seen = tweets.groupBy("dataset").agg(*[F.count(c).alias(c) for c in optional]).collect()
    return {r["dataset"]: [c for c in optional if r[c]] for r in seen}


def _per_era(rules: list[tuple[str, Column]], otherwise: Column, have: set[str], headers: dict[str, list[str]] | None) -> Column:
    """For each era the first rule whose column it has."""
    out = otherwise
    for column, rule in reversed([r for r in rules if r[0] in have]):
        if headers is None:
            out = rule
        else:
            eras = sorted(e for e, columns in headers.items() if e is not None and column in columns)
            out = F.when(F.col("dataset").isin(eras), rule).otherwise(out) if eras else out
    return out


def tweet_user_aggregates(
    tweets: DataFrame, strict_times: bool = True, headers: dict[str, list[str]] | None = None,
) -> DataFrame:
    """One row per user (per era, if the frame has `dataset`) with tweet statistics.

    Optional columns that an era lacks give NULL, never zero. headers names the
    columns of each era; a frame with `dataset` and without headers is asked for
    them (era_headers), one without `dataset` is one era with its own columns. All
    aggregates combine map-side, so a user with very many tweets does not
    make a slow task. Rows without a user are left out.
    """
    have = set(tweets.columns)
    keys = [c for c in ("dataset", "user_id") if c in have]
    null_double = F.lit(None).cast("double")
    if headers is None and "dataset" in have and have & {"is_retweet", "is_reply", "in_reply_to_user_id"}:
        headers = era_headers(tweets)
    retweet = _per_era([("is_retweet", F.col("is_retweet").cast("int"))], text.retweet_flag(F.col("text")), have, headers)
    reply = _per_era([("is_reply", F.col("is_reply").cast("int")),
                      ("in_reply_to_user_id", text.reply_flag(F.col("in_reply_to_user_id")))], null_double, have, headers)
    if "created_at" in have:
        at = values.time_column(tweets, "created_at", strict_times)
    else:
        at = F.lit(None).cast("timestamp")

    body = F.col("text")
    rows = tweets.withColumn("user_id", canonical_id(F.col("user_id"))).filter("user_id is not null")
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tweet_count_actual"),
        F.avg(F.length(text.text_or_empty(body))).alias("avg_text_length"),
        F.avg(retweet).alias("retweet_ratio"),
        F.avg(reply).alias("reply_ratio"),
        F.avg(text.hashtags(body)).alias("avg_hashtags"),
        F.avg(text.mentions(body)).alias("avg_mentions"),
        F.avg(text.urls(body)).alias("avg_urls"),
        F.min(at).alias("first_tweet_at"),
        F.max(at).alias("last_tweet_at"),
    )
    span = values.days_between(F.col("last_tweet_at"), F.col("first_tweet_at"))
    return agg.withColumn("tweet_active_days", values.clip_low(span, 1.0))


def round1_merge(accounts: DataFrame, tweet_aggregates: DataFrame) -> DataFrame:
    """Accounts left-joined to tweet aggregates, with the derived activity columns."""
    keys = [c for c in ("dataset", "user_id") if c in tweet_aggregates.columns]
    right = tweet_aggregates.withColumn("_seen", F.lit(1))
    merged = accounts.join(right, keys, "left")
    if "tweet_active_days" not in merged.columns:
        merged = merged.withColumn("tweet_active_days", F.lit(None).cast("double"))
    merged = merged.withColumns({
        "has_tweet_data": F.coalesce("_seen", F.lit(0)),
        "tweet_count_actual": F.coalesce("tweet_count_actual", F.lit(0)),
    }).drop("_seen")
    return merged.withColumns({
        "log1p_tweet_count": F.log1p(F.col("tweet_count_actual").cast("double")),
        "tweets_per_day": tweets_per_day(),
    })


def tweets_per_day() -> Column:
    """Per active day, or per day of account age where no tweet time is known."""
    n = F.col("tweet_count_actual")
    age = values.clip_low(F.col("account_age_days"), 0.0)
    return F.coalesce(n / F.col("tweet_active_days"), n / (F.coalesce(age, F.lit(0.0)) + 1))


def unavailable_features(headers: dict[str, list[str]]) -> dict[str, list[str]]:
    """feature -> eras that cannot support it, given the columns the tweets of each era have."""
    out: dict[str, list[str]] = {}
    for era, features in fv.UNAVAILABLE.items():
        for feature in features:
            if fv.PROOF_COLUMN[feature] not in headers.get(era, ()):
                out.setdefault(feature, []).append(era)
    return out


def availability_mask(df: DataFrame, unavailable: dict[str, list[str]]) -> DataFrame:
    """Overwrite with NULL what an era cannot support. `unavailable`: feature -> eras."""
    masked = {
        feature: F.when(~F.col("dataset").isin(eras), F.col(feature))
        for feature, eras in unavailable.items() if feature in df.columns
    }
    return df.withColumns(masked) if masked else df


def canonical_schema(df: DataFrame, dataset: str | None = None) -> DataFrame:
    """Meta and the 29 features first (absent ones as NULL), other columns behind."""
    if dataset is not None:
        df = df.withColumn("dataset", F.lit(dataset))
    block = fv.META_COLS + fv.ROUND1_COLS
    kind = {c: "string" for c in fv.META_COLS}
    head = [
        F.col(c) if c in df.columns else F.lit(None).cast(kind.get(c, "double")).alias(c)
        for c in block
    ]
    return df.select(*head, *[c for c in df.columns if c not in block])


def missing_features(df: DataFrame, cols: list[str] = fv.ROUND1_COLS) -> list[str]:
    return [c for c in cols if c not in df.columns]


def sample_with_replies(round1: DataFrame, n: int = fv.PREVIEW_SIZE) -> DataFrame:
    """First n users, by key, with a positive reply ratio."""
    return round1.filter("reply_ratio > 0").orderBy("dataset", "user_id").limit(n)
