import pytest

from erashift import fixed_values as fv
from erashift.operators import accounts as acc
from erashift.operators import profile
from erashift.plans.features import round1_features


def users(spark, **override):
    base = dict(user_id="1.0", label="bot", followers_count="10", friends_count=None, statuses_count="x",
                listed_count="-3", created_at="2020-01-01T12:00:00Z", verified="1.0", description="   ")
    base.update(override)
    schema = ", ".join(f"{k} string" for k in base)
    return spark.createDataFrame([tuple(base.values())], schema)


def test_unknown_is_null_and_zero_is_measured(spark):
    r = acc.account_features(users(spark), "2020-01-03", "e").first()
    assert (r["user_id"], r["followers_count"], r["friends_count"], r["statuses_count"]) == ("1", 10.0, None, None)
    assert r["account_age_days"] == 1.0 and r["followers_per_day"] == 5.0 and r["ff_ratio"] == 10.0
    assert r["log1p_friends"] is None and r["log1p_listed"] == 0.0
    assert (r["has_bio"], r["has_location"], r["verified"]) == (0, None, None)


def test_dates(spark):
    future = acc.account_features(users(spark, created_at="2030-01-01"), "2020-01-03", "e").first()
    assert future["account_age_days"] == 0.0
    old_style = acc.account_features(users(spark, created_at="Wed Jan 01 12:00:00 +0000 2020"), "2020-01-03", "e").first()
    assert old_style["account_age_days"] == 1.0
    unknown = acc.account_features(users(spark, created_at="?"), "2020-01-03", "e").first()
    assert unknown["account_age_days"] is None and unknown["followers_per_day"] == 10.0


def test_one_reference_date_per_era(spark):
    both = users(spark).selectExpr("*", "'a' as dataset").unionByName(users(spark).selectExpr("*", "'b' as dataset"))
    got = acc.account_features(both, {"a": "2020-01-03", "b": "2020-01-11"}).collect()
    assert {r["dataset"]: r["account_age_days"] for r in got} == {"a": 1.0, "b": 9.0}


def test_negative_one_friend(spark):
    assert acc.account_features(users(spark, friends_count="-1"), "2020-01-03", "e").first()["ff_ratio"] is None


def test_absent_tweet_columns_give_null(spark):
    bare = spark.createDataFrame([("1", "RT @x #a"), ("1", None), (None, "lost")], "user_id string, text string")
    r, = acc.tweet_user_aggregates(bare).collect()
    assert (r["tweet_count_actual"], r["retweet_ratio"], r["reply_ratio"]) == (2, 0.5, None)
    assert r["tweet_active_days"] is None and r["avg_hashtags"] == 0.5 and r["avg_text_length"] == 4.0


def test_flag_columns_win_over_text(spark):
    t = spark.createDataFrame([("1", "RT @x", 0, 1), ("1", "y", 0, None)], "user_id string, text string, is_retweet int, is_reply int")
    r, = acc.tweet_user_aggregates(t).collect()
    assert (r["retweet_ratio"], r["reply_ratio"]) == (0.0, 1.0)


def test_times_are_strict_by_default(spark):
    t = spark.createDataFrame(
        [("1", "a", "2020-01-01"), ("1", "b", "2020-01-03"), ("2", "c", "Wed Aug 27 13:08:45 +0000 2008"), ("2", "d", "2020-01-01")],
        "user_id string, text string, created_at string")
    days = {r["user_id"]: r["tweet_active_days"] for r in acc.tweet_user_aggregates(t).collect()}
    assert days == {"1": 2.0, "2": 1.0}
    loose = {r["user_id"]: r["tweet_active_days"] for r in acc.tweet_user_aggregates(t, strict_times=False).collect()}
    assert loose["2"] > 4000


def test_users_without_tweets(spark):
    tweets = spark.createDataFrame([("9", "x")], "user_id string, text string")
    r = round1_features(users(spark), tweets, "2020-01-03", "e").first()
    assert (r["has_tweet_data"], r["tweet_count_actual"], r["tweets_per_day"], r["log1p_tweet_count"]) == (0, 0, 0.0, 0.0)
    assert r["avg_text_length"] is None and r["source"] is None


def test_mask_follows_the_tweet_columns(spark):
    tweets = spark.createDataFrame([("1", "RT @x")], "user_id string, text string")
    assert round1_features(users(spark), tweets, "2020-01-03", "twibot_2022").first()["retweet_ratio"] is None
    flagged = spark.createDataFrame([("1", "x", 1)], "user_id string, text string, is_retweet int")
    assert round1_features(users(spark), flagged, "2020-01-03", "twibot_2022").first()["retweet_ratio"] == 1.0
    assert acc.unavailable_features({"twibot_2020": ["is_retweet"], "twibot_2022": ["created_at", "is_reply"]})["retweet_ratio"] == ["twibot_2022"]


def test_each_era_follows_its_own_header(spark):
    old = spark.createDataFrame([("old", "1", "RT @x")], "dataset string, user_id string, text string")
    new = spark.createDataFrame([("new", "1", "RT @x", 0, 1), ("new", "1", "y", None, 0)],
                                "dataset string, user_id string, text string, is_retweet int, is_reply int")
    both = old.unionByName(new, allowMissingColumns=True)
    got = {r["dataset"]: (r["retweet_ratio"], r["reply_ratio"]) for r in acc.tweet_user_aggregates(both).collect()}
    assert got == {"old": (1.0, None), "new": (0.0, 0.5)}
    empty_header = {"old": ["text"], "new": ["text"]}
    got = {r["dataset"]: r["retweet_ratio"] for r in acc.tweet_user_aggregates(both, headers=empty_header).collect()}
    assert got == {"old": 1.0, "new": 0.5}


def test_canonical_columns_come_first(spark):
    df = spark.createDataFrame([(1, "u")], "extra int, user_id string")
    out = acc.canonical_schema(df, "e")
    assert out.columns == [*fv.META_COLS, *fv.ROUND1_COLS, "extra"]
    assert acc.missing_features(df) == fv.ROUND1_COLS


def test_crosstab_margins(spark, rows):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", None)], "dataset string, label string")
    assert rows(profile.crosstab_wide(df, "dataset", "label", ["x", "y"]), "dataset", "x", "y", "All") == [
        ("All", 2, 1, 3), ("a", 1, 1, 2), ("b", 1, 0, 1)]


def test_header_presence_and_union(spark):
    frames = {"a": spark.createDataFrame([("1",)], "user_id string"), "b": spark.createDataFrame([("2", "t")], "user_id string, bio string")}
    assert profile.header_presence(frames)["bio"] == {"a": False, "b": True}
    assert {(r["dataset"], r["bio"]) for r in profile.users_union(frames).collect()} == {("a", None), ("b", "t")}


def test_stratum_sample_of_frames(spark):
    users_, tweets = spark.range(40).selectExpr("string(id) as user_id"), spark.range(9).selectExpr("string(id) as tweet_id", "'t' as text")
    out = profile.stratum_sample({("e", "users"): (users_, "user_id"), ("e", "tweets"): (tweets, "tweet_id")})
    assert {r["file_type"]: r["count"] for r in out.groupBy("file_type").count().collect()} == {"users": 25, "tweets": 9}


def test_repeated_user_is_reported(spark):
    from erashift.operators.contracts import validate_frame

    df = spark.createDataFrame([("a", "1", 1.0), ("a", "1", 2.0)], "dataset string, user_id string, x double")
    assert profile.duplicate_keys(df).first()[0] == 1
    with pytest.raises(ValueError):
        validate_frame(df, ["x"])
    with pytest.raises(ValueError):
        validate_frame(df, ["y"])
