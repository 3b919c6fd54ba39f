"""Round 1 features."""

from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.catalog.fixtures import REFERENCE_DATE, SQL_VIEWS
from erashift.catalog.registry import query, rounded
from erashift.functions import text as tx
from erashift.operators import accounts, cleaning, order_stats, profile
from erashift.plans.features import round1_features

SQL_VIEWS["ox_accounts"] = f"""
select dataset, user_id, label, followers_count, friends_count, statuses_count, listed_count,
  ln(1 + case when followers_count < 0 then 0 else followers_count end) as log1p_followers,
  ln(1 + case when friends_count < 0 then 0 else friends_count end) as log1p_friends,
  ln(1 + case when statuses_count < 0 then 0 else statuses_count end) as log1p_statuses,
  ln(1 + case when listed_count < 0 then 0 else listed_count end) as log1p_listed,
  followers_count / (coalesce(age, 0) + 1) as followers_per_day, friends_count / (coalesce(age, 0) + 1) as friends_per_day,
  statuses_count / (coalesce(age, 0) + 1) as statuses_per_day, listed_count / (coalesce(age, 0) + 1) as listed_per_day,
  age as account_age_days, followers_count / (coalesce(friends_count, 0) + 1) as ff_ratio,
  case when trim(description) <> '' then 1 else 0 end as has_bio, cast(null as integer) as has_location,
  cast(null as integer) as has_default_pic,
  case when lower(trim(verified)) in ('1', 'true') then 1 when lower(trim(verified)) in ('0', 'false') then 0 end as verified
from (select *, case when days < 0 then 0.0::double else days end as age from (
  select *, floor((epoch_us(timestamp '{REFERENCE_DATE}') - epoch_us(created_at)) / 86400000000.0::double) as days from fx_users))
"""

SQL_VIEWS["ox_tweet_agg"] = r"""
select *, case when span < 1 then 1.0::double else span end as tweet_active_days from (
  select dataset, user_id, count(*) as tweet_count_actual, avg(length(coalesce(text, ''))) as avg_text_length,
    avg(case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end) as retweet_ratio,
    avg(case when trim(coalesce(in_reply_to_user_id, '')) not in ('', '0', 'nan', 'None') then 1 else 0 end) as reply_ratio,
    avg(len(regexp_extract_all(coalesce(text, ''), '#[A-Za-z0-9_]+'))) as avg_hashtags,
    avg(len(regexp_extract_all(coalesce(text, ''), '@[A-Za-z0-9_]+'))) as avg_mentions,
    avg(len(regexp_extract_all(coalesce(text, ''), 'http[^ ]+'))) as avg_urls,
    min(created_at) as first_tweet_at, max(created_at) as last_tweet_at,
    (epoch_us(max(created_at)) - epoch_us(min(created_at))) / 86400000000.0::double as span
  from fx_era_tweets group by dataset, user_id)
"""

SQL_VIEWS["ox_round1"] = """
select a.*, coalesce(t.tweet_count_actual, 0) as tweet_count_actual,
  ln(1 + coalesce(t.tweet_count_actual, 0)::double) as log1p_tweet_count,
  coalesce(t.tweet_count_actual / t.tweet_active_days,
    coalesce(t.tweet_count_actual, 0) / (coalesce(a.account_age_days, 0) + 1)) as tweets_per_day,
  t.tweet_active_days, t.avg_text_length, t.retweet_ratio, t.avg_hashtags, t.avg_mentions, t.avg_urls, t.reply_ratio,
  case when t.user_id is null then 0 else 1 end as has_tweet_data
from ox_accounts a left join ox_tweet_agg t on t.dataset = a.dataset and t.user_id = a.user_id
"""

INT_COLS = ["has_bio", "has_location", "has_default_pic", "verified", "tweet_count_actual", "has_tweet_data"]


def sql_list(cols):
    """Select list with doubles rounded to 6 digits."""
    return ", ".join(c if c in INT_COLS else f"round({c}, 6) as {c}" for c in cols)


def accounts_of(t):
    return accounts.account_features(t.fx_users, REFERENCE_DATE)


def aggregates_of(t):
    return accounts.tweet_user_aggregates(t.fx_era_tweets)


def merged_of(t):
    return accounts.round1_merge(accounts_of(t), aggregates_of(t))


def round1_of(t):
    return round1_features(t.fx_users, t.fx_era_tweets, REFERENCE_DATE)


@query("account_features", f"select dataset, user_id, label, {sql_list(fv.ACCOUNT_COLS)} from ox_accounts")
def account_features(t):
    return rounded(accounts_of(t))


_AGG = ["avg_text_length", "retweet_ratio", "reply_ratio", "avg_hashtags", "avg_mentions", "avg_urls"]


@query("tweet_user_aggregates", f"""
select dataset, user_id, tweet_count_actual, {sql_list(_AGG)}, epoch_us(first_tweet_at) as first_us,
  epoch_us(last_tweet_at) as last_us, round(tweet_active_days, 6) as tweet_active_days from ox_tweet_agg
""")
def tweet_user_aggregates(t):
    agg = rounded(aggregates_of(t))
    return agg.select(
        "dataset", "user_id", "tweet_count_actual", *_AGG, F.unix_micros("first_tweet_at").alias("first_us"),
        F.unix_micros("last_tweet_at").alias("last_us"), "tweet_active_days")


@query("round1_merge", f"select dataset, user_id, label, {sql_list(fv.ROUND1_COLS)} from ox_round1")
def round1_merge(t):
    return rounded(merged_of(t)).select("dataset", "user_id", "label", *fv.ROUND1_COLS)


@query("canonical_schema", f"""
select dataset, user_id, label, cast(null as varchar) as subset, cast(null as varchar) as source,
  {sql_list(fv.ROUND1_COLS)}, round(span, 6) as extra_span from ox_round1 left join
  (select dataset, user_id, span from ox_tweet_agg) using (dataset, user_id)
""")
def canonical_schema(t):
    span = (F.unix_micros("last_tweet_at") - F.unix_micros("first_tweet_at")) / F.lit(86400e6)
    with_extra = merged_of(t).withColumn("extra_span", span).drop("first_tweet_at", "last_tweet_at")
    return rounded(accounts.canonical_schema(with_extra))


@query("availability_mask", """
select dataset, user_id, case when dataset <> 'BUILDING' then round(retweet_ratio, 6) end as retweet_ratio,
  case when dataset not in ('MACHINERY', 'FURNITURE') then round(reply_ratio, 6) end as reply_ratio,
  case when dataset not in ('MACHINERY') then round(tweet_active_days, 6) end as tweet_active_days,
  round(tweets_per_day, 6) as tweets_per_day from ox_round1
""")
def availability_mask(t):
    unavailable = {"retweet_ratio": ["BUILDING"], "reply_ratio": ["MACHINERY", "FURNITURE"],
                   "tweet_active_days": ["MACHINERY"]}
    masked = round1_features(t.fx_users, t.fx_era_tweets, REFERENCE_DATE, unavailable=unavailable)
    return rounded(masked.select(
        "dataset", "user_id", "retweet_ratio", "reply_ratio", "tweet_active_days", "tweets_per_day"))


@query("era_header_rules", """
select dataset, user_id, count(*) as tweet_count_actual, round(avg(retweet), 6) as retweet_ratio, round(avg(reply), 6) as reply_ratio from (
  select 'plain ' || dataset as dataset, user_id, case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end as retweet,
    cast(null as integer) as reply from fx_era_tweets
  union all select 'replies ' || dataset, user_id, case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end,
    case when trim(in_reply_to_user_id) not in ('', '0', 'nan', 'None') then 1 else 0 end from fx_era_tweets
  union all select 'flags ' || dataset, user_id, cast(tweet_id as bigint) % 2, case when cast(tweet_id as bigint) % 5 = 0 then 1 when cast(tweet_id as bigint) % 5 = 1 then 0 end
    from fx_era_tweets) group by dataset, user_id
""")
def era_header_rules(t):
    """One frame of three kinds of eras: without optional columns, with reply ids, with ready flags."""
    base = t.fx_era_tweets.select("dataset", "user_id", "text", "in_reply_to_user_id", F.col("tweet_id").cast("bigint").alias("n"))

    def named(kind):
        return F.concat(F.lit(kind + " "), "dataset").alias("dataset")

    plain = base.select(named("plain"), "user_id", "text")
    replies = base.select(named("replies"), "user_id", "text", "in_reply_to_user_id")
    flags = base.select(named("flags"), "user_id", "text", (F.col("n") % 2).cast("int").alias("is_retweet"),
                        F.when(F.col("n") % 5 == 0, 1).when(F.col("n") % 5 == 1, 0).alias("is_reply"))
    union = plain.unionByName(replies, allowMissingColumns=True).unionByName(flags, allowMissingColumns=True)
    return rounded(accounts.tweet_user_aggregates(union).select("dataset", "user_id", "tweet_count_actual", "retweet_ratio", "reply_ratio"))


@query("tweets_per_day", "select dataset, user_id, round(tweets_per_day, 6) as tweets_per_day from ox_round1")
def tweets_per_day(t):
    return rounded(merged_of(t).select("dataset", "user_id", "tweets_per_day"))


@query("text_pattern_counts", """
select doc_id, len(regexp_extract_all(text, '#[A-Za-z0-9_]+')) as hashtags,
  len(regexp_extract_all(text, '@[A-Za-z0-9_]+')) as mentions, len(regexp_extract_all(text, 'http[^ ]+')) as urls,
  length(text) as n_characters from documents
""")
def text_pattern_counts(t):
    body = F.col("text")
    return t.documents.select(
        "doc_id", tx.hashtags(body).cast("bigint").alias("hashtags"), tx.mentions(body).cast("bigint").alias("mentions"),
        tx.urls(body).cast("bigint").alias("urls"), F.length(tx.text_or_empty(body)).cast("bigint").alias("n_characters"))


@query("sample_with_replies", """
select dataset, user_id, round(reply_ratio, 6) as reply_ratio, tweet_count_actual from ox_round1
where reply_ratio > 0 order by dataset, user_id limit 10
""")
def sample_with_replies(t):
    return rounded(accounts.sample_with_replies(merged_of(t)).select(
        "dataset", "user_id", "reply_ratio", "tweet_count_actual"))


@query("round1_rates", """
select dataset, round(avg(has_tweet_data), 3) as has_tweet_data_rate,
  round(avg(case when retweet_ratio is null then 1 else 0 end), 3) as retweet_null_rate,
  round(avg(case when reply_ratio is null then 1 else 0 end), 3) as reply_null_rate from ox_round1 group by dataset
""")
def round1_rates(t):
    return profile.round1_rates(merged_of(t))


@query("flag_rates", """
select round(avg(case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end), 3) as is_retweet_rate,
  round(avg(case when trim(in_reply_to_user_id) not in ('', '0', 'nan', 'None') then 1 else 0 end), 3) as is_reply_rate
from fx_tweets where user_id in (select user_id from fx_users)
""")
def flag_rates(t):
    return profile.flag_rates(cleaning.normalise_tweets(t.fx_tweets.withColumnRenamed("tweet_id", "id"), t.fx_users))


@query("tweet_sample", f"""
select tweet_id, user_id, text from fx_tweets order by md5(concat('42|', tweet_id)), tweet_id limit {fv.TWEET_SAMPLE_SIZE}
""")
def tweet_sample(t):
    return order_stats.hash_sample(t.fx_tweets.select("tweet_id", "user_id", "text"), fv.TWEET_SAMPLE_SIZE, ["tweet_id"])


@query("preview_rows", """
select dataset, user_id, label from fx_users order by md5(concat('42|', dataset, '|', user_id)) limit 10
""")
def preview_rows(t):
    return order_stats.hash_sample(t.fx_users.select("dataset", "user_id", "label"), fv.PREVIEW_SIZE, ["dataset", "user_id"])


@query("stratum_sample", " union all ".join(f"""
select * from (select c_mktsegment as dataset, 'users' as file_type, cast(c_custkey as varchar) as user_id, cast(null as varchar) as tweet_id
  from customer where c_mktsegment = '{era}' order by md5(concat('42|', c_custkey)), 3 limit 25)
union all select * from (select dataset, 'tweets', user_id, tweet_id from fx_era_tweets
  where dataset = '{era}' order by md5(concat('42|', tweet_id)), tweet_id limit 25)
""" for era in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]))
def stratum_sample(t):
    """Segments as eras, users and tweets as file types."""
    users = t.fx_users.select("dataset", "user_id").withColumn("file_type", F.lit("users"))
    tweets = t.fx_era_tweets.select("dataset", "user_id", "tweet_id").withColumn("file_type", F.lit("tweets"))
    both = users.unionByName(tweets, allowMissingColumns=True).withColumn("key", F.coalesce("tweet_id", "user_id"))
    return profile.stratum_sample_by(both, ["dataset", "file_type"], "key", fv.STRATUM_SAMPLE_SIZE).drop("key")
