"""Profiling tables."""

from pyspark.sql import functions as F

from erashift.catalog.registry import query
from erashift.catalog.round1 import merged_of
from erashift.operators import profile
from erashift.operators.skew import eras_of


@query("dataset_sizes", """
select u.dataset, u.users, u.user_rows, t.tweets, t.tweeting_users,
  round(t.tweets / u.users, 2) as tweets_per_user, round(t.tweeting_users / u.users * 100, 2) as pct_users_with_tweets
from (select dataset, count(distinct user_id) as users, count(user_id) as user_rows from fx_users group by dataset) u
left join (select dataset, count(*) as tweets, count(distinct user_id) as tweeting_users from fx_era_tweets group by dataset) t
  on t.dataset = u.dataset
""")
def dataset_sizes(t):
    return profile.dataset_sizes(t.fx_users, t.fx_era_tweets)


@query("label_crosstab", """
select coalesce(dataset, 'All') as dataset, coalesce(label, 'All') as label, count(*) as n
from fx_users where label is not null group by cube (dataset, label)
""")
def label_crosstab(t):
    return profile.crosstab(t.fx_users, ["dataset", "label"])


@query("label_percentages", """
select dataset, label, round(count(*) * 100.0::double / sum(count(*)) over (partition by dataset), 2) as pct
from fx_users where label is not null group by dataset, label
""")
def label_percentages(t):
    return profile.label_percentages(t.fx_users)


_PRESENT = ["user_id", "screen_name", "label", "followers_count", "friends_count", "statuses_count", "listed_count",
            "created_at", "description", "verified"]
_ERAS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _held(col):
    """followers_count is wiped for BUILDING, description for two eras."""
    if col == "followers_count":
        return "case when dataset <> 'BUILDING' then followers_count end"
    if col == "description":
        return "case when dataset not in ('BUILDING', 'MACHINERY') then description end"
    return col


@query("column_presence", " union all ".join(
    "select '{c}' as \"column\", {eras}, {total} as num_datasets from fx_users".format(
        c=c, eras=", ".join(
            f"max(case when dataset = '{e}' and {_held(c)} is not null then 1 else 0 end) as {e}" for e in _ERAS),
        total=" + ".join(
            f"max(case when dataset = '{e}' and {_held(c)} is not null then 1 else 0 end)" for e in _ERAS))
    for c in _PRESENT))
def column_presence(t):
    users = t.fx_users.withColumns({c: F.expr(_held(c)) for c in ("followers_count", "description")})
    return profile.column_presence(users, eras_of(users))


@query("missingness", " union all ".join(f"""
select dataset, '{c}' as "column", cast(count(*) filter ({c} is null) as bigint) as missing_count,
  round(count(*) filter ({c} is null) * 100.0::double / count(*), 2) as missing_pct
from fx_users group by dataset having count(*) filter ({c} is null) > 0
""" for c in _PRESENT))
def missingness(t):
    return profile.missingness(t.fx_users)


_COVERED = """
select u.*, t.user_id is not null as has_tweets from fx_users u
left join (select distinct dataset, user_id from fx_era_tweets) t on t.dataset = u.dataset and t.user_id = u.user_id
"""


@query("tweet_coverage", f"""
select coalesce(dataset, 'All') as dataset, coalesce(label, 'All') as label, coalesce(has, 'All') as has_tweets_in_file, count(*) as n
from (select dataset, label, case when has_tweets then 'true' else 'false' end as has from ({_COVERED}) where label is not null)
group by cube (dataset, label, has)
""")
def tweet_coverage(t):
    covered = profile.tweet_coverage(t.fx_users, t.fx_era_tweets)
    return profile.crosstab(covered, ["dataset", "label", "has_tweets_in_file"])


@query("coverage_by_label", f"""
select dataset, label, round(avg(case when has_tweets then 1 else 0 end) * 100, 2) as pct_with_tweets
from ({_COVERED}) where label is not null group by dataset, label
""")
def coverage_by_label(t):
    return profile.coverage_by_label(profile.tweet_coverage(t.fx_users, t.fx_era_tweets))


@query("metadata_stats", " union all ".join(f"""
select dataset, label, '{c}' as col, round(avg({c}), 2) as mean, round(median({c}), 2) as median,
  round(stddev_samp({c}), 2) as std from fx_users where label is not null group by dataset, label
""" for c in ["followers_count", "friends_count", "statuses_count", "listed_count"]))
def metadata_stats(t):
    return profile.metadata_stats(t.fx_users)


@query("preview_features", """
select dataset, label, round(avg(followers_count / nullif(friends_count + 1, 0)), 3) as ff_ratio_preview,
  round(avg(case when trim(description) <> '' then 1 else 0 end), 3) as has_bio_preview
from fx_users where label is not null group by dataset, label
""")
def preview_features(t):
    return profile.preview_features(t.fx_users)


@query("tweet_preview", r"""
select t.dataset, u.label, round(avg(length(coalesce(text, ''))), 3) as avg_text_length_preview,
  round(avg(case when regexp_matches(coalesce(text, ''), 'http\S+') then 1 else 0 end), 3) as url_rate_preview,
  round(avg(case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end), 3) as retweet_rate_preview,
  round(avg(case when in_reply_to_user_id <> '' then 1 else 0 end), 3) as reply_rate_preview, count(*) as sampled_tweets
from fx_era_tweets t join fx_users u on u.dataset = t.dataset and u.user_id = t.user_id
where u.label is not null group by t.dataset, u.label
""")
def tweet_preview(t):
    return profile.tweet_preview(t.fx_era_tweets, t.fx_users)


@query("distinct_tweeters", "select distinct dataset, user_id from fx_era_tweets")
def distinct_tweeters(t):
    return profile.distinct_tweeters(t.fx_era_tweets)


@query("duplicate_keys", """
select cast(coalesce(sum(n - 1), 0) as bigint) as n_duplicates
from (select count(*) as n from fx_era_tweets group by dataset, user_id having count(*) > 1)
""")
def duplicate_keys(t):
    return profile.duplicate_keys(t.fx_era_tweets)


@query("describe_column", " union all ".join(f"""
select '{c}' as col, count({c}) as n, round(avg({c}), 3) as mean, round(stddev_samp({c}), 3) as std,
  round(min({c}), 3) as min, round(quantile_cont({c}, 0.25), 3) as q25, round(quantile_cont({c}, 0.5), 3) as q50,
  round(quantile_cont({c}, 0.75), 3) as q75, round(max({c}), 3) as max from ox_round1
""" for c in ["reply_ratio", "tweets_per_day", "followers_count"]))
def describe_column(t):
    return profile.describe_columns(merged_of(t), ["reply_ratio", "tweets_per_day", "followers_count"])
