"""Ingest, normalisation, membership joins and edges."""

from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift import session
from erashift.catalog.fixtures import Tables, text
from erashift.catalog.registry import query
from erashift.functions import ids, text as tx, values
from erashift.operators import cleaning, edges, profile
from erashift.plans import releases
from erashift.sources import records


# --- nested release ---------------------------------------------------------

def _records(t: Tables):
    """One nested record per event; the profile is parsed from the JSON column."""
    key = F.col("event_id")
    profile_ = F.struct(
        F.col("event_type").alias("screen_name"),
        F.from_json("props", "k int")["k"].cast("string").alias("followers_count"),
    )
    near = F.struct(
        F.array(text(key % 97), text(F.col("user_id"))).alias("follower"),
        F.array(text(key % 89), F.lit(None).cast("string")).alias("following"),
    )
    return t.events.select(
        text(F.col("user_id")).alias("ID"), text(key % 2).alias("label"), profile_.alias("profile"),
        F.when(F.col("event_type") != "error", near).alias("neighbor"),
        F.col("event_type").alias("subset"), F.lit("nested").alias("dataset"),
    )


@query("ingest_nested_users", """
select cast(user_id as varchar) as user_id, event_type as screen_name,
  case when event_id % 2 = 1 then 'bot' else 'human' end as label, event_type as subset,
  cast(cast(props->>'k' as integer) as varchar) as followers_count
from events
""")
def ingest_nested_users(t):
    return cleaning.nested_users(_records(t))


@query("ingest_nested_tweets", """
select cast(null as varchar) as tweet_id, cast(doc_id as varchar) as user_id, line as text,
  cast(null as varchar) as created_at, cast(null as varchar) as in_reply_to_user_id,
  case when starts_with(line, 'RT @') then 1 else 0 end as is_retweet, cast(null as integer) as is_reply
from (select doc_id, unnest(string_split(text, chr(10))) as line from documents where n_chars % 7 <> 0)
""")
def ingest_nested_tweets(t):
    lines = F.when(F.col("n_chars") % 7 != 0, F.split("text", "\n"))
    return cleaning.nested_tweets(t.documents.select(text(F.col("doc_id")).alias("ID"), lines.alias("tweet")))


@query("edges_from_neighbors", """
select 'nested' as dataset, source_id, target_id, min(relation) as relation from (
  select cast(event_id % 97 as varchar) as source_id, cast(user_id as varchar) as target_id, 'follower' as relation
  from events where event_type <> 'error'
  union all
  select cast(user_id as varchar), cast(event_id % 89 as varchar), 'following' from events where event_type <> 'error'
) where source_id <> target_id group by source_id, target_id
""")
def edges_from_neighbors(t):
    return edges.edges_from_neighbors(_records(t))


# --- second API generation --------------------------------------------------

def _v2_users(t: Tables):
    key = F.col("c_custkey")
    metrics = F.struct(
        F.floor("c_acctbal").alias("followers_count"), (F.col("c_nationkey") * 10).alias("following_count"),
        (key % 400).alias("tweet_count"), F.col("c_nationkey").alias("listed_count"),
    )
    url = F.when(key % 6 == 0, "http://x/default_profile.png").when(key % 6 != 1, "http://x/me.png")
    return t.customer.select(
        ids.prefixed_id(key).alias("id"), F.col("c_name").alias("username"),
        F.when(key % 10 != 0, metrics).alias("public_metrics"), F.lit(None).cast("string").alias("created_at"),
        text(key % 2 == 0).alias("verified"), F.col("c_mktsegment").alias("description"),
        F.lit(None).cast("string").alias("location"), url.alias("profile_image_url"),
    )


def _v2_labels(t: Tables):
    key = F.col("c_custkey")
    return t.customer.filter(key % 11 != 0).select(
        ids.prefixed_id(key).alias("user_id"), F.when(key % 3 == 0, "bot").otherwise("human").alias("label"))


def _v2_splits(t: Tables):
    key = F.col("c_custkey")
    return t.customer.filter(key % 4 != 0).select(
        ids.prefixed_id(key).alias("user_id"), F.when(key % 5 == 0, "test").otherwise("train").alias("subset"))


@query("ingest_v2_users", """
select concat('u', c_custkey) as user_id, c_name as screen_name,
  case when c_custkey % 3 = 0 then 'bot' else 'human' end as label,
  case when c_custkey % 4 = 0 then null when c_custkey % 5 = 0 then 'test' else 'train' end as subset,
  case when c_custkey % 10 <> 0 then cast(floor(c_acctbal) as bigint) end as followers_count,
  case when c_custkey % 10 <> 0 then c_nationkey * 10 end as friends_count,
  case when c_custkey % 10 <> 0 then c_custkey % 400 end as statuses_count,
  case when c_custkey % 10 <> 0 then c_nationkey end as listed_count, cast(null as varchar) as created_at,
  case when c_custkey % 2 = 0 then 'true' else 'false' end as verified, c_mktsegment as description,
  cast(null as varchar) as location, case when c_custkey % 6 = 0 then 1 else 0 end as default_profile_image
from customer where c_custkey % 11 <> 0
""")
def ingest_v2_users(t):
    return cleaning.v2_users(_v2_users(t), _v2_labels(t), _v2_splits(t))


def v2_refs():
    """Referenced tweets by event type: none, empty, one kind, both kinds."""
    def ref(kind):
        return F.struct(F.lit(kind).alias("type"), text(F.col("event_id")).alias("id"))

    kind = F.col("event_type")
    return (
        F.when(kind == "click", F.array(ref("retweeted")))
        .when(kind == "signup", F.array(ref("quoted"), ref("replied_to")))
        .when(kind == "purchase", F.array(ref("retweeted"), ref("replied_to")))
        .when(kind == "view", F.array(ref("quoted")))
    )


def v2_raw_tweets(events):
    reply = F.when(F.col("event_type") == "view", text(F.col("user_id") + 1)).when(F.col("event_type") == "click", "")
    return events.select(
        text(F.col("event_id")).alias("id"), text(F.col("user_id")).alias("author_id"), F.col("props").alias("text"),
        text(F.col("ts")).alias("created_at"), reply.alias("in_reply_to_user_id"), v2_refs().alias("referenced_tweets"),
    )


V2_TWEETS_SQL = """
select cast(event_id as varchar) as tweet_id, concat('u', user_id) as user_id, props as text,
  cast(ts as varchar) as created_at,
  case when event_type = 'view' then concat('u', user_id + 1) else '' end as in_reply_to_user_id,
  case when event_type in ('click', 'purchase') then 1 else 0 end as is_retweet,
  case when event_type in ('signup', 'purchase', 'view') then 1 else 0 end as is_reply
from events join customer on c_custkey = user_id where c_custkey % 11 <> 0
"""


@query("ingest_v2_tweets", V2_TWEETS_SQL)
def ingest_v2_tweets(t):
    return cleaning.v2_tweets(v2_raw_tweets(t.events), _v2_labels(t))


@query("v2_flags", """
select event_id, case when event_type in ('click', 'purchase') then 1 else 0 end as is_retweet,
  case when event_type in ('signup', 'purchase') then 1 else 0 end as is_reply from events
""")
def v2_flags(t):
    none = F.lit(None).cast("string")
    return t.events.select("event_id", tx.v2_retweet_flag(v2_refs()).alias("is_retweet"),
                           tx.v2_reply_flag(v2_refs(), none).alias("is_reply"))


# --- normalisation ----------------------------------------------------------

@query("output_row_counts", """
select 'users' as table_name, count(*) as n_rows from customer
union all select 'tweets', count(*) from events union all select 'documents', count(*) from documents
""")
def output_row_counts(t):
    return cleaning.output_row_counts({"users": t.customer, "tweets": t.events, "documents": t.documents})


@query("keep_columns", " union all ".join(
    f"select '{c}' as \"column\", cast(count(*) filter ({c} is null) as bigint) as nulls from fx_users"
    for c in ["user_id", "screen_name", "label", "followers_count", "friends_count", "statuses_count",
              "listed_count", "created_at", "verified", "description"]))
def keep_columns(t):
    return cleaning.null_counts(cleaning.keep_columns(t.fx_users, fv.USER_KEEP_COLS))


@query("canonical_ids", """
select c_custkey, case c_custkey % 9 when 0 then cast(c_custkey as varchar) when 1 then concat('-', c_custkey)
  when 2 then concat(c_custkey, '.5') when 8 then concat(c_custkey, '.0x') end as id from customer
""")
def canonical_ids(t):
    key = F.col("c_custkey")
    forms = [F.concat(text(key), F.lit(".0")), F.concat(F.lit("-"), text(key), F.lit(".00")),
             F.concat(text(key), F.lit(".5")), F.lit(""), F.lit("nan"), F.lit("None"), F.lit("NaN"),
             F.lit(None).cast("string"), F.concat(text(key), F.lit(".0x"))]
    messy = F.get(F.array(*forms), (key % 9).cast("int"))
    return t.customer.select("c_custkey", ids.canonical_id(messy).alias("id"))


@query("float_ids_to_string", """
select concat(c_custkey, '00000000') as user_id,
  case when c_custkey % 4 <> 0 then cast(o_orderkey as varchar) end as in_reply_to_user_id
from orders join customer on o_custkey = c_custkey where c_custkey % 9 <> 0
""")
def float_ids_to_string(t):
    key = F.col("o_custkey")
    return cleaning.drop_float_ids(t.orders.select(
        F.when(key % 9 != 0, key * F.lit(1e8)).alias("user_id"),
        F.when(key % 4 != 0, F.col("o_orderkey").cast("double")).alias("in_reply_to_user_id")))


# --- CSV releases -------------------------------------------------------------

_SUBSETS = [*fv.SUBSET_LABELS["cresci_2017"], "unlisted.csv"]
_SUBSET_SQL = f"([{', '.join(repr(s) for s in _SUBSETS)}])[1 + c_nationkey % {len(_SUBSETS)}]"


def _release_users(t: Tables):
    key = F.col("c_custkey")
    day = F.concat(text(key * 86_400_000), F.lit("L"))
    return releases.release_users(t.customer.select(
        key.cast("double").alias("id"), F.col("c_name").alias("screen_name"), F.col("c_acctbal").alias("unused"),
        F.when(key % 2 == 0, day).when(key % 3 == 0, "2009-05-01 00:00:00+00:00").alias("created_at"),
        F.get(F.array(*[F.lit(s) for s in _SUBSETS]), F.col("c_nationkey") % len(_SUBSETS)).alias("subset")), "cresci_2017")


@query("release_users", f"""
select cast(c_custkey as varchar) as user_id, c_name as screen_name,
  case {_SUBSET_SQL} when 'genuine_accounts.csv' then 'human' when 'unlisted.csv' then null else 'bot' end as label, {_SUBSET_SQL} as subset,
  case when c_custkey % 2 = 0 then concat(strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d %H:%M:%S'), '+00:00')
       when c_custkey % 3 = 0 then '2009-05-01 00:00:00+00:00' end as created_at, 'cresci_2017' as source
from customer
""")
def release_users(t):
    """Customers as the accounts of a CSV release with one subset that has no label."""
    return _release_users(t)


@query("release_tweets", """
select tweet_id, user_id, text, created_at, case when in_reply_to_user_id <> '' then in_reply_to_user_id end as in_reply_to_user_id,
  case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end as is_retweet,
  case when trim(in_reply_to_user_id) not in ('', '0', 'nan', 'None') then 1 else 0 end as is_reply
from (select * replace (cast(created_at as varchar) as created_at) from fx_tweets) where user_id in (select cast(c_custkey as varchar) from customer)
  and cast(user_id as bigint) % 9 <> 0
""")
def release_tweets(t):
    """Tweets whose ids went through float columns; every ninth account's are lost."""
    raw = t.fx_tweets.select(
        F.col("tweet_id").alias("id"), F.when(F.col("user_id").cast("bigint") % 9 != 0, F.col("user_id").cast("double")).alias("user_id"),
        "text", text(F.col("created_at")).alias("created_at"), F.col("in_reply_to_user_id").cast("double").alias("in_reply_to_user_id"))
    return releases.release_tweets(raw, _release_users(t))


def _as_csv(df, path, encoding="UTF-8"):
    """Raw files of a release: every value quoted, text kept as it is."""
    df.write.options(header=True, quoteAll=True, escape='"', encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


@query("csv_sql_scan", """
select lang, count(*) as n, count(nullif(text, '')) as texts, sum(len(text)) as chars, count(distinct md5(nullif(text, ''))) as different,
  sum(len(text) - len(replace(text, chr(10), ''))) as line_breaks, min(md5(nullif(text, ''))) as first_digest
from documents group by lang
""")
def csv_sql_scan(t):
    """Documents, with their line breaks inside quotes, through CSV files that SQL reads as a table."""
    path = session.fresh_dir(t.spark, "csv-documents")
    _as_csv(t.documents.select("doc_id", "lang", "text"), path)
    records.csv_table(t.spark, "csv_documents", path)
    return t.spark.sql("""
        select lang, count(*) as n, count(text) as texts, sum(length(text)) as chars, count(distinct md5(text)) as different,
          sum(length(text) - length(replace(text, chr(10), ''))) as line_breaks, min(md5(text)) as first_digest
        from csv_documents group by lang""")


_OLD_SUBSETS = list(fv.SUBSET_LABELS["cresci_2015"])
_OLD_SUBSET_SQL = f"([{', '.join(repr(s) for s in _OLD_SUBSETS)}])[1 + c_nationkey % {len(_OLD_SUBSETS)}]"


@query("csv_release_features", f"""
with u as (select cast(c_custkey as varchar) as user_id, c_name as screen_name, {_OLD_SUBSET_SQL} as subset from customer),
t as (select user_id, count(*) as n, avg(len(coalesce(text, ''))) as len, avg(case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end) as rt,
  avg(len(regexp_extract_all(coalesce(text, ''), '#[A-Za-z0-9_]+'))) as tags from fx_tweets where user_id in (select user_id from u) group by user_id)
select u.user_id, subset, case when subset in ('TFP', 'TWT') then 'human' else 'bot' end as label, coalesce(n, 0) as tweet_count_actual,
  case when n is null then 0 else 1 end as has_tweet_data, round(len, 6) as avg_text_length, round(rt, 6) as retweet_ratio, round(tags, 6) as avg_hashtags
from u left join t using (user_id)
""")
def csv_release_features(t):
    """From the raw folders of a release, users and Latin-1 tweets per subset, to its Round 1 features, in one call."""
    folder = session.fresh_dir(t.spark, "csv-release")
    subset = F.get(F.array(*[F.lit(s) for s in _OLD_SUBSETS]), F.col("c_nationkey") % len(_OLD_SUBSETS))
    users = t.customer.select(text(F.col("c_custkey")).alias("id"), F.col("c_name").alias("screen_name"), subset.alias("subset"))
    tweets = t.fx_tweets.join(users.select(F.col("id").alias("user_id"), "subset"), "user_id").withColumnRenamed("tweet_id", "id")
    for s in _OLD_SUBSETS:
        _as_csv(users.filter(F.col("subset") == s).drop("subset"), f"{folder}/{s}.csv/users.csv")
        _as_csv(tweets.filter(F.col("subset") == s).select("id", "user_id", "text", "in_reply_to_user_id"), f"{folder}/{s}.csv/tweets.csv", "ISO-8859-1")
    frame = releases.csv_release_features(t.spark, folder, "cresci_2015", "2020-09-01")
    rounded = [F.round(c, 6).alias(c) for c in ("avg_text_length", "retweet_ratio", "avg_hashtags")]
    return frame.select("user_id", "subset", "label", "tweet_count_actual", "has_tweet_data", *rounded)


@query("long_suffix_timestamps", """
select event_id, case when event_id % 2 = 0
  then concat(strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S'),
    case when (epoch_us(ts) // 1000) % 1000 = 0 then '' else concat('.', lpad(cast((epoch_us(ts) // 1000) % 1000 as varchar), 3, '0'), '000') end, '+00:00')
  when event_id % 3 = 0 then '12L4' end as created_at from events
""")
def long_suffix_timestamps(t):
    millis = F.concat(text(F.unix_millis(F.col("ts").cast("timestamp"))), F.lit("L"))
    raw = F.when(F.col("event_id") % 2 == 0, millis).when(F.col("event_id") % 3 == 0, "12L4")
    return t.events.select("event_id", values.long_suffix_time(raw).alias("created_at"))


@query("parse_created_at", """
select event_id, case when event_id % 4 = 0 then epoch_us(ts) when event_id % 4 = 1 then epoch_us(date_trunc('second', ts)) end as micros,
  case when event_id % 4 = 0 then epoch_us(ts) end as strict_micros from events
""")
def parse_created_at(t):
    key, at = F.col("event_id") % 4, F.col("ts").cast("timestamp")
    old = F.concat(F.date_format(at, "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format(at, "yyyy"))
    raw = F.when(key == 0, text(at)).when(key == 1, old).when(key == 2, "not a date")
    return t.events.select("event_id", raw.alias("raw")).select(
        "event_id", F.unix_micros(values.parse_time(F.col("raw"))).alias("micros"),
        F.unix_micros(values.parse_time(F.col("raw"), strict=True)).alias("strict_micros"))


@query("numeric_coerce", """
select c_custkey, case c_custkey % 6 when 0 then c_acctbal when 1 then 1500.0::double end as value from customer
""")
def numeric_coerce(t):
    key = F.col("c_custkey") % 6
    raw = (F.when(key == 0, text(F.col("c_acctbal"))).when(key == 1, "1.5e3").when(key == 2, "abc")
           .when(key == 3, "").when(key == 4, "NaN"))
    return t.customer.select("c_custkey", values.numeric(raw).alias("value"))


@query("label_binary", """
select c_custkey, case c_custkey % 6 when 0 then 1 when 1 then 0 when 2 then 1 end as y from customer
""")
def label_binary(t):
    key = F.col("c_custkey") % 6
    raw = (F.when(key == 0, "Bot ").when(key == 1, "\thuman").when(key == 2, "BOT").when(key == 3, "spam")
           .when(key == 4, ""))
    return t.customer.select("c_custkey", values.label_code(raw).alias("y"))


@query("retweet_flag_text", """
select tweet_id, case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end as is_retweet from fx_tweets
""")
def retweet_flag_text(t):
    return t.fx_tweets.select("tweet_id", tx.retweet_flag(F.col("text")).alias("is_retweet"))


@query("reply_flag_id", """
select tweet_id, case when trim(in_reply_to_user_id) not in ('', '0', 'nan', 'None') then 1 else 0 end as is_reply from fx_tweets
""")
def reply_flag_id(t):
    return t.fx_tweets.select("tweet_id", tx.reply_flag(F.col("in_reply_to_user_id")).alias("is_reply"))


@query("tweets_normalise", """
select t.*, case when starts_with(coalesce(text, ''), 'RT @') then 1 else 0 end as is_retweet,
  case when trim(in_reply_to_user_id) not in ('', '0', 'nan', 'None') then 1 else 0 end as is_reply
from fx_tweets t where user_id in (select user_id from fx_users where label is not null)
""")
def tweets_normalise(t):
    raw = t.fx_tweets.withColumnRenamed("tweet_id", "id")
    return cleaning.normalise_tweets(raw, t.fx_users.filter("label is not null"))


@query("semi_labelled", """
select tweet_id, user_id from fx_tweets where user_id in (select user_id from fx_users where label = 'Bot ')
""")
def semi_labelled(t):
    bots = t.fx_users.filter("label = 'Bot '")
    return cleaning.keep_known(t.fx_tweets.select("tweet_id", "user_id"), bots)


@query("user_label_split", """
select u.user_id, u.screen_name, l.label, s.subset from fx_users u
left join (select cast(c_custkey as varchar) as user_id, case when c_custkey % 3 = 0 then 'bot' else 'human' end as label
           from customer where c_custkey % 11 <> 0) l on l.user_id = u.user_id
left join (select cast(c_custkey as varchar) as user_id, case when c_custkey % 5 = 0 then 'test' else 'train' end as subset
           from customer where c_custkey % 4 <> 0) s on s.user_id = u.user_id
""")
def user_label_split(t):
    def plain(df):
        return df.withColumn("user_id", F.substring("user_id", 2, 30))

    users = t.fx_users.select("user_id", "screen_name")
    return cleaning.join_labels(users, plain(_v2_labels(t)), plain(_v2_splits(t)))


@query("tweets_union", """
select tweet_id, user_id, text, created_at, in_reply_to_user_id, 'a' as dataset from fx_tweets where cast(user_id as bigint) % 2 = 0
union all select tweet_id, user_id, text, created_at, in_reply_to_user_id, 'b' from fx_tweets
""")
def tweets_union(t):
    even = t.fx_tweets.filter("cast(user_id as bigint) % 2 = 0")
    return profile.tweets_union({"a": even, "b": t.fx_tweets})


# --- edges ------------------------------------------------------------------

@query("edges_clean", """
select 'era' as dataset, source_id, target_id, case when min(p) = 1 then 'friend' else 'reply' end as relation from (
  select cast(a.user_id as varchar) as source_id,
    case when a.event_id % 17 = 0 then cast(a.user_id as varchar) when a.event_id % 19 = 0 then 'NaN'
         else cast(b.user_id as varchar) end as target_id,
    case when a.event_type = 'click' then 1 else 2 end as p
  from events a join events b on b.event_id = a.event_id + 1
  where a.event_id % 23 <> 0 and a.event_id % 29 <> 0
) where source_id <> target_id group by source_id, target_id
""")
def edges_clean(t):
    key = F.col("event_id")
    now = t.events.select(key, F.col("user_id").alias("s"), "event_type")
    then = t.events.select((key - 1).alias("event_id"), F.col("user_id").alias("t"))
    source = F.when(key % 23 == 0, "nan").when(key % 29 != 0, F.concat(text(F.col("s")), F.lit(".0")))
    target = F.when(key % 17 == 0, text(F.col("s"))).when(key % 19 == 0, "NaN").otherwise(text(F.col("t")))
    relation = F.when(F.col("event_type") == "click", "friend").otherwise("reply")
    raw = now.join(then, "event_id").select(
        source.alias("source_id"), target.alias("target_id"), relation.alias("relation"))
    return edges.edges_clean(raw, "era")


@query("edges_filtered_scan", """
select 'era' as dataset, source_id, target_id, case when min(p) = 1 then 'following' else 'followers' end as relation from (
  select concat('c', o_custkey) as source_id, concat('s', l_suppkey) as target_id, case l_returnflag when 'A' then 1 else 2 end as p
  from lineitem join orders on o_orderkey = l_orderkey
  where l_returnflag in ('A', 'N') and (o_custkey % 5 = 0 or l_suppkey % 7 = 0)
) group by source_id, target_id
""")
def edges_filtered_scan(t):
    flag = F.col("l_returnflag")
    relation = F.when(flag == "A", "following").when(flag == "N", "followers").otherwise("likes")
    raw = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.concat(F.lit("c"), text(F.col("o_custkey"))).alias("source_id"),
        F.concat(F.lit("s"), text(F.col("l_suppkey"))).alias("target_id"), relation.alias("relation"))
    known = t.customer.filter("c_custkey % 5 = 0").select(
        F.concat(F.lit("c"), text(F.col("c_custkey"))).alias("user_id")
    ).unionByName(t.supplier.filter("s_suppkey % 7 = 0").select(
        F.concat(F.lit("s"), text(F.col("s_suppkey"))).alias("user_id")))
    return edges.edges_filtered_scan(raw, known, "era")


@query("edges_both_labelled", """
select * from fx_edges where source_id in (select user_id from fx_users where label is not null)
  and target_id in (select user_id from fx_users where label is not null)
""")
def edges_both_labelled(t):
    return edges.edges_both_labelled(t.fx_edges, t.fx_users.filter("label is not null"))


@query("edges_reply", """
select distinct dataset, user_id as source_id, in_reply_to_user_id as target_id, 'reply' as relation
from fx_era_tweets where in_reply_to_user_id <> '0' and user_id <> in_reply_to_user_id
""")
def edges_reply(t):
    return edges.edges_reply(t.fx_era_tweets)


_COMBINED = """
select dataset, source_id, target_id, case when max(p) = 1 then 'follows' else 'reply' end as relation from (
  select *, 1 as p from fx_edges union all
  select dataset, user_id, in_reply_to_user_id, 0 from fx_era_tweets
  where in_reply_to_user_id <> '0' and user_id <> in_reply_to_user_id
) group by dataset, source_id, target_id
"""


def _combined(t):
    return edges.edges_combine(
        edges.edges_clean(t.fx_edges, dedupe=False), edges.edges_reply(t.fx_era_tweets, dedupe=False))


@query("edges_combine", _COMBINED)
def edges_combine(t):
    return _combined(t)


@query("relation_counts", f"""
select item, n from (
  select concat('relation ', relation) as item, count(*) as n from ({_COMBINED}) group by relation union all
  select 'source_id', count(distinct source_id) from ({_COMBINED}) union all
  select 'target_id', count(distinct target_id) from ({_COMBINED}))
""")
def relation_counts(t):
    return edges.relation_counts(_combined(t))
