"""Stand-in inputs on top of the driver's tables.

`Tables` builds them with DataFrame operations; SQL_VIEWS states the same
rows as portable SQL for the check side.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from erashift.operators.order_stats import exact_quantiles
from erashift.operators.skew import eras_of

REFERENCE_DATE = "2002-01-01"

SQL_VIEWS: dict[str, str] = {}

SQL_VIEWS["fx_users"] = """
select c_mktsegment as dataset, cast(c_custkey as varchar) as user_id, c_name as screen_name,
  case when c_custkey % 11 = 0 then null when c_nationkey % 3 = 0 then 'Bot ' else 'human' end as label,
  cast(case when c_custkey % 7 = 0 then null else floor(c_acctbal) end as double) as followers_count,
  cast(case when c_custkey % 5 = 0 then null else c_nationkey * 10 end as double) as friends_count,
  cast(c_custkey % 400 as double) as statuses_count, cast(c_nationkey as double) as listed_count,
  case when c_custkey % 9 = 4 then null else f.first_order + interval '12' hour end as created_at,
  case when c_custkey % 4 = 0 then '   ' when c_custkey % 4 = 1 then null else c_name end as description,
  case c_custkey % 3 when 0 then 'True' when 1 then '0' else '1.0' end as verified
from customer left join (
  select o_custkey, min(o_orderdate) as first_order from orders group by o_custkey
) f on f.o_custkey = c_custkey
"""

SQL_VIEWS["fx_tweets"] = """
select cast(event_id as varchar) as tweet_id, cast(user_id as varchar) as user_id,
  case event_type
    when 'click' then concat('RT @u', cast(user_id as varchar), ': ', props)
    when 'view' then concat('#view #k', cast(event_id as varchar), ' http://t.co/', cast(event_id as varchar))
    when 'signup' then concat('@u', cast(user_id as varchar), ' éà')
    when 'error' then null else 'plain' end as text,
  case when event_id % 13 = 0 then null else ts end as created_at,
  case when event_type = 'signup' then cast(user_id + 1 as varchar)
       when event_type = 'purchase' then '0' else null end as in_reply_to_user_id
from events
"""

SQL_VIEWS["fx_era_tweets"] = """
select c_mktsegment as dataset, t.* from fx_tweets t join customer on cast(c_custkey as varchar) = t.user_id
"""

SQL_VIEWS["fx_edges"] = """
select distinct c_mktsegment as dataset, cast(a.user_id as varchar) as source_id, cast(b.user_id as varchar) as target_id
from events a join events b on b.event_id = a.event_id + 1 join customer on c_custkey = a.user_id
where a.user_id <> b.user_id
"""

SQL_VIEWS["fx_edges_sparse"] = """
select distinct l_linestatus as dataset, concat('c', cast(o_custkey as varchar)) as source_id,
  concat('s', cast(l_suppkey as varchar)) as target_id
from lineitem join orders on o_orderkey = l_orderkey
"""

SQL_VIEWS["fx_docs"] = """
select d.lang as dataset, cast(d.doc_id as varchar) as user_id,
  case l.quality when 1 then 'human' when 0 then 'bot' end as label,
  cast(d.n_chars as double) as n_chars, cast(length(d.text) as double) as text_len, d.source as source
from documents d left join labels l on l.doc_id = d.doc_id
"""

SQL_VIEWS["fx_pair_scores"] = """
select m.train, t.dataset as test, t.user_id, case t.label when 'bot' then 1 else 0 end as y,
  cast(abs(t.n_chars - m.med) as double) as score
from fx_docs t cross join (
  select dataset as train, median(n_chars) as med from fx_docs where label = 'human' group by dataset
) m where t.label is not null
"""

SQL_VIEWS["fx_importances"] = """
select p_brand as pair, p_type as feature, round(avg(p_retailprice) - 1400, 4) as value
from part group by p_brand, p_type
"""


class Tables:
    """The driver's tables, and the stand-ins, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def fx_users(self) -> DataFrame:
        key = F.col("c_custkey")
        first = self.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"))
        return self.customer.join(first, F.col("o_custkey") == key, "left").select(
            F.col("c_mktsegment").alias("dataset"), text(key).alias("user_id"), F.col("c_name").alias("screen_name"),
            F.when(key % 11 != 0, F.when(F.col("c_nationkey") % 3 == 0, "Bot ").otherwise("human")).alias("label"),
            F.when(key % 7 != 0, F.floor("c_acctbal")).cast("double").alias("followers_count"),
            F.when(key % 5 != 0, F.col("c_nationkey") * 10).cast("double").alias("friends_count"),
            (key % 400).cast("double").alias("statuses_count"),
            F.col("c_nationkey").cast("double").alias("listed_count"),
            F.when(key % 9 != 4, F.col("first_order") + F.expr("interval 12 hours")).alias("created_at"),
            F.when(key % 4 == 0, "   ").when(key % 4 != 1, F.col("c_name")).alias("description"),
            F.when(key % 3 == 0, "True").when(key % 3 == 1, "0").otherwise("1.0").alias("verified"),
        )

    @cached_property
    def fx_tweets(self) -> DataFrame:
        kind, event, user = F.col("event_type"), text(F.col("event_id")), text(F.col("user_id"))
        body = (
            F.when(kind == "click", F.concat(F.lit("RT @u"), user, F.lit(": "), "props"))
            .when(kind == "view", F.concat(F.lit("#view #k"), event, F.lit(" http://t.co/"), event))
            .when(kind == "signup", F.concat(F.lit("@u"), user, F.lit(" éà")))
            .when(kind != "error", "plain")
        )
        reply = F.when(kind == "signup", text(F.col("user_id") + 1)).when(kind == "purchase", "0")
        return self.events.select(
            event.alias("tweet_id"), user.alias("user_id"), body.alias("text"),
            F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("created_at"),
            reply.alias("in_reply_to_user_id"),
        )

    @cached_property
    def fx_era_tweets(self) -> DataFrame:
        eras = self.customer.select(F.col("c_mktsegment").alias("dataset"), text(F.col("c_custkey")).alias("user_id"))
        return self.fx_tweets.join(eras, "user_id")

    @cached_property
    def fx_edges(self) -> DataFrame:
        """Who acts right after whom; a join on the next event id, not a global window."""
        now = self.events.select("event_id", F.col("user_id").alias("s"))
        then = self.events.select((F.col("event_id") - 1).alias("event_id"), F.col("user_id").alias("t"))
        eras = self.customer.select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("s"))
        return (
            now.join(then, "event_id").filter("s <> t").join(eras, "s")
            .select("dataset", text(F.col("s")).alias("source_id"), text(F.col("t")).alias("target_id")).distinct()
        )

    @cached_property
    def fx_edges_sparse(self) -> DataFrame:
        items = self.lineitem.select("l_orderkey", "l_suppkey", "l_linestatus")
        return items.join(self.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
            F.col("l_linestatus").alias("dataset"), F.concat(F.lit("c"), text(F.col("o_custkey"))).alias("source_id"),
            F.concat(F.lit("s"), text(F.col("l_suppkey"))).alias("target_id"),
        ).distinct()

    @cached_property
    def fx_docs(self) -> DataFrame:
        quality = F.when(F.col("quality") == 1, "human").when(F.col("quality") == 0, "bot")
        return self.documents.join(self.labels, "doc_id", "left").select(
            F.col("lang").alias("dataset"), text(F.col("doc_id")).alias("user_id"), quality.alias("label"),
            F.col("n_chars").cast("double").alias("n_chars"), F.length("text").cast("double").alias("text_len"), "source",
        )

    @cached_property
    def fx_pair_scores(self) -> DataFrame:
        """Score of a labelled document for a training era: distance from the
        median length of that era's human rows."""
        rows = self.fx_docs.filter("label is not null")
        medians = exact_quantiles(rows.filter("label = 'human'"), ["dataset"], ["n_chars"], [0.5]).select(
            F.col("dataset").alias("train"), F.col("value").alias("med"))
        eras = eras_of(self.documents.select(F.col("lang").alias("dataset")))
        paired = rows.withColumn("train", F.explode(F.array(*[F.lit(e) for e in eras])))
        return paired.join(F.broadcast(medians), "train").select(  # one median per era
            "train", F.col("dataset").alias("test"), "user_id", (F.col("label") == "bot").cast("int").alias("y"),
            F.abs(F.col("n_chars") - F.col("med")).alias("score"),
        )

    @cached_property
    def fx_importances(self) -> DataFrame:
        return self.part.groupBy(F.col("p_brand").alias("pair"), F.col("p_type").alias("feature")).agg(
            F.round(F.avg("p_retailprice") - 1400, 4).alias("value"))


def text(c: Column) -> Column:
    return c.cast("string")
