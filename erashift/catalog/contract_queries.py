"""Contracts and validation, over a frame with every kind of unsafe column."""

from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.catalog import graphs, round1
from erashift.catalog.fixtures import SQL_VIEWS
from erashift.catalog.registry import query
from erashift.operators import contracts
from erashift.operators.graph import graph_merge
from erashift.operators.skew import eras_of
from erashift.plans.features import graph_features

# n_chars: fine; sparse_fr: no value in fr; flat_de: constant in de; flat_en_null_es: both
# kinds; followers_count: deny-listed; emb_0: deny prefix; nowhere: absent.
CANDIDATES = ["n_chars", "text_len", "sparse_fr", "flat_de", "flat_en_null_es", "rare_es", "followers_count",
              "emb_0", "nowhere"]
PRESENT = [c for c in CANDIDATES if c != "nowhere"]
ERAS = ["de", "en", "es", "fr"]

SQL_VIEWS["fx_contract"] = """
select dataset, user_id, n_chars, text_len, case when dataset <> 'fr' then n_chars end as sparse_fr,
  case when dataset = 'de' then 7.0::double else n_chars end as flat_de,
  case when dataset = 'en' then 1.0::double when dataset <> 'es' then text_len end as flat_en_null_es,
  case when dataset <> 'es' or cast(user_id as bigint) % 211 = 0 then text_len end as rare_es,
  n_chars as followers_count, text_len as emb_0 from fx_docs
"""


def contract_frame(t):
    era, n, length = F.col("dataset"), F.col("n_chars"), F.col("text_len")
    return t.fx_docs.select(
        era, "user_id", n, length, F.when(era != "fr", n).alias("sparse_fr"),
        F.when(era == "de", 7.0).otherwise(n).alias("flat_de"),
        F.when(era == "en", 1.0).when(era != "es", length).alias("flat_en_null_es"),
        F.when((era != "es") | (F.col("user_id").cast("bigint") % 211 == 0), length).alias("rare_es"),
        n.alias("followers_count"), length.alias("emb_0"),
    )


SQL_VIEWS["ox_stats"] = " union all ".join(
    f"select dataset, '{c}' as col, count(*) as n, count({c}) as present, count(distinct {c}) as n_distinct "
    f"from fx_contract group by dataset" for c in PRESENT)


def stats_of(t):
    return contracts.column_stats(contract_frame(t), PRESENT)


@query("feature_null_rates", "select dataset, col, round(1 - present / n, 4) as null_rate from ox_stats")
def feature_null_rates(t):
    return contracts.feature_null_rates(stats_of(t))


@query("feature_distinct_counts", "select dataset, col, n_distinct from ox_stats")
def feature_distinct_counts(t):
    return contracts.feature_distinct_counts(contract_frame(t), PRESENT)


@query("feature_availability", "select col, " + ", ".join(
    f"max(case when dataset = '{e}' then round(1 - present / n, 4) end) as {e}" for e in ERAS) + " from ox_stats group by col")
def feature_availability(t):
    frame = contract_frame(t)
    return contracts.feature_availability(stats_of(t), eras_of(frame))


@query("feature_health", """
select dataset, max(n) as n_rows, count(*) filter (present = 0) as fully_null_features,
  count(*) filter (1 - present / n > 0.5) as high_null_features,
  count(*) filter (present > 1 and n_distinct <= 1) as zero_variance_features,
  coalesce(string_agg(col, ', ' order by col) filter (present > 1 and n_distinct <= 1), '') as zero_var_list
from ox_stats group by dataset
""")
def feature_health(t):
    return contracts.feature_health(stats_of(t))


def _diagnostics_sql(frame: str, cols) -> str:
    return " union all ".join(
        f"select dataset, '{c}' as col, count(*) as rows, round(1 - count({c}) / count(*), 4) as null_rate, "
        f"case when count({c}) > 1 and count(distinct {c}) <= 1 then 1 else 0 end as zero_variance "
        f"from {frame} group by dataset" for c in cols)


@query("fully_null_features", """
select col, dataset, round(1 - present / n, 3) as null_rate from ox_stats
where col in (select col from ox_stats where present = 0)
""")
def fully_null_features(t):
    return contracts.fully_null_features(stats_of(t))


@query("validate_round1", _diagnostics_sql("ox_round1", fv.ROUND1_COLS))
def validate_round1(t):
    return contracts.validate_round1(round1.round1_of(t))


SQL_VIEWS["ox_full"] = "select r.*, m.* exclude (dataset, user_id, label) from ox_round1 r join (" + graphs._MERGED + \
    ") m on m.dataset = r.dataset and m.user_id = r.user_id"


@query("final_contract", _diagnostics_sql("ox_full", fv.ROUND1_COLS + fv.GRAPH_COLS))
def final_contract(t):
    return contracts.final_contract(graph_merge(round1.round1_of(t), graph_features(t.fx_edges)))


def _reason_sql(denied: str) -> str:
    """First failing test of a column over the eras of its group."""
    deny = ", ".join(f"'{c}'" for c in fv.CROSS_ERA_DENY_COLS)
    bad = "string_agg('''' || dataset || '''', ', ' order by dataset) filter"
    return f"""case when count(dataset) = 0 then 'not in frame'
  when {denied} and col in ({deny}) then 'deny_cols (reference-date sensitive)'
  when {denied} and starts_with(col, 'emb_') then 'deny_prefixes (e.g. unaligned embeddings)'
  when count(*) filter (1 - present / n >= 0.99) > 0 then 'NaN rate ≥ 0.99 in: [' || {bad} (1 - present / n >= 0.99) || ']'
  when count(*) filter (n_distinct <= 1) > 0 then 'zero variance in: [' || {bad} (n_distinct <= 1) || ']' end"""


_NAMES = " union all ".join(f"select '{c}' as col" for c in CANDIDATES)

SQL_VIEWS["ox_cross"] = f"""
select col, {_reason_sql('true')} as reason from ({_NAMES}) names left join ox_stats using (col) group by col
"""

SQL_VIEWS["ox_pairwise"] = f"""
select train, test, case when train = test then 'within-dataset' else 'cross-era' end as scope, col,
  {_reason_sql('train <> test')} as reason
from (select distinct a.dataset as train, b.dataset as test from fx_docs a cross join (select distinct dataset from fx_docs) b) g
cross join ({_NAMES}) names left join ox_stats s using (col)
where s.dataset is null or s.dataset in (train, test) group by train, test, col
"""


@query("cross_era_features", "select col, case when reason is null then 1 else 0 end as kept, reason from ox_cross")
def cross_era_features(t):
    picked = contracts.cross_era_features(contract_frame(t), CANDIDATES)
    return picked.withColumn("kept", F.col("kept").cast("int"))


def contract_of(t):
    frame = contract_frame(t)
    return contracts.pairwise_contract(stats_of(t), CANDIDATES, eras_of(frame))


@query("pairwise_contract", """
select train, test, scope, col, case when reason is null then 1 else 0 end as kept, reason from ox_pairwise
""")
def pairwise_contract(t):
    return contract_of(t).withColumn("kept", F.col("kept").cast("int"))


@query("pair_feature_counts", """
select train, test, scope, count(*) filter (reason is null) as n_features,
  string_agg(col, ', ' order by col) filter (reason is null) as features from ox_pairwise group by all
""")
def pair_feature_counts(t):
    return contracts.pair_feature_counts(contract_of(t))


@query("pair_gain", """
select train, test, col from ox_pairwise where reason is null and col not in (select col from ox_cross where reason is null)
""")
def pair_gain(t):
    frame = contract_frame(t)
    safe = contracts.cross_era_features(frame, CANDIDATES)
    return contracts.pair_gain(contract_of(t), safe)


@query("pair_grid", """
select a.dataset as train, b.dataset as test, case when a.dataset = b.dataset then 'within-dataset' else 'cross-era' end as scope
from (select distinct lang as dataset from documents) a cross join (select distinct lang as dataset from documents) b
""")
def pair_grid(t):
    return contracts.pair_grid(t.fx_docs, eras_of(t.fx_docs))
