"""Evaluation tables over a score per (train, test) pair and over importances."""

from pyspark.sql import functions as F

from erashift.catalog.fixtures import SQL_VIEWS
from erashift.catalog.registry import query, rounded
from erashift.operators import evaluation, importances
from erashift.operators.skew import eras_of

ERAS = ["de", "en", "es", "fr"]

SQL_VIEWS["ox_auc"] = """
select train, test, sum(y) as n_pos, sum(1 - y) as n_neg,
  (sum(case when y = 1 then avg_rank end) - sum(y) * (sum(y) + 1) / 2.0::double)
    / nullif(sum(y)::double * sum(1 - y), 0) as auc
from (select *, rank() over (partition by train, test order by score)
        + (count(*) over (partition by train, test, score) - 1) / 2.0::double as avg_rank from fx_pair_scores)
group by train, test
"""

# Three stand-in model families: the score, its negative, and the score in steps.
SQL_VIEWS["ox_models"] = """
select 'base' as model, train, test, auc from ox_auc
union all select 'flipped', train, test, 1 - auc from ox_auc
union all select 'mixed', train, test, case when train < test then auc else 1 - auc end from ox_auc
"""


@query("auc_exact", """
select train, test, cast(n_pos as bigint) as n_pos, cast(n_neg as bigint) as n_neg, round(auc, 9) as auc from ox_auc
""")
def auc_exact(t):
    return rounded(evaluation.auc_exact(t.fx_pair_scores), digits=9)


def aucs(t):
    return evaluation.auc_exact(t.fx_pair_scores).select("train", "test", "auc")


def model_aucs(t):
    a = aucs(t)
    mixed = F.when(F.col("train") < F.col("test"), F.col("auc")).otherwise(1 - F.col("auc"))
    views = F.array(*[F.struct(F.lit(m).alias("model"), v.alias("auc")) for m, v in
                      (("base", F.col("auc")), ("flipped", 1 - F.col("auc")), ("mixed", mixed))])
    return a.select("train", "test", F.explode(views).alias("m")).select("m.model", "train", "test", "m.auc")


@query("roc_curve", """
select train, test, score as threshold,
  round(sum(n) over w / nullif(sum(n) over (partition by train, test), 0), 9) as fpr,
  round(sum(p) over w / nullif(sum(p) over (partition by train, test), 0), 9) as tpr
from (select train, test, score, sum(y)::double as p, sum(1 - y)::double as n from fx_pair_scores group by all)
window w as (partition by train, test order by score desc)
union all select distinct train, test, cast(null as double), 0.0::double, 0.0::double from fx_pair_scores
""")
def roc_curve(t):
    return rounded(evaluation.roc_curve(t.fx_pair_scores), "fpr", "tpr", digits=9)


_THRESHOLD = 500.0


@query("confusion_matrix", f"""
select g.train, g.test, g.truth, g.predicted, g.n,
  round(g.n / nullif(cast(sum(g.n) over (partition by g.train, g.test, g.truth) as double), 0), 9) as row_share
from (select p.train, p.test, cast(a.t as integer) as truth, cast(b.q as integer) as predicted,
        count(*) filter (p.y = a.t and (case when p.score >= {_THRESHOLD} then 1 else 0 end) = b.q) as n
      from fx_pair_scores p cross join range(2) a(t) cross join range(2) b(q) group by all) g
""")
def confusion_matrix(t):
    return rounded(evaluation.confusion_matrix(t.fx_pair_scores, threshold=_THRESHOLD), digits=9)


@query("accuracy", f"""
select train, test, round(avg(case when (score >= {_THRESHOLD}) = (y = 1) then 1 else 0 end), 9) as accuracy
from fx_pair_scores group by train, test
""")
def accuracy(t):
    return rounded(evaluation.accuracy(t.fx_pair_scores, threshold=_THRESHOLD), digits=9)


@query("score_minmax", """
select train, test, user_id, y, round((score - min(score) over w) / (max(score) over w - min(score) over w + 1e-8), 6) as score
from fx_pair_scores window w as (partition by train, test)
""")
def score_minmax(t):
    return rounded(evaluation.score_minmax(t.fx_pair_scores, ["train", "test"])).select(
        "train", "test", "user_id", "y", "score")


@query("metric_matrix", "select train, " + ", ".join(
    f"round(max(case when test = '{e}' then auc end), 9) as {e}" for e in ERAS) + " from ox_auc group by train")
def metric_matrix(t):
    return rounded(evaluation.metric_matrix(aucs(t), eras_of(t.fx_docs)), digits=9)


@query("mean_cross_era", "select round(avg(auc), 9) as mean_cross_auc from ox_auc where train <> test")
def mean_cross_era(t):
    return rounded(evaluation.mean_cross_era(aucs(t)), digits=9)


@query("diagonal_vs_cross", """
select train as train_dataset, round(max(case when train = test then auc end), 9) as diagonal_auc,
  round(avg(case when train <> test then auc end), 9) as mean_cross_auc from ox_auc group by train
""")
def diagonal_vs_cross(t):
    return rounded(evaluation.diagonal_vs_cross(aucs(t)), digits=9)


@query("degradation", """
select train, test, round(max(case when train = test then auc end) over (partition by train) - auc, 9) as degradation from ox_auc
""")
def degradation(t):
    return rounded(evaluation.degradation(aucs(t)), digits=9)


@query("best_model_per_pair", """
select train, test, model, round(auc, 9) as auc from (
  select *, row_number() over (partition by train, test order by auc desc, model) as k from ox_models where auc is not null
) where k = 1
""")
def best_model_per_pair(t):
    return rounded(evaluation.best_model_per_pair(model_aucs(t)), digits=9)


@query("mean_auc_by_model", """
select model, round(avg(auc), 9) as mean_cross_auc from ox_models where train <> test group by model
""")
def mean_auc_by_model(t):
    return rounded(evaluation.mean_auc_by_model(model_aucs(t)), digits=9)


@query("auc_by_pair", "select train, test, " + ", ".join(
    f"round(max(case when model = '{m}' then auc end), 9) as {m}" for m in ("base", "flipped", "mixed"))
    + " from ox_models group by train, test")
def auc_by_pair(t):
    return rounded(evaluation.auc_by_pair(model_aucs(t), ["base", "flipped", "mixed"]), digits=9)


# --- importances ------------------------------------------------------------

@query("importance_ranking", """
select pair, feature, value, cast(row_number() over (partition by pair order by abs(value) desc, feature) as integer) as rank
from fx_importances
""")
def importance_ranking(t):
    return importances.importance_ranking(t.fx_importances, "logreg")


@query("importance_topk", """
select pair, feature, value, cast(k as integer) as rank from (
  select *, row_number() over (partition by pair order by value desc, feature) as k from fx_importances) where k <= 5
""")
def importance_topk(t):
    return importances.importance_topk(t.fx_importances, "rf", 5)


@query("stable_top_features", """
select feature, count(*) as n_pairs from (
  select *, row_number() over (partition by pair order by abs(value) desc, feature) as k from fx_importances)
where k <= 10 group by feature
""")
def stable_top_features(t):
    return importances.stable_top_features(t.fx_importances, "logreg", 10)


_BRANDS = [f"Brand#{i}{j}" for i in range(1, 6) for j in range(1, 6)]


@query("importance_matrix", "select feature, " + ", ".join(
    f"coalesce(max(case when pair = '{b}' then value end), 0.0::double) as \"{b}\"" for b in _BRANDS)
    + " from fx_importances group by feature")
def importance_matrix(t):
    return importances.importance_matrix(t.fx_importances, _BRANDS)
