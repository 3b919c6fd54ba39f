"""Splits, preprocessing, classifiers and the pairwise experiment.

Eras are document languages, bots are low-quality documents, features are
simple text measures.
"""

from pyspark.sql import functions as F

from erashift.catalog.fixtures import SQL_VIEWS
from erashift.catalog.registry import query, rounded
from erashift.operators import contracts, linear_fit, models
from erashift.operators.evaluation import auc_exact
from erashift.operators.skew import eras_of
from erashift.plans import experiment
from erashift.session import cut

FEATURES = ["n_chars", "n_lines", "n_words", "digits", "upper_share", "url_count"]

SQL_VIEWS["fx_features"] = r"""
select d.lang as dataset, cast(d.doc_id as varchar) as user_id, case l.quality when 1 then 'human' when 0 then 'bot' end as label,
  cast(d.n_chars as double) as n_chars, cast(len(regexp_extract_all(text, '\n')) + 1 as double) as n_lines,
  case when d.doc_id % 5 <> 0 then cast(len(regexp_extract_all(text, '[^ \n]+')) as double) end as n_words,
  case when d.doc_id % 3 <> 0 then cast(len(regexp_extract_all(text, '[0-9]')) as double) end as digits,
  len(regexp_extract_all(text, '[A-Z]')) / greatest(length(text), 1)::double as upper_share,
  cast(len(regexp_extract_all(text, 'http[^ ]+')) as double) as url_count
from documents d left join labels l on l.doc_id = d.doc_id
"""


def frame_of(t):
    def n(pattern):
        return F.regexp_count("text", F.lit(pattern)).cast("double")

    quality = F.when(F.col("quality") == 1, "human").when(F.col("quality") == 0, "bot")
    key = F.col("doc_id")
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("lang").alias("dataset"), key.cast("string").alias("user_id"), quality.alias("label"),
        F.col("n_chars").cast("double").alias("n_chars"), (n("\n") + 1).alias("n_lines"),
        F.when(key % 5 != 0, n("[^ \n]+")).alias("n_words"), F.when(key % 3 != 0, n("[0-9]")).alias("digits"),
        (n("[A-Z]") / F.greatest(F.length("text"), F.lit(1))).alias("upper_share"), n("http[^ ]+").alias("url_count"),
    )


def contract_of(frame):
    return contracts.pairwise_contract(contracts.column_stats(frame, FEATURES), FEATURES, eras_of(frame))


SQL_VIEWS["ox_split"] = """
select *, case when row_number() over (partition by dataset, y order by md5(concat('42|', user_id))) <= k then 1 else 0 end as is_test
from (select f.*, case label when 'bot' then 1 else 0 end as y from fx_features f where label is not null) r
join (select dataset, y, n - whole - case when row_number() over (partition by dataset order by exact - whole desc, y desc)
          <= train_n - sum(whole) over (partition by dataset) then 1 else 0 end as k
      from (select *, floor(exact) as whole from (
        select *, n * train_n / all_n as exact from (
          select dataset, y, count(*) as n, sum(count(*)) over (partition by dataset)::double as all_n,
            sum(count(*)) over (partition by dataset) - ceil(0.2::double * sum(count(*)) over (partition by dataset)) as train_n
          from (select dataset, case label when 'bot' then 1 else 0 end as y from fx_features where label is not null)
          group by dataset, y)))) using (dataset, y)
"""


@query("stratified_split", "select dataset, user_id, y, is_test from ox_split")
def stratified_split(t):
    rows = models.labelled(frame_of(t).select("dataset", "user_id", "label"))
    return models.stratified_split(rows).select("dataset", "user_id", "y", "is_test")


@query("pair_data", """
select train, test, y, cast(sum(n_train) as bigint) as n_train, cast(sum(n_test) as bigint) as n_test from (
  select a.train, b.test, s.y, case when s.dataset = a.train and (a.train <> b.test or s.is_test = 0) then 1 else 0 end as n_train,
    case when s.dataset = b.test and (a.train <> b.test or s.is_test = 1) then 1 else 0 end as n_test
  from ox_split s cross join (select distinct dataset as train from ox_split) a cross join (select distinct dataset as test from ox_split) b
  where s.dataset in (a.train, b.test)) group by train, test, y
""")
def pair_data(t):
    split = models.stratified_split(models.labelled(frame_of(t).select("dataset", "user_id", "label")))
    return experiment.pair_counts(split, eras_of(split))


@query("median_impute", """
select dataset, user_id, coalesce(n_words, (select median(n_words) from fx_features where dataset = 'en')) as n_words,
  coalesce(digits, (select median(digits) from fx_features where dataset = 'en')) as digits from fx_features
""")
def median_impute(t):
    frame = frame_of(t).select("dataset", "user_id", "n_words", "digits")
    return models.median_impute(frame, frame.filter("dataset = 'en'"), ["n_words", "digits"])


@query("standardize", """
select f.dataset, f.user_id, round((f.n_chars - m.a) / m.s, 6) as n_chars, round((coalesce(f.n_words, m.w) - m.b) / m.r, 6) as n_words
from fx_features f cross join (
  select avg(n_chars) as a, stddev_pop(n_chars) as s, avg(coalesce(n_words, w)) as b, stddev_pop(coalesce(n_words, w)) as r, max(w) as w
  from fx_features cross join (select median(n_words) as w from fx_features where dataset = 'en') where dataset = 'en') m
""")
def standardize(t):
    frame = frame_of(t).select("dataset", "user_id", "n_chars", "n_words")
    return rounded(models.standardize(frame, frame.filter("dataset = 'en'"), ["n_chars", "n_words"]))


@query("class_weights", """
select dataset, y, count(*) as n, round(sum(count(*)) over (partition by dataset) / (2.0::double * count(*)), 9) as weight
from (select dataset, case label when 'bot' then 1 else 0 end as y from fx_features where label is not null) group by dataset, y
""")
def class_weights(t):
    return rounded(models.class_weights(models.labelled(frame_of(t)), ["dataset"]), digits=9)


def _trained(t, model_type):
    """One era's model, scored on every labelled document."""
    rows = models.labelled(frame_of(t))
    train = rows.filter("dataset = 'en'").persist()
    model = models.fit_model(train, FEATURES, model_type)
    train.unpersist()
    if model is None:
        raise ValueError("the training era has one class only")
    return rows, models.Bundle(model_type, "en", "all", FEATURES, model)


def _model_query(model_type):
    def run(t):
        rows, bundle = _trained(t, model_type)
        return models.predict_with_bundle(bundle, rows, ["dataset", "user_id", "y"])

    return run


for _key, _family in (("model_logreg", "logreg"), ("model_ridge", "ridge"), ("model_lasso", "lasso"),
                      ("model_rf", "rf"), ("model_gbt", "xgb"), ("model_svm", "svm")):
    query(_key)(_model_query(_family))


@query("predict_with_bundle")
def predict_with_bundle(t):
    """AUC per era of the logistic model trained on one era."""
    rows, bundle = _trained(t, "logreg")
    return auc_exact(models.predict_with_bundle(bundle, rows, ["dataset", "y"]), ["dataset"])


@query("feature_importance")
def feature_importance(t):
    _, bundle = _trained(t, "lasso")
    return models.collect_importances(t.spark, [bundle])


SQL_VIEWS["ox_kept"] = f"""
select dataset, col from (select dataset, {', '.join(FEATURES)} from fx_features) unpivot include nulls (v for col in ({', '.join(FEATURES)}))
group by dataset, col having avg(case when v is null then 1 else 0 end) < 0.99 and min(v) <> max(v)
"""


@query("pairwise_experiment_sizes", """
select a.train, b.test, case when a.train = b.test then 'within-dataset' else 'cross-era' end as scope,
  (select count(*) from ox_kept x join ox_kept y using (col) where x.dataset = a.train and y.dataset = b.test) as n_features,
  cast(sum(case when s.dataset = a.train and (a.train <> b.test or s.is_test = 0) then 1 else 0 end) as bigint) as n_train,
  cast(sum(case when s.dataset = b.test and (a.train <> b.test or s.is_test = 1) then 1 else 0 end) as bigint) as n_test
from ox_split s cross join (select distinct dataset as train from ox_split) a cross join (select distinct dataset as test from ox_split) b
group by a.train, b.test
""")
def pairwise_experiment_sizes(t):
    """The part of the experiment's result table that does not depend on a fit."""
    frame = frame_of(t)
    run = experiment.run_pairwise_experiment(frame, contract_of(frame), eras_of(frame), "ridge")
    return run.results.select("train", "test", "scope", F.col("n_features").cast("bigint").alias("n_features"), "n_train", "n_test")


SQL_VIEWS["ox_parts"] = """
select dataset, 'all' as part, * exclude (dataset) from ox_split union all select dataset, 'train' as part, * exclude (dataset) from ox_split where is_test = 0
"""


@query("era_statistics", f"""
with t as (select dataset, part, col, v from (select dataset, part, {', '.join(FEATURES)} from ox_parts)
           unpivot include nulls (v for col in ({', '.join(FEATURES)}))),
m as (select *, median(v) over (partition by dataset, part, col) as median from t)
select dataset, part, col, count(*) as n, count(v) as known, round(max(median), 6) as median, round(avg(coalesce(v, median)), 6) as mean,
  round(stddev_pop(coalesce(v, median)), 6) as std from m group by dataset, part, col
""")
def era_statistics(t):
    """What every fit needs of every era, from one grouped aggregation."""
    split = models.stratified_split(models.labelled(frame_of(t)))
    return rounded(linear_fit.column_statistics(split, FEATURES), "median", "mean", "std")


@query("era_class_weights", """
select dataset, part, y, count(*) as n, round(sum(count(*)) over (partition by dataset, part) / (2.0::double * count(*)), 9) as weight
from ox_parts group by dataset, part, y
""")
def era_class_weights(t):
    split = models.stratified_split(models.labelled(frame_of(t)))
    return rounded(linear_fit.class_statistics(split), digits=9)


def optimality(rows, bundle, weights):
    """The largest violation of the optimality condition of a fitted linear model, its gradient recomputed by Spark SQL
    from the rows and the stored weights."""
    *prepared, last = bundle.model.stages
    family, theta = bundle.model_type, [*map(float, last.coefficients), float(last.intercept)]
    for stage in prepared:
        rows = stage.transform(rows)
    inputs = [*[F.col(f"_x_{c}") for c in bundle.feature_cols], F.lit(1.0)]
    side = F.when(F.col("y") == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    share = F.when(F.col("y") == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    margin = side * sum((x * F.lit(v) for x, v in zip(inputs, theta)), F.lit(0.0))
    pull = 2 * F.greatest(F.lit(0.0), 1 - margin) if family == "svm" else 1 / (1 + F.exp(margin))
    grads = rows.select(*[(-share * side * pull * x).alias(f"g{k}") for k, x in enumerate(inputs)]).agg(*[F.sum(f"g{k}") for k in range(len(theta))]).first()
    most = 0.0
    for k, (g, v) in enumerate(zip(grads, theta)):
        g *= linear_fit.COST[family]
        if family == "lasso":
            most = max(most, abs(g + (1 if v > 0 else -1)) if v else abs(g) - 1)
        else:
            most = max(most, abs(g if k == len(theta) - 1 and family != "svm" else g + v))
    return most


@query("linear_optimality", f"""
select family, dataset, count(*) as n, {len(FEATURES)} as n_features, true as optimal
from ox_split cross join (values ('logreg'), ('ridge'), ('lasso'), ('svm')) f(family) group by family, dataset having count(distinct y) = 2
""")
def linear_optimality(t):
    """Each linear family fitted to each whole era: whether the stored weights minimise their objective."""
    split = cut(models.stratified_split(models.labelled(frame_of(t))))
    columns, classes = linear_fit.collect_statistics(split, FEATURES)
    sets = [linear_fit.TrainingSet(era, "all", tuple(FEATURES)) for era in eras_of(split)]
    out = []
    for family in ("logreg", "ridge", "lasso", "svm"):
        for s, problem in linear_fit.fit_sets(split, sets, family, columns, classes).items():
            model = models.linear_model(t.spark, problem, FEATURES, columns[s.era, s.part])
            of = classes[s.era, s.part]
            worst = optimality(split.filter(F.col("dataset") == s.era), models.Bundle(family, s.era, s.era, FEATURES, model), {y: w for y, (_, w) in of.items()})
            out.append((family, s.era, sum(n for n, _ in of.values()), len(FEATURES), worst < 1e-4))
    return t.spark.createDataFrame(out, "family string, dataset string, n bigint, n_features int, optimal boolean")


@query("pairwise_experiment")
def pairwise_experiment(t):
    frame = frame_of(t)
    run = experiment.run_pairwise_experiment(frame, contract_of(frame), eras_of(frame), "logreg")
    return run.results
