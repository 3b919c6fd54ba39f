"""Feature contracts: which columns are safe for which pair of eras, and why not.

Everything derives from one small table of statistics per (dataset, column);
the data itself is read once however many pairs there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.operators.order_stats import melt
from erashift.session import cut

STAT_COLS = ["dataset", "col", "rows", "present", "low", "high"]


def expand_embeddings(df: DataFrame, col: str = "emb", dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """Array column to emb_0 ... emb_{dim-1}."""
    return df.select(
        *[c for c in df.columns if c != col],
        *[F.col(col)[i].cast("double").alias(f"emb_{i}") for i in range(dim)],
    )


def column_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """rows, non-NULL rows, min and max per (dataset, col).

    The melted rows are combined map-side and never stored; the plan does not
    grow with the number of columns.
    """
    return melt(df.filter("dataset is not null"), ["dataset"], cols).groupBy("dataset", "col").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("present"),
        F.min("value").alias("low"), F.max("value").alias("high"),
    )


def _null_rate() -> Column:
    return 1 - F.col("present") / F.col("rows")


def _varies() -> Column:
    return F.coalesce(F.col("low") < F.col("high"), F.lit(False))


def feature_null_rates(stats: DataFrame, digits: int = 4) -> DataFrame:
    return stats.select("dataset", "col", F.round(_null_rate(), digits).alias("null_rate"))


def feature_availability(stats: DataFrame, eras: list[str], digits: int = 4) -> DataFrame:
    """Null rates with one column per era."""
    return feature_null_rates(stats, digits).groupBy("col").pivot("dataset", eras).agg(F.first("null_rate"))


def feature_distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct values per (dataset, col), counted per value and then per column."""
    once = melt(df.filter("dataset is not null"), ["dataset"], cols).distinct()
    return once.groupBy("dataset", "col").agg(F.count("value").alias("n_distinct"))


def feature_diagnostics(stats: DataFrame) -> DataFrame:
    """Rows, null rate and constant flag per (dataset, col). A column with at
    most one value is not called constant here."""
    constant = (F.col("present") > 1) & ~_varies()
    return stats.select(
        "dataset", "col", "rows", F.round(_null_rate(), 4).alias("null_rate"),
        constant.cast("int").alias("zero_variance"),
    )


def feature_health(stats: DataFrame) -> DataFrame:
    """Per era: rows, fully and mostly NULL features, constant features by name."""
    constant = (F.col("present") > 1) & ~_varies()
    names = F.array_sort(F.collect_list(F.when(constant, F.col("col"))))
    return stats.groupBy("dataset").agg(
        F.max("rows").alias("n_rows"),
        F.count_if(F.col("present") == 0).alias("fully_null_features"),
        F.count_if(_null_rate() > 0.5).alias("high_null_features"),
        F.count_if(constant).alias("zero_variance_features"),
        F.array_join(names, ", ").alias("zero_var_list"),
    )


def fully_null_features(stats: DataFrame) -> DataFrame:
    """Features without any value in at least one era, with all their rates."""
    empty = stats.filter("present = 0").select("col").distinct()
    return stats.join(F.broadcast(empty), "col", "left_semi").select(
        "col", "dataset", F.round(_null_rate(), 3).alias("null_rate"))


def validate_frame(df: DataFrame, cols: list[str]) -> DataFrame:
    """Raise on missing columns or repeated keys; return feature_diagnostics. The frame is computed once."""
    absent = [c for c in ("dataset", "user_id", *cols) if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    df = cut(df.select("dataset", "user_id", *cols))  # read twice below
    repeated = df.groupBy("dataset", "user_id").count().filter("count > 1")
    if not repeated.isEmpty():
        raise ValueError("(dataset, user_id) is not unique")
    return feature_diagnostics(column_stats(df, cols))


def validate_round1(df: DataFrame) -> DataFrame:
    return validate_frame(df, fv.ROUND1_COLS)


def final_contract(df: DataFrame) -> DataFrame:
    return validate_frame(df, fv.ROUND1_COLS + fv.GRAPH_COLS)


def _verdict(deny_cols: list[str], deny_prefixes: list[str], max_null_rate: float,
             require_variance: bool, denied: Column) -> Column:
    """The first failed test as text, NULL if all pass."""
    def listed(names: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(names), lambda e: F.concat(F.lit("'"), e, F.lit("'"))), ", ")

    def message(template: str, names: Column) -> Column:
        head, tail = template.replace("{rate}", str(max_null_rate)).split("{eras}")
        return F.concat(F.lit(head), listed(names), F.lit(tail))

    prefixed = F.lit(False)
    for p in deny_prefixes:
        prefixed = prefixed | F.col("col").startswith(p)
    out = (
        F.when(F.col("eras") == 0, fv.REASON_ABSENT)
        .when(denied & F.col("col").isin(deny_cols), fv.REASON_DENY_COL)
        .when(denied & prefixed, fv.REASON_DENY_PREFIX)
        .when(F.size("sparse") > 0, message(fv.REASON_NULLS, F.col("sparse")))
    )
    if require_variance:
        out = out.when(F.size("constant") > 0, message(fv.REASON_CONSTANT, F.col("constant")))
    return out


def _failures(stats: DataFrame, keys: list[str], max_null_rate: float) -> DataFrame:
    """Per key and column the eras that are too sparse or constant."""
    return stats.groupBy(*keys, "col").agg(
        F.count("dataset").alias("eras"),
        F.collect_set(F.when(_null_rate() >= max_null_rate, F.col("dataset"))).alias("sparse"),
        F.collect_set(F.when(~_varies(), F.col("dataset"))).alias("constant"),
    )


def _with_absent(stats: DataFrame, candidates: list[str]) -> DataFrame:
    """Statistics of the candidate columns; unknown names as rows without an era."""
    spark = stats.sparkSession
    names = spark.createDataFrame([(c,) for c in candidates], "col string")
    return names.join(stats, "col", "left")


def cross_era_features(
    df: DataFrame, candidate_cols: list[str] | None = None,
    deny_cols: list[str] = fv.CROSS_ERA_DENY_COLS, deny_prefixes: list[str] = fv.CROSS_ERA_DENY_PREFIXES,
    max_null_rate: float = fv.MAX_NULL_RATE, require_variance: bool = True,
) -> DataFrame:
    """Columns that are safe in every era: (col, kept, reason)."""
    if candidate_cols is None:
        candidate_cols = [c for c in df.columns if c not in fv.META_COLS]
    stats = column_stats(df, [c for c in candidate_cols if c in df.columns])
    return cross_era_contract(stats, candidate_cols, deny_cols, deny_prefixes, max_null_rate, require_variance)


def cross_era_contract(
    stats: DataFrame, candidate_cols: list[str],
    deny_cols: list[str] = fv.CROSS_ERA_DENY_COLS, deny_prefixes: list[str] = fv.CROSS_ERA_DENY_PREFIXES,
    max_null_rate: float = fv.MAX_NULL_RATE, require_variance: bool = True,
) -> DataFrame:
    failures = _failures(_with_absent(stats, candidate_cols), [], max_null_rate)
    reason = _verdict(deny_cols, deny_prefixes, max_null_rate, require_variance, F.lit(True))
    return failures.select("col", reason.alias("reason")).select(
        "col", F.col("reason").isNull().alias("kept"), "reason")


def pair_grid(df: DataFrame, eras: list[str]) -> DataFrame:
    """Every (train, test) pair of the eras in df, with its scope."""
    present = df.select(F.col("dataset").alias("train")).filter("train is not null").distinct()
    return present.select(
        "train", F.explode(F.array(*[F.lit(e) for e in eras])).alias("test")
    ).withColumn("scope", F.when(F.col("train") == F.col("test"), fv.SCOPE_WITHIN).otherwise(fv.SCOPE_CROSS))


def pairwise_contract(
    stats: DataFrame, candidate_cols: list[str], eras: list[str],
    max_null_rate: float = fv.MAX_NULL_RATE,
) -> DataFrame:
    """(train, test, scope, col, kept, reason) for every pair of eras.

    Each statistics row is handed to the pairs its era takes part in. Deny
    rules apply only where train and test differ.
    """
    if not eras:
        raise ValueError("no eras given")
    present = stats.filter(F.col("col").isin(candidate_cols))
    partners = F.array(*[F.lit(e) for e in eras])
    me, other = F.col("dataset"), F.col("other")
    as_train = F.struct(me.alias("train"), other.alias("test"))
    as_test = F.struct(other.alias("train"), me.alias("test"))
    roles = (
        present.select("*", F.explode(partners).alias("other"))
        .select("*", F.explode(F.when(me == other, F.array(as_train)).otherwise(F.array(as_train, as_test))).alias("p"))
        .select(*STAT_COLS, "p.train", "p.test")
    )
    absent = sorted(set(candidate_cols) - set(_known_cols(stats)))
    failures = _failures(roles, ["train", "test"], max_null_rate)
    if absent:
        grid = pair_grid(stats, eras).select("train", "test")
        empty = F.array().cast("array<string>")
        failures = failures.unionByName(grid.select(
            "train", "test", F.explode(F.array(*[F.lit(c) for c in absent])).alias("col"),
            F.lit(0).cast("bigint").alias("eras"), empty.alias("sparse"), empty.alias("constant"),
        ))
    reason = _verdict(fv.CROSS_ERA_DENY_COLS, fv.CROSS_ERA_DENY_PREFIXES, max_null_rate, True,
                      F.col("train") != F.col("test"))
    scope = F.when(F.col("train") == F.col("test"), fv.SCOPE_WITHIN).otherwise(fv.SCOPE_CROSS)
    return failures.select("train", "test", scope.alias("scope"), "col", reason.alias("reason")).select(
        "train", "test", "scope", "col", F.col("reason").isNull().alias("kept"), "reason")


def _known_cols(stats: DataFrame) -> list[str]:
    """Column names with statistics; bounded by the width of a frame."""
    return [r["col"] for r in stats.select("col").distinct().collect()]


def pair_feature_counts(contract: DataFrame) -> DataFrame:
    return contract.groupBy("train", "test", "scope").agg(
        F.count_if("kept").alias("n_features"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kept"), F.col("col")))), ", ").alias("features"),
    )


def pair_gain(contract: DataFrame, cross_era: DataFrame) -> DataFrame:
    """Features a pair keeps that are not safe in all eras."""
    safe = cross_era.filter("kept").select("col")
    return contract.filter("kept").join(F.broadcast(safe), "col", "left_anti").select("train", "test", "col")
