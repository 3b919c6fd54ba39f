"""Exact order statistics without sorting any whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from erashift.operators.skew import HOT_ROWS, MAX_BROADCAST_ROWS, stored_small
from erashift.session import cut

SKETCH_K = 2_000  # of a quantile sketch: ranks within about 0.15 %
MARGIN = 0.005    # of ranks, on each side of a position
STEPS = 400       # ranks a sketch is asked for
FAN_OUT, PATH_DIGITS = 256, 3  # parts of a split range, digits of a part's number
_PREFIX = 4  # hex digits: 65 536 hash ranges


def melt(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row per key, column and value (as double; NULLs kept)."""
    return (
        df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols])
        .unpivot(keys, cols, "col", "value")
    )


def exact_quantiles(df: DataFrame, keys: list[str], cols: list[str], probs: list[float], hot_rows: int | None = None) -> DataFrame:
    """Linear-interpolated quantiles: rows (keys, col, prob, value).

    Every wanted position of every group has an open interval of values it lies in, with the number of rows below and
    inside. Intervals with more than hot_rows rows are narrowed: a mergeable sketch of the rows inside proposes a
    smaller interval, an exact count judges it (a sketch only errs with some probability; then the next one is wider),
    and a position that turns out to be one of the interval's ends is found. What is left to be ordered in one task is
    at most hot_rows values, however large a group is.
    """
    hot_rows = hot_rows or HOT_ROWS
    tall = melt(df, keys, cols).filter("value is not null")
    group = [*keys, "col"]
    sizes = cut(tall.groupBy(*group).agg(F.count(F.lit(1)).alias("n")))
    n_groups, largest = sizes.agg(F.count(F.lit(1)), F.max("n")).first()
    sized = F.broadcast if n_groups <= MAX_BROADCAST_ROWS else (lambda table: table)
    at = F.col("prob") * (F.col("n") - 1)
    wanted = sizes.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).select(
        *group, "n", "prob", F.floor(at).alias("a"), F.ceil(at).alias("b"), (at - F.floor(at)).alias("f"))
    edge = F.lit(None).cast("double")
    places = sized(wanted.select(*group, "n", F.explode(F.array("a", "b")).alias("at")).distinct().select(
        *group, "at", edge.alias("lo"), edge.alias("hi"), F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"),
        F.lit(MARGIN).alias("margin"), edge.alias("value")))
    while (largest or 0) > hot_rows and not places.filter(_wide(hot_rows)).isEmpty():
        places = stored_small(_narrowed(tall, places, group, hot_rows))
    place = [*group, "at"]
    within = Window.partitionBy(*place).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ordered = _inside(tall, places.filter("value is null"), group).groupBy(*place, "below", F.col("_x").alias("v")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("after", F.col("below") + F.sum("n").over(within))
    found = ordered.filter("at < after and at >= after - n").select(*place, F.col("v").alias("value")).unionByName(
        places.filter("value is not null").select(*place, "value"))
    low, high = (found.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("at").alias(out), F.col("value").alias(f"v{out}")) for out in ("a", "b"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
    names = [f"_{c}" for c in group]
    both = wanted.withColumnRenamed("a", "_a").join(low, [*same, F.col("_a") == F.col("a")]).drop(*names, "a")
    both = both.withColumnRenamed("b", "_b").join(high, [*same, F.col("_b") == F.col("b")]).drop(*names, "b")
    return both.select(*group, "prob", (F.col("va") + (F.col("vb") - F.col("va")) * F.col("f")).alias("value"))


def _wide(hot_rows: int) -> Column:
    return F.col("value").isNull() & (F.col("inside") > hot_rows)


def _inside(tall: DataFrame, places: DataFrame, group: list[str]) -> DataFrame:
    """The rows inside each place's interval, the row's value being _x."""
    rows = tall.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("value").alias("_x"))
    open_ = (F.col("lo").isNull() | (F.col("_x") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("_x") < F.col("hi")))
    return rows.join(places, [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in group]).filter(open_).drop(*[f"_{c}" for c in group])


def _narrowed(tall: DataFrame, places: DataFrame, group: list[str], hot_rows: int) -> DataFrame:
    """The places after one round: two passes over the rows, whatever the number of groups."""
    place = [*group, "at"]
    kept = [*place, "lo", "hi", "below", "inside", "margin"]
    wide = places.filter(_wide(hot_rows)).select(*kept)
    rank = (F.col("at") - F.col("below") + 0.5) / F.col("inside")

    def cut_point(step: Column) -> Column:  # a sketch is asked for fixed ranks only
        return F.element_at("ladder", F.least(F.greatest(step, F.lit(0)), F.lit(STEPS)).cast("int") + 1)

    sketched = _inside(tall, wide, group).groupBy(*kept).agg(F.kll_sketch_agg_double("_x", SKETCH_K).alias("sketch"))
    ranks = F.array(*[F.lit(k / STEPS) for k in range(STEPS + 1)])
    sketched = sketched.select(*kept, F.kll_sketch_get_quantile_double("sketch", ranks).alias("ladder"))
    tried = stored_small(sketched.select(*kept, cut_point(F.floor((rank - F.col("margin")) * STEPS)).alias("from"),
                                         cut_point(F.ceil((rank + F.col("margin")) * STEPS)).alias("to")))
    x = F.col("_x")
    counted = _inside(tall, tried, group).groupBy(*kept, "from", "to").agg(
        F.count_if(x < F.col("from")).alias("less"), F.count_if(x == F.col("from")).alias("at_from"),
        F.count_if((x > F.col("from")) & (x < F.col("to"))).alias("between"),
        F.count_if((x == F.col("to")) & (F.col("to") > F.col("from"))).alias("at_to"))
    start = F.col("below") + F.col("less")
    first, last = start + F.col("at_from"), start + F.col("at_from") + F.col("between")
    here = (F.col("at") >= first) & (F.col("at") < last)
    value = F.when((F.col("at") >= start) & (F.col("at") < first), F.col("from")).when(
        (F.col("at") >= last) & (F.col("at") < last + F.col("at_to")), F.col("to"))

    def taken(new: Column, old: str) -> Column:
        return F.when(here, new).otherwise(F.col(old))

    done = counted.select(
        *place, taken(F.col("from"), "lo").alias("lo"), taken(F.col("to"), "hi").alias("hi"), taken(first, "below").alias("below"),
        taken(F.col("between"), "inside").alias("inside"), F.when(here, F.lit(MARGIN)).otherwise(F.col("margin") * 4).alias("margin"), value.alias("value"))
    return done.unionByName(places.filter(~_wide(hot_rows)).select(*done.columns))


def hash_order(seed, *cols: Column) -> Column:
    """A repeatable pseudo-random order: md5 of seed and key."""
    parts = [F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]]
    return F.md5(F.concat_ws("|", *parts))


def hash_cut(hashed: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """Per group the hash of its k-th smallest row: (keys, cut).

    `hashed` has keys and `h`; `wanted` has keys and `k`, one row per group.
    Counting by hash range first leaves one range per group to be ordered.
    """
    ranged = hashed.withColumn("range", F.substring("h", 1, _PREFIX))
    upto = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    target = stored_small(
        ranged.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("after", F.sum("n").over(upto))
        .join(wanted, keys)
        .filter("after - n < k and k <= after")
        .select(*keys, "range", (F.col("k") - F.col("after") + F.col("n")).alias("need"))
    )
    order = Window.partitionBy(*keys).orderBy("h")
    return (
        ranged.join(target, [*keys, "range"])
        .withColumn("pos", F.row_number().over(order))
        .filter("pos = need")
        .select(*keys, F.col("h").alias("cut"))
    )


def hash_sample(df: DataFrame, n: int, key_cols: list[str], seed=42) -> DataFrame:
    """Exactly n rows (all if fewer), the n smallest by md5(seed, key)."""
    hashed = df.withColumn("h", hash_order(seed, *[F.col(c) for c in key_cols]))
    one = hashed.select(F.lit(0).alias("g"), "h")
    wanted = df.sparkSession.createDataFrame([(0, n)], "g int, k bigint")
    cut_row = hash_cut(one, ["g"], wanted).first()
    if cut_row is None:
        return df
    near = hashed.filter(F.col("h") <= cut_row["cut"])
    return near.orderBy("h", *df.columns).limit(n).drop("h")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """Add id = 0..n-1 to distinct (dataset, user_id) rows, numbering by hash
    range, so that no task sees all of them."""
    ranged = nodes.withColumn("h", hash_order("id", F.col("dataset"), F.col("user_id"))).withColumn(
        "range", F.substring("h", 1, _PREFIX))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 65 536 rows at most
    offsets = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select(
        "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("range").orderBy("h", "dataset", "user_id")
    return (
        ranged.withColumn("pos", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), "range")
        .select(*nodes.columns, (F.col("pos") + F.col("offset")).alias("id"))
    )


def value_ranges(df: DataFrame, col: str, hot_rows: int | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """Add `path`, text whose order is that of col's ranges; no range holds more than hot_rows rows of different values.

    Ranges that are too large are split by a quantile sketch of their rows, those parts again where they need it, and
    so on: as many levels as the number of rows asks for, with at most 2 * fan_out + 1 parts each. Equal values always
    share a range, so results built on top are exact whatever the sketches say.
    """
    hot_rows = hot_rows or HOT_ROWS
    ranks = F.array(*[F.lit(k / (fan_out - 1)) for k in range(fan_out)])
    out = df.withColumn("path", F.lit(""))
    depth = 0
    while True:
        sizes = out.filter(F.length("path") == PATH_DIGITS * depth).groupBy("path").agg(
            F.count(F.lit(1)).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"), F.kll_sketch_agg_double(col, SKETCH_K).alias("sketch"))
        wide = stored_small(sizes.filter((F.col("n") > hot_rows) & (F.col("lo") < F.col("hi"))).select(
            F.col("path").alias("_path"), F.kll_sketch_get_quantile_double("sketch", ranks).alias("_cuts")))
        if wide.isEmpty():
            return out
        out = out.join(wide, F.col("path") == F.col("_path"), "left")
        # a cut point is a part of its own, so a value that fills much of a range leaves it at once
        before, upto = (F.size(F.filter("_cuts", keep)) for keep in (lambda c: c < F.col(col), lambda c: c <= F.col(col)))
        part = F.lpad((before + upto).cast("string"), PATH_DIGITS, "0")
        out = cut(out.withColumn("path", F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", part))).drop("_path", "_cuts"))
        depth += 1


def tree_prefix_sums(totals: DataFrame, keys: list[str], values: list[str], descending: bool = False) -> DataFrame:
    """(keys, path, values): for every range the sums of the ranges before it (after it, if descending).

    Going up, the totals of a node are those of its parts; going down, a node starts where its parent starts plus what
    its earlier siblings hold. A window sees the parts of one node only.
    """
    deepest = totals.agg(F.max(F.length("path")).alias("d")).first()["d"] or 0
    out = totals.select(*keys, "path", *[F.lit(0).cast("bigint").alias(v) for v in values])
    for length in range(PATH_DIGITS, deepest + 1, PATH_DIGITS):
        node, parent = F.substring("path", 1, length), F.substring("path", 1, length - PATH_DIGITS)
        nodes = totals.filter(F.length("path") >= length).groupBy(*keys, node.alias("node"), parent.alias("parent")).agg(
            *[F.sum(v).alias(v) for v in values])
        order = F.desc("node") if descending else F.asc("node")
        earlier = Window.partitionBy(*keys, "parent").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        starts = nodes.select(*[F.col(k).alias(f"_{k}") for k in keys], "node",
                              *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        joined = out.join(starts, [*same, node == F.col("node")], "left")
        out = joined.select(*keys, "path", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
    return out
