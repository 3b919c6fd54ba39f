"""Edge tables. An edge source -> target means: source follows (or answers) target."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.functions.ids import edge_id
from erashift.operators.cleaning import known_ids, mark_known

EDGE_COLS = ["dataset", "source_id", "target_id", "relation"]
# Relations in order of preference: which one is kept when a pair has several.
RELATIONS = ["friend", "follower", "following", "followers", "followed", "follows", "reply"]
PAIR = ["dataset", "source_id", "target_id"]


def _dedupe(edges: DataFrame, relations: list[str] | None) -> DataFrame:
    """One row per directed pair, with its most preferred relation.

    With the possible relations named, the preference is a number and the
    grouping a hash aggregation; any other text then is an error. Without,
    unknown relations follow the known ones in name order.
    """
    if relations is not None and len(relations) == 1:
        return edges.select(*PAIR).distinct().withColumn("relation", F.lit(relations[0]))
    names = F.array(*[F.lit(r) for r in relations or RELATIONS])
    place = F.array_position(names, F.col("relation"))
    if relations is not None:
        kept = edges.groupBy(*PAIR).agg(F.min(place).alias("place"))
        return kept.select(*PAIR, F.element_at(names, F.col("place").cast("int")).alias("relation"))
    known_first = F.struct(F.when(place > 0, place).otherwise(len(RELATIONS) + 1), "relation")
    return edges.groupBy(*PAIR).agg(F.min_by("relation", known_first).alias("relation"))


def edges_clean(
    edges: DataFrame, dataset: str | None = None, relations: list[str] | None = None, dedupe: bool = True,
) -> DataFrame:
    """Normalised ids, no missing ends, no self-loops, one row per directed pair.

    dedupe=False leaves the last step to edges_combine(), which then shuffles
    the edges once instead of twice.
    """
    missing = {"source_id", "target_id"} - set(edges.columns)
    if missing:
        raise ValueError(f"missing edge columns: {sorted(missing)}")
    if dataset is not None:
        edges = edges.withColumn("dataset", F.lit(dataset))
    elif "dataset" not in edges.columns:
        raise ValueError("edges need a dataset column or a dataset name")
    if "relation" not in edges.columns:
        edges, relations = edges.withColumn("relation", F.lit("follows")), ["follows"]
    tidy = edges.select(
        "dataset", edge_id(F.col("source_id")).alias("source_id"),
        edge_id(F.col("target_id")).alias("target_id"), "relation",
    ).filter("source_id <> target_id")  # NULL for a missing end, which drops it too
    return _dedupe(tidy, relations) if dedupe else tidy


def edges_from_neighbors(records: DataFrame, dataset: str | None = None, dedupe: bool = True) -> DataFrame:
    """Nested neighbour lists to edges: follower f -> user, user -> following g."""
    user = F.col("ID").cast("string")
    meta = [] if dataset is not None else ["dataset"]

    def listed(name: str, relation: str):
        """One struct per list entry; a NULL list adds nothing."""
        other, me = (lambda x: x), (lambda x: user)
        source, target = (other, me) if relation == "follower" else (me, other)
        return F.coalesce(
            F.transform(f"neighbor.{name}", lambda x: F.struct(
                source(x).alias("source_id"), target(x).alias("target_id"), F.lit(relation).alias("relation"))),
            F.array().cast("array<struct<source_id:string,target_id:string,relation:string>>"))

    both = F.concat(listed("follower", "follower"), listed("following", "following"))
    rows = records.select(*meta, F.explode(both).alias("e")).select(*meta, "e.*")
    return edges_clean(rows, dataset, ["follower", "following"], dedupe)


def edges_either_known(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Follow edges with at least one known end, before cleaning."""
    follow = edges.filter(F.col("relation").isin(fv.FOLLOW_RELATIONS))
    ids = known_ids(users)
    marked = mark_known(mark_known(follow, ids, "source_id", "_s"), ids, "target_id", "_t")
    return marked.filter("_s or _t").drop("_s", "_t").select(*edges.columns)


def edges_filtered_scan(edges: DataFrame, users: DataFrame, dataset: str, dedupe: bool = True) -> DataFrame:
    return edges_clean(edges_either_known(edges, users), dataset, fv.FOLLOW_RELATIONS, dedupe)


def edges_both_labelled(edges: DataFrame, users: DataFrame) -> DataFrame:
    """Edges whose two ends are known."""
    ids = known_ids(users)
    marked = mark_known(mark_known(edges, ids, "source_id", "_s"), ids, "target_id", "_t")
    return marked.filter("_s and _t").drop("_s", "_t").select(*edges.columns)


def edges_reply(tweets: DataFrame, dataset: str | None = None, dedupe: bool = True) -> DataFrame:
    """Who answered whom. The target need not be a known account."""
    target = F.col("in_reply_to_user_id").cast("string")
    meta = [] if dataset is not None else ["dataset"]
    rows = tweets.filter(~F.trim(target).isin(fv.NO_REPLY_EDGE_TOKENS)).select(
        *meta, F.col("user_id").cast("string").alias("source_id"), target.alias("target_id"),
        F.lit("reply").alias("relation"),
    )
    return edges_clean(rows, dataset, ["reply"], dedupe)


def edges_combine(
    follow: DataFrame | None, reply: DataFrame | None, relations: list[str] | None = None,
) -> DataFrame:
    """Both edge sets, one row per directed pair, follow before reply.

    Any relation is taken; relations promises that no others occur, which makes the
    grouping cheaper. Without either set the result is an empty table.
    """
    frames = [f for f in (follow, reply) if f is not None]
    if not frames:
        schema = ", ".join(f"{c} string" for c in EDGE_COLS)
        return SparkSession.getActiveSession().createDataFrame([], schema)
    out = frames[0].select(*EDGE_COLS)
    for f in frames[1:]:
        out = out.unionByName(f.select(*EDGE_COLS))
    return _dedupe(out, relations).select(*EDGE_COLS)


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges per relation and distinct ends: rows (item, n)."""
    relations = edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
    ends = [
        edges.select(end).distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(end).alias("item"), "n")
        for end in ("source_id", "target_id")
    ]
    return (
        relations.select(F.concat(F.lit("relation "), "relation").alias("item"), "n")
        .unionByName(ends[0]).unionByName(ends[1])
    )
