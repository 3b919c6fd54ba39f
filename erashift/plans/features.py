"""The feature frame: Round 1, graph features, embeddings."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from erashift import fixed_values as fv
from erashift.operators import accounts as acc
from erashift.operators.edges import edges_clean
from erashift.operators.embeddings import embedding_merge, node_embeddings
from erashift.operators.graph import (
    graph_degrees, graph_ego_density, graph_merge, graph_neighbor_agg, graph_reciprocity,
)
from erashift.operators.graph_iterative import graph_components, graph_pagerank
from erashift.session import cut

_KEY = ["dataset", "user_id"]


def round1_features(
    users: DataFrame, tweets: DataFrame, reference_date: str | dict[str, str], dataset: str | None = None,
    unavailable: dict[str, list[str]] | None = None, headers: dict[str, list[str]] | None = None,
) -> DataFrame:
    """Account features, tweet aggregates, merge, mask and canonical columns.

    The mask comes last, so tweets_per_day keeps a rate computed from active
    days that are then masked. headers names the tweet columns each era's release
    has; without it they are read off the data (see accounts.era_headers).
    """
    if dataset is not None:
        tweets = tweets.withColumn("dataset", F.lit(dataset))
    if headers is None:
        headers = acc.era_headers(tweets) if "dataset" in tweets.columns else {}
    merged = acc.round1_merge(
        acc.account_features(users, reference_date, dataset), acc.tweet_user_aggregates(tweets, headers=headers or None))
    if unavailable is None:
        unavailable = acc.unavailable_features(headers)
    return acc.canonical_schema(acc.availability_mask(merged, unavailable))


def graph_features(
    edges: DataFrame, dataset: str | None = None, include_pagerank: bool = True, include_ego: bool = True,
) -> DataFrame:
    """The 17 graph columns per node; parts switched off are NULL.

    The looping parts do not depend on each other, so their jobs run side by
    side and fill each other's gaps.
    """
    edges = cut(edges_clean(edges, dataset))
    degrees = cut(graph_degrees(edges))
    parts = [
        lambda: graph_reciprocity(edges),
        lambda: graph_components(edges),
        lambda: graph_neighbor_agg(edges, degrees),
    ]
    if include_pagerank:
        parts.append(lambda: graph_pagerank(edges))
    if include_ego:
        parts.append(lambda: graph_ego_density(edges))
    out = degrees
    with ThreadPoolExecutor(len(parts)) as pool:
        for part in pool.map(lambda build: build(), parts):
            out = out.join(part, _KEY, "left")
    if include_pagerank:
        out = out.fillna(0, subset=["graph_pagerank_sampled"])
    out = out.fillna(0, subset=fv.GRAPH_ZERO_COLS)
    return out.select(*_KEY, *[
        F.col(c) if c in out.columns else F.lit(None).cast("double").alias(c) for c in fv.GRAPH_COLS
    ])


def full_features(round1: DataFrame, edges: DataFrame, no_ego: tuple[str, ...] = ()) -> DataFrame:
    """Round 1, graph columns and the `emb` array for all eras in one frame.

    Ego columns are NULL for the eras in no_ego (none unless asked for).
    """
    graph = graph_features(edges)
    if no_ego:
        ego = [c for c in fv.GRAPH_COLS if c.startswith("graph_ego_")]
        graph = graph.withColumns({c: F.when(~F.col("dataset").isin(*no_ego), F.col(c)) for c in ego})
    return embedding_merge(graph_merge(round1, graph), node_embeddings(edges))
