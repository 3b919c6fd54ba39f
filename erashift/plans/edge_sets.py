"""From a release's raw edges and tweets to its combined edge set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from erashift.operators.edges import RELATIONS, edges_clean, edges_combine, edges_filtered_scan, edges_from_neighbors, edges_reply
from erashift.sources import readers


def edges_for_dataset(
    spark: SparkSession, dataset: str, raw_graph: str | None = None,
    users: DataFrame | None = None, tweets: DataFrame | None = None,
) -> DataFrame:
    """Follow edges of the era (if it has any) and reply edges (if tweets are given)."""
    if dataset == "cresci_2015":
        follow = edges_clean(readers.read_edge_dirs(spark, raw_graph), dataset, dedupe=False)
    elif dataset == "cresci_2017":
        follow = None  # this release has no follow graph
    elif dataset == "twibot_2020":
        follow = edges_from_neighbors(readers.read_nested_records(spark, raw_graph), dataset, dedupe=False)
    elif dataset == "twibot_2022":
        follow = edges_filtered_scan(readers.read_edge_csv(spark, raw_graph), users, dataset, dedupe=False)
    else:
        raise ValueError(f"unknown dataset name: {dataset}")
    reply = edges_reply(tweets, dataset, dedupe=False) if tweets is not None else None
    listed = RELATIONS if dataset != "cresci_2015" else None  # there the folders name the relations
    return edges_combine(follow, reply, listed)
