"""Registry that pairs every Spark query with the SQL it is checked against."""

from importlib import import_module

from erashift.catalog.registry import ORACLES, QUERIES

for _part in (
    "ingest", "round1", "eda", "graphs", "contract_queries", "evaluation_queries", "modelling", "streams",
):
    import_module(f"erashift.catalog.{_part}")

__all__ = ["ORACLES", "QUERIES"]
