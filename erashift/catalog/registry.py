"""Query registry: key -> (Spark callable, SQL text to check it against)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from erashift import session
from erashift.catalog.fixtures import SQL_VIEWS, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_NAME = re.compile(r"\b(?:fx|ox)_\w+")


def with_views(sql: str) -> str:
    """Prefix a statement with the views it mentions, dependencies first."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in _NAME.findall(text):
            if name in SQL_VIEWS and name not in ordered:
                need(SQL_VIEWS[name])
                ordered.append(name)

    need(sql)
    if not ordered:
        return sql
    views = ",\n".join(f"{n} as ({SQL_VIEWS[n].strip()})" for n in ordered)
    own = re.match(r"\s*with( recursive)?\s", sql)
    if own:  # the statement brings its own views: ours go in front of them
        return f"with{own.group(1) or ''} {views},\n{sql[own.end():].strip()}"
    return f"with {views}\n{sql.strip()}"


def query(key: str, sql: str | None = None):
    """Register fn(tables) -> DataFrame under key."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.configure(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = key
        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return fn

    return wrap


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Round the given (default: all double) columns; float sums differ in their
    last digits between engines."""
    names = cols or [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})
