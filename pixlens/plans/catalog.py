"""Registry of the named queries the driver runs, with their DuckDB oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the test forum derived
from the given tables. ``sql`` is the oracle statement (views from
``oracle_views`` are prepended on demand); ``None`` marks a rows-only check.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship_package
from .oracle_views import with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn
    return deco


def load_all() -> None:
    """Import every query module (each registers on import)."""
    from . import (  # noqa: F401
        analysis_queries, eligibility_queries, index_queries, lexicon_queries, search_queries, stream_queries,
        vector_text_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return dict(ORACLE)
