"""All queries by name, with their SQL equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.plans import context_queries, search_queries, store_queries

_ALL = search_queries.QUERIES | store_queries.QUERIES | context_queries.QUERIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for k, (f, _) in _ALL.items()}
ORACLES: dict[str, str] = {k: s for k, (_, s) in _ALL.items() if s is not None}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.global_search_union(spark, sf_dir)
