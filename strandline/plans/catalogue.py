"""All queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.plans import benchmark_queries, dataset_queries, feature_queries, graph_queries, ingest_queries, lookup_queries, multihop_queries, prepare_queries, registry, route_queries, search_queries, session_queries, source_queries, store_queries, vector_queries  # noqa: F401  importing a module registers its queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return registry.ORACLES
