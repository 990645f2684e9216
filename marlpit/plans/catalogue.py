"""All registered queries of the library, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlpit.plans import drift_queries, feature_queries, further_queries, governance_queries, model_queries, search_queries, upkeep_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (feature_queries, drift_queries, governance_queries, model_queries, further_queries, upkeep_queries, search_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
