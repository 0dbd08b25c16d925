"""All registered queries of the library proper, with the SQL that states each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvella.plans import q_aggregates, q_evidence, q_forms, q_graph, q_indices, q_merging, q_networks, q_scalars, q_sources, q_topics, q_trends, q_windows

Query = Callable[[SparkSession, str], DataFrame]
MODULES: list = [q_indices, q_aggregates, q_networks, q_evidence, q_scalars, q_merging, q_windows, q_graph, q_trends, q_sources, q_topics, q_forms]


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLES.items()}
