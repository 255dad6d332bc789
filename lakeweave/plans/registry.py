"""Names of all registered queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.plans import bank, bank_costs, bank_positions, bank_results, bank_statements, catalogue, graph_index, lineage_graph, mechanisms, patterns, questions, temporal_joins

_MODULES = (lineage_graph, graph_index, patterns, bank, bank_costs, bank_positions, bank_results, bank_statements, catalogue, questions, mechanisms, temporal_joins)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
