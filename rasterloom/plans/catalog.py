"""Registry of the raster and region-graph queries with their DuckDB forms.

Rasters are bound to the given tables: ``events`` are 100 x 100 images, integer
keys are colours, 5 x 5 blocks or customers are regions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.plans import colour_queries, iterative_queries, line_queries, region_queries, sheet_queries

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (colour_queries, sheet_queries, region_queries, line_queries, iterative_queries)


def queries() -> dict[str, Query]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
