"""All queries of the engine by name, with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import file_queries, harness, relational, scalars, sequence_queries  # noqa: F401  they register their queries

FLAGSHIP = "qgram_overlap"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(harness.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(harness.ORACLES)
