"""Registered queries over the test tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import data, graph, more  # noqa: F401  the modules register their queries

    return dict(graph.QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import data, graph, more  # noqa: F401

    return dict(graph.ORACLES)
