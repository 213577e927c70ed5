"""Every query over the driver's tables, and its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


from . import check_queries, dynamics_queries, metrics_queries, report_queries, result_queries, rollup_queries, run_queries, stats_queries, store_queries, text_queries  # noqa: E402, F401
