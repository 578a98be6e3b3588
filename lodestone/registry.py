"""Every query of the library's own operators, with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import bench_queries, check_queries, code_queries, evaluation_queries, lab_queries, payload_queries, stream_queries, text_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for _module in (vector_queries, payload_queries, text_queries, code_queries, evaluation_queries, bench_queries, stream_queries, check_queries, lab_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
