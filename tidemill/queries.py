"""The queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans import chat_queries, corpus_queries, data_queries, metric_queries, nested_queries

Query = Callable[[SparkSession, str], DataFrame]

MODULES = (corpus_queries, data_queries, chat_queries, metric_queries, nested_queries)
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
