"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
driver tables (or tables Spark derives from them), with an equivalent DuckDB SQL
oracle where one exists. Integer outputs are BIGINT on both sides and every
computed column is aliased identically, so results compare column by column.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from pagefold.plans import (crawl_queries, extraction_queries, job_queries,  # noqa: F401
                                metric_queries, network_queries, ratelimit_queries,
                                request_queries, stream_queries, structured_queries)
