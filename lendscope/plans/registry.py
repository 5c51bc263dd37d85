"""Query registry: key -> Spark callable (spark, sf_dir) -> DataFrame, plus its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lendscope.plans import oracle

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
# Keys whose result is a fit's own numbers, which SQL cannot state: tests recompute them.
ROWS_ONLY: set[str] = set()


def query(key: str, sql: str | None = None, ctes: tuple[str, ...] = ()) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` (DuckDB) is its oracle, omitted for fitted-model queries."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            oracle.register(key, sql, *ctes)
        else:
            ROWS_ONLY.add(key)
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their decorators run."""
    from lendscope.plans import (  # noqa: F401
        scoring_queries,
        segment_queries,
        product_queries,
        profile_queries,
        feature_queries,
        metric_queries,
        model_queries,
        explain_queries,
        segment_model_queries,
        source_queries,
    )
