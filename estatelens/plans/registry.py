"""Registered queries: each key has a Spark plan ``(spark, sf_dir) -> DataFrame``
and, where the operator is expressible in SQL, the DuckDB oracle text.

Every query reads the driver's tables (or data Spark derives from them) in
full; nothing is sampled or capped except where a top-k or sample *is* the
operator.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query '{name}' registered twice")
        REGISTRY[name] = Registered(fn, sql)
        return fn
    return deco


def all_queries() -> dict[str, QueryFn]:
    _load()
    return {k: v.fn for k, v in REGISTRY.items()}


def all_oracles() -> dict[str, str]:
    _load()
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}


def _load() -> None:
    # importing the plan modules fills REGISTRY
    from estatelens.plans import (feature_queries, ingest_queries, queries, rate_queries,  # noqa: F401
                                  report_queries, valuation_queries)
    from estatelens.plans import branch_queries, check_queries, model_queries, tree_queries  # noqa: F401  (after the others)
