"""Registry of named queries: Spark job + optional DuckDB oracle SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import oracle

# Fixed parameters of the registered queries (the reference has no clock
# inside queries here: as_of is explicit).
AS_OF = "2001-08-15 00:00:00"
REPORT_FROM = "2000-01-01"
REPORT_TO = "2000-12-31"
HMAC_TEST_KEY = "test-webhook-key"


@dataclass
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doc: str = ""


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, ctes: dict[str, str] | None = None):
    """Register ``fn(spark, tables) -> DataFrame`` under ``name``."""

    def deco(fn):
        from ..session import apply_settings
        from ..sources.tables import Tables

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_settings(spark)
            return fn(Tables(spark, sf_dir))

        run.__name__ = f"q_{name}"
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, oracle(sql, ctes) if sql else None, fn.__doc__ or "")
        return fn

    return deco
