"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeseek.plans import host, incremental, index, search

_MODULES = (host, incremental, index, search)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in _MODULES for k, q in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["hybrid_search_merged"](spark, sf_dir)
