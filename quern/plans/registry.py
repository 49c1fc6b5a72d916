"""All registered queries, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.operators.profile import profile
from quern.plans import analytics_queries, cross_queries, other_queries, profile_queries, query_queries, temporal_queries

MODULES = [profile_queries, cross_queries, query_queries, analytics_queries, temporal_queries, other_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
