"""Tables and small SQL pieces that registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def js_number_sql(c: str) -> str:
    return f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END"


def rows(**columns: str) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


def union(parts) -> str:
    return " UNION ALL ".join(parts)


class Registry(dict):
    """Queries by name; ``sql`` holds their twins."""

    def __init__(self):
        super().__init__()
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def keep(f):
            self[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
