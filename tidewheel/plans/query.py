"""Registration of an operator as a query on named relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .relations import T0, for_duckdb, relation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = f"CAST('{T0}' AS TIMESTAMP_NTZ)"
TERMINAL = ("SUCCEEDED", "PARTIAL", "FAILED", "TIMEOUT", "CANCELLED")


def now() -> Column:
    return F.expr(NOW)


def query(name: str, relations: str, sql: str | None = None, **given):
    """Registers ``fn(*relations, **given)`` under a name, with the SQL that DuckDB runs for it."""

    def put(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(*[relation(spark, sf_dir, r) for r in relations.split()], **given)
        if sql:
            ORACLES[name] = for_duckdb(sql.replace("{now}", NOW).replace("{terminal}", str(TERMINAL)))
        return fn

    return put
