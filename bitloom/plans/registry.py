"""Every query of the library's own operators by name, what it covers, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bitloom.sources.shipping import ship


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    covers: str
    sql: str | None


_queries: dict[str, Query] = {}


def query(covers: str, sql: str | None = None):

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        _queries[f.__name__] = Query(run, covers, sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _loaded() -> dict[str, Query]:
    from bitloom.plans import files, frames, graphs, kernels, pixels, searches  # noqa: F401

    return _queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in _loaded().items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in _loaded().items() if q.sql}


def coverage() -> dict[str, str]:
    return {k: q.covers for k, q in _loaded().items()}
