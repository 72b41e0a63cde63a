"""The registry: a query has a name, the operators that it exercises, a plan and, where SQL can tell, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .views import Tables


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.plan(Tables(spark, folder))


QUERIES: dict[str, Query] = {}


def query(operators: str, sql: str | None = None) -> Callable:
    def register(plan: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[plan.__name__] = Query(plan.__name__, operators, plan, sql)
        return plan

    return register
