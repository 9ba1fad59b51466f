"""Shared helpers of the workload."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense import run


@dataclass(frozen=True)
class Case:
    query: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ask(name: str, request: dict, prepare: Callable[[DataFrame], DataFrame] | None = None, **rounded: int):
    """A query that runs a request over a table; ``rounded`` gives digits for float columns."""

    def query(spark: SparkSession, folder: str) -> DataFrame:
        df = table(spark, folder, name)
        answer = run(prepare(df) if prepare else df, request).df
        return answer.select(
            *(F.round(F.col(f"`{c}`"), rounded[c]).alias(c) if c in rounded else F.col(f"`{c}`") for c in answer.columns)
        )

    return query


def where(column: str, operator: str, value: object) -> dict:
    return {"column": column, "operator": operator, "value": value}


def derive(**columns: str) -> Callable[[DataFrame], DataFrame]:
    """Add columns by SQL expression."""
    return lambda df: df.select("*", *(F.expr(text).alias(name) for name, text in columns.items()))
