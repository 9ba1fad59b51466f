"""Workbooks as named sets of tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from gridsense.operators.cleaning import flat_rows, united
from gridsense.sources.csv import read_csv


def read_sheets(
    spark: SparkSession,
    paths: Mapping[str, str],
    reader: Callable[[SparkSession, str], DataFrame] = read_csv,
) -> dict[str, DataFrame]:
    """One table per sheet name."""
    return {name: reader(spark, path) for name, path in paths.items()}


def flatten(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """All sheets as one table: a ``sheet`` column, an ``id`` text column, missing cells null."""
    return united([flat_rows(df, sheet=name) for name, df in sheets.items()])


def store_sheets(sheets: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write the flat table with a folder for each sheet, so that a filter on ``sheet`` reads only the folders it keeps."""
    flat = flatten(sheets)
    flat.write.mode("overwrite").partitionBy("sheet").parquet(path)
    schema = T.StructType([f for f in flat.schema if f.name != "sheet"] + [flat.schema["sheet"]])
    return flat.sparkSession.read.schema(schema).parquet(path)  # the names of sheets stay text
