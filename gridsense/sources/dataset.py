"""A loaded file or workbook, and what can be asked of it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.operators import chunking, cleaning, profiling, text_search
from gridsense.plans.query import Result, run
from gridsense.sources import csv, sheets, storage


@dataclass(frozen=True)
class Dataset:
    """One table, or a named set of tables (a workbook)."""

    name: str
    data: DataFrame | Mapping[str, DataFrame]

    @property
    def table(self) -> DataFrame:
        """Everything as one flat table, with ``id`` and, for a workbook, ``sheet``."""
        return cleaning.flat_rows(self.data) if isinstance(self.data, DataFrame) else sheets.flatten(self.data)

    def run(self, request: Mapping[str, Any], per_sheet: bool = False) -> Result:
        """Answer a request over the flat table, or over each sheet on its own."""
        return run(self.data if per_sheet or isinstance(self.data, DataFrame) else self.table, request)

    def search(self, request: Mapping[str, Any]) -> DataFrame:
        return text_search.search(self.data, request)

    def register(self) -> None:
        """Make the table, or each sheet as ``name_sheet``, known to SQL."""
        for view, df in self._views().items():
            storage.register(view, df)

    def _views(self) -> dict[str, DataFrame]:
        if isinstance(self.data, DataFrame):
            return {self.name: self.data}
        return {f"{self.name}_{sheet}": df for sheet, df in self.data.items()}

    def catalog(self) -> DataFrame:
        """One row per sheet: size and columns."""
        tables = {self.name: self.data} if isinstance(self.data, DataFrame) else self.data
        return profiling.catalog_profile(tables)

    def catalog_text(self) -> DataFrame:
        return profiling.catalog_text(self.data)

    def profile_text(self) -> dict[str, DataFrame]:
        """A one-row profile text per sheet; a single table has the key ``""``."""
        if isinstance(self.data, DataFrame):
            return {"": profiling.profile_text(self.data)}
        return {sheet: profiling.profile_text(df, sheet) for sheet, df in self.data.items()}

    def chunks(self) -> dict[str, DataFrame]:
        """Pieces of the prose columns, for each sheet that is text-heavy (runs a small job each)."""
        tables = {"": self.data} if isinstance(self.data, DataFrame) else self.data
        found = {}
        for sheet, df in tables.items():
            if profiling.is_text_heavy(df):
                columns = profiling.text_columns(df)
                found[sheet] = chunking.chunk_text(cleaning.flat_rows(df), columns, "id", sheet or None)
        return found


def load(
    spark: SparkSession, name: str, source: str | Mapping[str, str], fill: bool = False, **options: Any
) -> Dataset:
    """Read and clean a delimited file, or one file per sheet. ``options`` go to ``read_csv``."""

    def read(_: SparkSession, path: str) -> DataFrame:
        return cleaning.clean(csv.read_csv(spark, path, **options), fill)

    if isinstance(source, str):
        return Dataset(name, read(spark, source))
    return Dataset(name, sheets.read_sheets(spark, source, read))


def index_texts(dataset: Dataset) -> DataFrame:
    """``id, text`` to be embedded: labelled pieces of prose, or else the profile of each table."""
    chunks = dataset.chunks()
    if chunks:
        parts = [df.select(F.col("chunk_id").alias("id"), F.col("label").alias("text")) for df in chunks.values()]
    else:
        parts = [
            df.select(F.lit(sheet or dataset.name).alias("id"), F.col("profile").alias("text"))
            for sheet, df in dataset.profile_text().items()
        ]
    return reduce(DataFrame.unionByName, parts)


def registry(datasets: list[Dataset]) -> DataFrame:
    """What is loaded, as a table: one row per dataset and sheet with its size and columns."""
    parts = [
        d.catalog().select(F.lit(d.name).alias("dataset"), "sheet", "rows", "cols", "columns") for d in datasets
    ]
    return reduce(DataFrame.unionByName, parts)
