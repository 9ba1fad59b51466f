"""Cleaning steps after a file has been read."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsense.functions import coerce
from gridsense.functions.names import field
from gridsense.sources.storage import checkpointed

FILLER = "N/A"


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """Rows without any value go."""
    return df.dropna(how="all")


def clean_names(names: list[str]) -> list[str]:
    """Outer blanks, then punctuation, go; names that become equal are numbered from 2."""
    cleaned: list[str] = []
    for name in names:
        base = re.sub(r"[^\w\s]", "", name.strip())
        taken = {c.lower() for c in cleaned}
        candidate, n = base, 2
        while candidate.lower() in taken:
            candidate, n = f"{base}_{n}", n + 1
        cleaned.append(candidate)
    return cleaned


def clean_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def fill_missing(df: DataFrame, every_column: bool = False) -> DataFrame:
    """``N/A`` in empty text cells; with ``every_column`` all columns become text first."""
    if every_column:
        df = df.select(*(field(c).cast("string").alias(c) for c in df.columns))
    text = [f.name for f in df.schema.fields if coerce.is_text(f.dataType)]
    return df.select(
        *(F.coalesce(field(c), F.lit(FILLER)).alias(c) if c in text else field(c) for c in df.columns)
    )


def clean(df: DataFrame, fill: bool = False) -> DataFrame:
    """The usual sequence: empty rows, headers, and optionally the filler for missing text."""
    df = clean_headers(drop_empty_rows(df))
    return fill_missing(df) if fill else df


def _family(dtype: T.DataType) -> str:
    kinds = {"number": coerce.is_number, "time": coerce.is_time, "text": coerce.is_text}
    return next((kind for kind, test in kinds.items() if test(dtype)), dtype.simpleString())


def united(tables: list[DataFrame]) -> DataFrame:
    """The rows of all tables under the columns of all, missing ones null.

    Numbers of different width become the wider type, days and moments become moments. A column that holds different kinds, such as
    text here and numbers there, is text throughout, so that no cell is lost.
    """
    families: dict[str, set[str]] = {}
    for df in tables:
        for column in df.schema.fields:
            families.setdefault(column.name.lower(), set()).add(_family(column.dataType))

    def cell(column: T.StructField) -> Column:
        if len(families[column.name.lower()]) == 1 or coerce.is_text(column.dataType):
            return field(column.name)
        is_float = coerce.is_float(column.dataType)
        text = coerce.plain_number(field(column.name).cast("double")) if is_float else field(column.name).cast("string")
        return text.alias(column.name)

    alike = [df.select(*map(cell, df.schema.fields)) for df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), alike)


def number_rows(df: DataFrame, name: str = "id") -> DataFrame:
    """Dense row numbers 0..n-1 in file order, as text.

    Rows read from files are numbered by path and position, whatever the partitioning: each split's rows are counted, and the sums in
    path order shift the numbers within splits. Nothing is written, and what is broadcast is one row a split. Other rows are numbered
    in the order of partitions; they are checkpointed first, so that counting and shifting see the same rows.
    """
    spot, file, block = F.monotonically_increasing_id(), "_metadata.file_path", "_metadata.file_block_start"
    try:
        placed = df.select("*", F.col(file).alias("__file"), F.col(block).alias("__block"), spot.alias("__spot"))
    except AnalysisException:
        return _number_by_partition(df, name)
    splits = placed.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__spot").alias("__first"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block")) - F.col("__n")
    starts = splits.select("__file", "__block", (before - F.col("__first")).alias("__shift"))
    numbered = placed.join(F.broadcast(starts), ["__file", "__block"])
    return numbered.select(*map(field, df.columns), (F.col("__shift") + F.col("__spot")).cast("string").alias(name))


def _number_by_partition(df: DataFrame, name: str) -> DataFrame:
    tagged = checkpointed(df.withColumn("__spot", F.monotonically_increasing_id()))
    part = F.shiftright("__spot", 33)
    counts = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")
    starts = counts.select("__part", before.alias("__start"))
    inside = F.col("__spot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("__part", part)
        .join(F.broadcast(starts), "__part")
        .select(*map(field, df.columns), (F.col("__start") + inside).cast("string").alias(name))
    )


def flat_rows(df: DataFrame, sheet: str | None = None, dense: bool = True) -> DataFrame:
    """``sheet`` first if named, and a text ``id``: the table's own id, else a row number 0..n-1 in file order (``number_rows``).

    Without ``dense`` numbers are only increasing, and change with the partitioning; that saves counting the rows of each split.
    """
    own = next((c for c in df.columns if c.strip().lower() == "id"), None)
    if own is not None:
        flat = df.select(*(field(c).cast("string").alias("id") if c == own else field(c) for c in df.columns))
    elif dense:
        flat = number_rows(df)
    else:
        flat = df.select(*map(field, df.columns), F.monotonically_increasing_id().cast("string").alias("id"))
    if sheet is None or "sheet" in map(str.lower, df.columns):
        return flat
    return flat.select(F.lit(sheet).alias("sheet"), *map(field, flat.columns))
