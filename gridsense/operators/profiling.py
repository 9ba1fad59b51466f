"""Profiles of tables and workbooks: what is in them, in a few rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsense.functions import coerce
from gridsense.functions.names import field

# Thresholds for text tables and text columns.
TEXT_HEAVY_AVERAGE = 100
TEXT_COLUMN_AVERAGE = 80
LONG_CELL = 60
LONG_SHARE = 0.3
SAMPLES = 5


def _text_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if coerce.is_text(f.dataType)]


def text_shape(df: DataFrame) -> DataFrame:
    """One row per text column: ``column, avg_length, long_share, is_text, is_heavy``.

    One pass over the whole table.
    """
    measured, cells = [], []
    for at, name in enumerate(_text_names(df)):
        length = F.length(field(name))
        measured += [
            F.avg(length).alias(f"a{at}"),
            F.avg((length > LONG_CELL).cast("double")).alias(f"s{at}"),
        ]
        average, share = F.col(f"a{at}"), F.col(f"s{at}")
        is_text = (average >= TEXT_COLUMN_AVERAGE) | (share >= LONG_SHARE)
        cells.append(
            F.struct(
                F.lit(name).alias("column"),
                average.alias("avg_length"),
                share.alias("long_share"),
                F.coalesce(is_text, F.lit(False)).alias("is_text"),
                F.coalesce(average > TEXT_HEAVY_AVERAGE, F.lit(False)).alias("is_heavy"),
            )
        )
    if not cells:
        empty = "column string, avg_length double, long_share double, is_text boolean, is_heavy boolean"
        return df.sparkSession.createDataFrame([], empty)
    return df.agg(*measured).select(F.inline(F.array(*cells)))


def text_columns(df: DataFrame) -> list[str]:
    """The names of the text columns that hold prose (runs a job)."""
    prose = {row["column"] for row in text_shape(df).where("is_text").collect()}
    return [c for c in df.columns if c in prose]


def is_text_heavy(df: DataFrame) -> bool:
    """Whether some text column is long on average (runs a job)."""
    return not text_shape(df).where("is_heavy").isEmpty()


def _described(df: DataFrame) -> DataFrame:
    measured, cells = [F.count(F.lit(1)).alias("rows")], []
    for at, f in enumerate(df.schema.fields):
        column = field(f.name)
        floating, numeric = coerce.is_float(f.dataType), coerce.is_number(f.dataType)
        absent = column.isNull() | F.isnan(column) if floating else column.isNull()
        measured.append(F.count_if(absent).alias(f"m{at}"))
        low = high = F.lit(None).cast("double")
        if numeric:
            number = coerce.as_number(column, f.dataType)
            measured += [F.min(number).cast("double").alias(f"l{at}"), F.max(number).cast("double").alias(f"h{at}")]
            low, high = F.col(f"l{at}"), F.col(f"h{at}")
        cells.append(
            F.struct(
                F.lit(at).alias("position"),
                F.lit(f.name).alias("column"),
                F.lit(f.dataType.simpleString()).alias("type"),
                F.col("rows").alias("rows"),
                F.col(f"m{at}").alias("missing"),
                low.alias("min"),
                high.alias("max"),
            )
        )
    return df.agg(*measured).select(F.inline(F.array(*cells)))


def _least_of_batches(names: list[str], count: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {name: pa.array([], pa.string()) for name in names}
        for batch in batches:
            for at, name in enumerate(names):
                fresh = batch.column(at).cast(pa.string()).drop_null()
                if len(kept[name]) == count:
                    fresh = fresh.filter(pc.less(fresh, kept[name][-1]))
                merged = pc.unique(pa.concat_arrays([kept[name], pc.unique(fresh)]))
                kept[name] = merged.take(pc.array_sort_indices(merged)[:count])
        columns = [name for name in names for _ in range(len(kept[name]))]
        values = [value for name in names for value in kept[name].to_pylist()]
        yield pa.RecordBatch.from_pydict({"column": pa.array(columns, pa.string()), "value": pa.array(values, pa.string())})

    return least


def smallest_values(df: DataFrame, names: list[str], count: int = SAMPLES) -> DataFrame:
    """``column, samples``: the smallest distinct values of each column, in order.

    One pass. Each task keeps only ``count`` values per column, so that is all that is
    shuffled. (A distinct would shuffle whole text columns, and a grouped minimum of text
    would sort them.)
    """
    texts = df.select(*(field(c).cast("string").alias(c) for c in names))
    least = texts.mapInArrow(_least_of_batches(names, count), "column string, value string").distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    return (
        least.withColumn("place", place)
        .where(F.col("place") <= count)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("samples"))
    )


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: ``position, column, type, rows, missing, min, max, samples``."""
    described = _described(df)
    other = [f.name for f in df.schema.fields if not coerce.is_number(f.dataType) and _has_text_form(f.dataType)]
    if not other:
        return described.withColumn("samples", F.lit(None).cast("array<string>"))
    sampled = smallest_values(df, other)
    joined = described.join(sampled, "column", "left")
    samples = F.when(F.col("column").isin(other), F.coalesce("samples", F.array().cast("array<string>")))
    return joined.select(*described.columns, samples.alias("samples"))


def _has_text_form(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.BinaryType))


def _line() -> Column:
    bounds = F.concat(
        F.lit("Range ["), coerce.plain_number(F.col("min")), F.lit(" to "), coerce.plain_number(F.col("max")), F.lit("]")
    )
    samples = F.concat(F.lit("Samples: "), F.array_join("samples", ", "))
    shown = F.coalesce(bounds, samples, F.lit("Range [N/A to N/A]"))
    return F.concat(F.lit("- "), F.col("column"), F.lit(" ("), F.col("type"), F.lit("): "), shown)


def profile_text(df: DataFrame, sheet: str | None = None) -> DataFrame:
    """The profile as one text (column ``profile``): a heading and a line per column."""
    where = f" (Sheet: {sheet})" if sheet else ""
    lines = F.array_sort(F.collect_list(F.struct("position", _line().alias("line"))))
    heading = F.concat(F.lit(f"Dataset{where}: "), F.max("rows"), F.lit(f" rows, {len(df.columns)} cols"))
    body = F.array_join(lines.getField("line"), "\n")
    return column_profile(df).agg(F.concat(heading, F.lit("\n"), body).alias("profile"))


def sample_rows(df: DataFrame, key: str, count: int = SAMPLES) -> DataFrame:
    """The first rows by a key."""
    return df.orderBy(field(key).asc_nulls_last()).limit(count)


def catalog_profile(sheets: Mapping[str, DataFrame]) -> DataFrame:
    """One row per sheet with its size and columns, and the workbook's totals beside."""
    names = list(dict.fromkeys(sheets))
    union = {c.strip().lower(): c.strip() for name in reversed(names) for c in reversed(sheets[name].columns)}
    ordered = list(dict.fromkeys(c.strip().lower() for name in names for c in sheets[name].columns))
    parts = [
        sheets[name].agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(at).alias("position"),
            F.lit(name).alias("sheet"),
            "rows",
            F.lit(len(sheets[name].columns)).alias("cols"),
            F.lit(",".join(sheets[name].columns)).alias("columns"),
        )
        for at, name in enumerate(names)
    ]
    everything = Window.partitionBy(F.lit(1))
    return reduce(DataFrame.unionByName, parts).select(
        "*",
        F.sum("rows").over(everything).alias("total_rows"),
        F.max("cols").over(everything).alias("max_cols"),
        F.lit(",".join(union[c] for c in ordered)).alias("union_columns"),
    )


def catalog_text(data: DataFrame | Mapping[str, DataFrame]) -> DataFrame:
    """The catalog as one text (column ``profile``), for a table or a workbook."""
    if isinstance(data, DataFrame):
        size = F.concat(F.lit("Rows: "), F.count(F.lit(1)), F.lit(f", Columns: {len(data.columns)}"))
        return data.agg(F.concat(size, F.lit("\nColumns: " + ",".join(data.columns))).alias("profile"))
    line = F.format_string("%s: rows = %d, cols=%d, columns=[%s]", "sheet", "rows", "cols", "columns")
    lines = F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).getField("line")
    heading = F.format_string(
        f"Workbook with {len(data)} sheets\nTotal rows: %d, Max columns :%d\nSheets:",
        F.max("total_rows"), F.max("max_cols"),
    )
    tail = F.concat(F.lit("Columns (union): "), F.max("union_columns"))
    return catalog_profile(data).agg(F.concat_ws("\n", heading, F.array_join(lines, "\n"), tail).alias("profile"))
