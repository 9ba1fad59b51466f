"""Statistics over whole columns: frequencies, histograms, correlations, extremes, summaries."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsense.errors import QueryIssue
from gridsense.functions import coerce
from gridsense.functions.names import field
from gridsense.plans.classes import ColumnClass

MISSING_LABEL = "null"
DEFAULT_BINS = 10


def as_label(column: Column, cls: ColumnClass) -> Column:
    """A cell as text, missing ones as ``null``."""
    if coerce.is_float(cls.dtype):
        text = F.when(~F.isnan(column), coerce.plain_number(column.cast("double")))
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit(MISSING_LABEL))


def value_counts(
    df: DataFrame, columns: list[str], classes: dict[str, ColumnClass], top_k: int | None = None
) -> DataFrame:
    """Rows ``column, value, count``, most frequent first, optionally the first k per column.

    All columns are counted in one pass; hot values collapse before the shuffle.
    """
    cells = F.explode(
        F.array(
            *(
                F.struct(F.lit(c).alias("column"), as_label(field(c), classes[c]).alias("value"))
                for c in columns
            )
        )
    )
    counts = (
        df.select(cells.alias("cell"))
        .groupBy(F.col("cell.column").alias("column"), F.col("cell.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    order = [F.desc("count"), F.asc("value")]
    if top_k is None:
        return counts
    if len(columns) == 1:
        return counts.orderBy(*order).limit(top_k)
    place = F.row_number().over(Window.partitionBy("column").orderBy(*order))
    return counts.withColumn("__place", place).where(F.col("__place") <= top_k).drop("__place")


def histogram(df: DataFrame, column: str, cls: ColumnClass, bins: object = DEFAULT_BINS) -> DataFrame:
    """Equal-width bins, open on the left and closed on the right; the minimum is in bin 1.

    Rows ``column, bin, bin_lo, bin_hi, count``; empty bins are present with count 0. Edges come from the finite values;
    infinities, where there are any, are counted in bins of their own before the first and after the last.
    """
    try:
        bins = max(int(bins), 1)
    except (TypeError, ValueError):
        bins = DEFAULT_BINS
    values = df.select(cls.number(field(column)).cast("double").alias("x")).where(F.col("x").isNotNull())
    low, high = F.col("ends.low"), F.col("ends.high")
    flat_pad = F.when(low == high, F.greatest(F.abs(low) * 0.001, F.lit(0.001))).otherwise(F.lit(0.0))
    finite = F.abs("x") < float("inf")
    ends = values.agg(F.min(F.when(finite, F.col("x"))).alias("low"), F.max(F.when(finite, F.col("x"))).alias("high")).select(
        F.struct("low", "high").alias("ends")
    )
    ends = ends.select(F.struct((low - flat_pad).alias("low"), (high + flat_pad).alias("high")).alias("ends"))

    def beyond(edge: Column) -> Column:
        return F.when(F.col("bin") == 0, float("-inf")).when(F.col("bin") == bins + 1, float("inf")).otherwise(edge)

    width = (high - low) / bins
    guess = F.least(F.greatest(F.ceil((F.col("x") - low) / width), F.lit(1)), F.lit(bins))
    lower_edge, upper_edge = low + (F.col("guess") - 1) * width, low + F.col("guess") * width
    settled = (
        F.when((F.col("guess") > 1) & (F.col("x") <= lower_edge), F.col("guess") - 1)
        .when((F.col("guess") < bins) & (F.col("x") > upper_edge), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    filled = (
        values.withColumn("ends", ends.scalar())
        .withColumn("guess", guess)
        .groupBy(F.when(finite, settled).when(F.col("x") > 0, bins + 1).otherwise(0).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = (
        df.sparkSession.range(0, bins + 2)
        .select(F.col("id").cast("int").alias("bin"), ends.scalar().alias("ends"))
        .select(
            F.lit(column).alias("column"),
            "bin",
            beyond(low + (F.col("bin") - 1) * width).alias("bin_lo"),
            beyond(F.when(F.col("bin") == bins, high).otherwise(low + F.col("bin") * width)).alias("bin_hi"),
        )
    )
    within = F.col("bin").between(1, bins) & F.col("bin_lo").isNotNull()
    return (
        every.join(filled, "bin", "left")
        .where(within | F.col("n").isNotNull())
        .select("column", "bin", "bin_lo", "bin_hi", F.coalesce("n", F.lit(0)).alias("count"))
    )


def correlations(df: DataFrame, columns: list[str], classes: dict[str, ColumnClass]) -> DataFrame:
    """Rows ``col_x, col_y, corr`` for every ordered pair: Pearson over complete pairs.

    A constant column has no correlation (null).
    """
    if len(columns) < 2:
        raise QueryIssue("Correlation needs at least two numeric columns.")
    number = {c: classes[c].number(field(c)).cast("double") for c in columns}
    pairs = list(combinations_with_replacement(columns, 2))
    measured = []
    for at, (a, b) in enumerate(pairs):
        x, y = number[a], number[b]
        if a == b:
            measured.append(F.when(F.stddev_pop(x) > 0, F.lit(1.0)).alias(f"r{at}"))
            continue
        spread = F.stddev_pop(F.when(y.isNotNull(), x)) * F.stddev_pop(F.when(x.isNotNull(), y))
        measured.append(F.try_divide(F.covar_pop(x, y), spread).alias(f"r{at}"))
    cells = []
    for at, (a, b) in enumerate(pairs):
        for left, right in dict.fromkeys([(a, b), (b, a)]):
            cells.append(F.struct(F.lit(left).alias("col_x"), F.lit(right).alias("col_y"), F.col(f"r{at}").alias("corr")))
    return df.agg(*measured).select(F.inline(F.array(*cells)))


def extremes(df: DataFrame, metric: str, cls: ColumnClass, largest: bool) -> DataFrame:
    """The rows that hold a column's maximum (or minimum), within a relative 1e-9."""
    value = cls.number(field(metric)).cast("double")
    peak = df.agg((F.max if largest else F.min)(value).alias("peak")).scalar()
    tolerance = F.greatest(F.lit(1e-9), F.abs(peak) * 1e-9)
    return df.where(F.abs(value - peak) <= tolerance)


def distinct_counts(df: DataFrame, columns: dict[str, Column]) -> list[Column]:
    """Exact distinct counts under the given names, each a scalar subquery over its column alone.

    In one aggregate, several distinct counts would copy every row once per column; in a
    columnar table, reading the columns one by one reads no more than reading them together.
    """
    return [df.agg(F.count_distinct(column)).scalar().alias(name) for name, column in columns.items()]


def describe(df: DataFrame, columns: list[str], approximate: bool = False) -> DataFrame:
    """One row per column: counts, distinct values and the range of numbers, or else of dates.

    Text is read as both; what it turns out to hold decides in the result, so no earlier look
    is needed. Everything but the exact distinct counts is one pass (see ``distinct_counts``).
    """
    columns = columns or df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    measured, present, cells = [F.count(F.lit(1)).alias("rows")], {}, []
    for at, name in enumerate(columns):
        column, dtype = field(name), types[name]
        present[f"u{at}"] = F.when(~F.isnan(column), column) if coerce.is_float(dtype) else column
        number = coerce.as_number(column, dtype)
        time = column if coerce.is_time(dtype) else coerce.time_from_text(column) if coerce.is_text(dtype) else None
        day = (F.lit(None) if time is None else time).cast("date")
        measured += [
            F.min(number).alias(f"lo{at}"),
            F.max(number).alias(f"hi{at}"),
            F.avg(number).alias(f"av{at}"),
            F.min(day).alias(f"from{at}"),
            F.max(day).alias(f"to{at}"),
        ]
        cells.append(_described(name, dtype, at))
    if approximate:
        measured += [F.approx_count_distinct(column).alias(name) for name, column in present.items()]
        measures = df.agg(*measured)
    else:
        measures = df.agg(*measured).select("*", *distinct_counts(df, present))
    return measures.select(F.inline(F.array(*cells)))


def _described(name: str, dtype: T.DataType, at: int) -> Column:
    low, high, average, first, last = (F.col(f"{kind}{at}") for kind in ("lo", "hi", "av", "from", "to"))
    whole = coerce.is_number(dtype) and not coerce.is_float(dtype)

    def shown(value: Column, as_whole: bool) -> Column:
        return value.cast("string") if as_whole else coerce.plain_number(F.round(value.cast("double"), 2))

    def day(value: Column) -> Column:
        return F.when(low.isNull(), value)

    parts = [
        F.concat(F.lit("Count: "), F.col("rows")),
        F.concat(F.lit("Unique: "), F.col(f"u{at}")),
        F.concat(F.lit("Min: "), shown(low, whole)),
        F.concat(F.lit("Max: "), shown(high, whole)),
        F.concat(F.lit("Avg: "), shown(average, False)),
        F.concat(F.lit("Min Date: "), day(first).cast("string")),
        F.concat(F.lit("Max Date: "), day(last).cast("string")),
    ]
    return F.struct(
        F.lit(name).alias("column"),
        F.col("rows").alias("rows"),
        F.col(f"u{at}").alias("unique"),
        F.round(low.cast("double"), 2).alias("min"),
        F.round(high.cast("double"), 2).alias("max"),
        F.round(average.cast("double"), 2).alias("avg"),
        day(first).alias("min_date"),
        day(last).alias("max_date"),
        F.concat_ws(" | ", *parts).alias("stats"),
    )
