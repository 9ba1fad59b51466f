"""Sentences that go with a result, as an extra column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsense.functions import coerce
from gridsense.functions.names import field
from gridsense.operators.aggregates import Measure

# How an aggregate is worded.
WORDS = {
    "avg": "Average", "sum": "Sum", "min": "Minimum", "max": "Maximum", "median": "Median",
    "mode": "Mode", "std": "Standard Deviation", "variance": "Variance", "quantile": "Quantile",
    "distinct_count": "Distinct Count", "null_count": "Null Count", "null_pct": "Null Percentage",
    "count": "Count",
}
COUNTS = ("count", "distinct_count", "null_count")


def _text(column: Column) -> Column:
    return coerce.plain_number(column.cast("double"))


def _scalar_rows(df: DataFrame, measures: list[Measure], filters: str, issues: list[str]) -> DataFrame:
    """One row per measure: ``operation, column, value, _summary``; one more for what failed."""
    cells = []
    for m in measures:
        value = field(m.alias)
        shown = value.cast("string") if m.function in COUNTS else _text(value)
        target = "rows" if m.column is None else m.column
        done = F.concat(F.lit(f"{WORDS[m.function]} of {target}{filters}: "), shown)
        failed = F.lit(f"{WORDS[m.function]} could not be computed for {target}{filters}.")
        cells.append(
            F.struct(
                F.lit(m.function).alias("operation"),
                F.lit(target).alias("column"),
                value.cast("double").alias("value"),
                F.coalesce(done, failed).alias("_summary"),
            )
        )
    if issues:
        cells.append(
            F.struct(
                F.lit(None).cast("string").alias("operation"),
                F.lit(None).cast("string").alias("column"),
                F.lit(None).cast("double").alias("value"),
                F.lit(f"Partial result. Not computed: {' | '.join(issues)}").alias("_summary"),
            )
        )
    kept = [field(c) for c in df.columns if c not in {m.alias for m in measures}]
    return df.select(*kept, F.inline(F.array(*cells)))


def summarise(kind: str, df: DataFrame, measures: list[Measure], filters: str, issues: list[str]) -> DataFrame:
    """Add ``_summary`` to a result of the given kind."""
    if kind == "scalar":
        return _scalar_rows(df, measures, filters, issues)
    if kind in ("max", "min"):
        metric = df.columns[-1]
        sentence = F.concat(F.lit(f"{WORDS[kind]} of {metric}: "), _text(field(metric)))
    elif kind == "value_counts":
        sentence = F.format_string(
            f"Frequency of %s in %s{filters.replace('%', '%%')}: %d", "value", "column", "count"
        )
    elif kind == "histogram":
        sentence = F.concat(
            F.lit("Histogram bin ("), _text(F.col("bin_lo")), F.lit(", "), _text(F.col("bin_hi")),
            F.lit("] for "), F.col("column"), F.lit(f"{filters}: "), F.col("count"),
        )
    elif kind == "profile":
        sentence = F.concat(F.lit("Summary for '"), F.col("column"), F.lit(f"'{filters}: "), F.col("stats"))
    elif kind == "correlation":
        sentence = F.lit(f"Correlation matrix computed{filters}.")
    else:
        return df
    return df.withColumn("_summary", sentence)
