"""Scalar and grouped aggregation with numeric coercion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsense.errors import QueryIssue
from gridsense.functions import coerce, literals
from gridsense.functions.names import field
from gridsense.operators import ranked
from gridsense.plans.classes import ColumnClass

NUMERIC_FUNCTIONS = ("sum", "avg", "max", "min", "median", "mode", "std", "variance", "quantile")
#: Whole numbers are added up with this many digits, so that no number of rows overflows.
WHOLE_SUM = "decimal(28,0)"
RANKED_FUNCTIONS = ("median", "quantile", "mode")
ANY_FUNCTIONS = ("count", "distinct_count", "null_count", "null_pct")


@dataclass(frozen=True)
class Measure:
    """One aggregate: a function of a column (None for the row count) under an output name."""

    function: str
    column: str | None
    alias: str
    share: float = 0.5
    approximate: bool = False


def quantile_share(value: object) -> float:
    """A share in 0..1, or a percentage above 1; ``1`` itself means the maximum."""
    number = literals.number_of(value)
    if number is None:
        raise QueryIssue(f"A quantile is a number, not '{value}'.")
    share = number / 100.0 if number > 1 else float(number)
    if not 0 <= share <= 1:
        raise QueryIssue(f"{value} is no quantile: give a share up to 1 or a percentage up to 100.")
    return share


def named_measures(
    wanted: list[tuple[str, str | None]], share: float = 0.5, approximate: bool = False
) -> list[Measure]:
    """Output names ``{function}_{column}``, numbered from 2 where one repeats."""
    used: dict[str, int] = {}
    measures = []
    for function, column in wanted:
        name = "count" if column is None else f"{function}_{column}"
        used[name] = used.get(name, 0) + 1
        alias = name if used[name] == 1 else f"{name}_{used[name]}"
        measures.append(Measure(function, column, alias, share, approximate))
    return measures


def _absent(column: Column, cls: ColumnClass) -> Column:
    if coerce.is_float(cls.dtype):
        return column.isNull() | F.isnan(column)
    return column.isNull()


def _expression(measure: Measure, cls: ColumnClass | None, grouped: bool) -> Column:
    if measure.column is None:
        return F.count(F.lit(1))
    column = field(measure.column)
    absent = _absent(column, cls)
    number = cls.number(column)
    total = F.sum(number.cast(WHOLE_SUM) if coerce.is_whole(cls.dtype) else number)
    distinct = F.approx_count_distinct if measure.approximate else F.count_distinct
    build = {
        "sum": lambda: F.coalesce(total, F.lit(0)) if grouped else total,
        "avg": lambda: F.avg(number),
        "max": lambda: F.max(number),
        "min": lambda: F.min(number),
        "std": lambda: F.stddev_samp(number),
        "variance": lambda: F.var_samp(number),
        "count": lambda: F.count(F.when(~absent, column)),
        "distinct_count": lambda: distinct(F.when(~absent, column)),
        "null_count": lambda: F.count_if(absent),
        "null_pct": lambda: F.round(
            F.coalesce(100 * F.try_divide(F.count_if(absent), F.count(F.lit(1))), F.lit(0.0)), 4
        ),
    }[measure.function]
    return build()


def _ranked(df: DataFrame, keys: list[str], measure: Measure, cls: ColumnClass) -> DataFrame:
    value = cls.number(field(measure.column))
    if measure.function == "mode":
        return ranked.mode(df, keys, value, measure.alias)
    share = 0.5 if measure.function == "median" else measure.share
    return ranked.quantile(df, keys, value, share, measure.alias)


def aggregate(
    df: DataFrame,
    keys: list[str],
    measures: list[Measure],
    classes: dict[str, ColumnClass],
) -> DataFrame:
    """One row per key (or one row in all) with every measure.

    All measures that combine map-side share one pass. Medians, quantiles and modes need the
    values in order; each has its own plan (``ranked``), joined by key. Several exact distinct
    counts without keys are taken one by one too: together they would copy every row.
    """
    grouped = bool(keys)
    exact = [m for m in measures if m.function == "distinct_count" and not m.approximate]
    lone = exact if len(exact) > 1 and not grouped else []
    apart = [m for m in measures if m.function in RANKED_FUNCTIONS or m in lone]
    direct = [m for m in measures if m not in apart]

    result = None
    if direct:
        expressions = [_expression(m, classes.get(m.column), grouped).alias(m.alias) for m in direct]
        result = df.groupBy(*map(field, keys)).agg(*expressions)
    for measure in apart:
        if measure in lone:
            one = df.agg(_expression(measure, classes[measure.column], grouped).alias(measure.alias))
        else:
            one = _ranked(df, keys, measure, classes[measure.column])
        if result is None:
            result = one
        elif grouped:
            result = result.join(one, keys, "left")
        else:
            result = result.withColumn(measure.alias, one.scalar())
    return result.select(*map(field, keys), *(field(m.alias) for m in measures))
