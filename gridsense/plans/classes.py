"""What the cells of a column can be read as.

Typed columns need no look at the data, nor does most of what is asked of text columns.
Where it matters whether a text column holds numbers or dates, a search for one such cell
decides, and numbers that might be YYYYMMDD days need a search for one value that is not. Only a sort needs shares, which one aggregate over just those columns counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsense.functions import coerce
from gridsense.functions.literals import NUMBER_PATTERN, listed, moment_of, number_of, period_of
from gridsense.functions.names import field

# Fixed value: share of cells that must be readable before a sort treats them as such.
SORT_SHARE = 0.7


@dataclass(frozen=True)
class ColumnClass:
    """How one column may be compared, sorted and aggregated."""

    dtype: T.DataType
    numbers: bool = False
    times: bool = False
    sort_as: str = "text"
    day_numbers: bool = False

    def number(self, column: Column) -> Column:
        return coerce.as_number(column, self.dtype)

    def time(self, column: Column) -> Column:
        if coerce.is_time(self.dtype):
            return column
        if self.day_numbers:
            return coerce.time_from_day_number(column)
        if coerce.is_text(self.dtype):
            return coerce.time_from_text(column)
        return F.lit(None).cast("timestamp_ntz")

    def text(self, column: Column) -> Column:
        return coerce.strip(column) if coerce.is_text(self.dtype) else column.cast("string")

    def sort_key(self, column: Column) -> Column:
        if self.sort_as == "number":
            return self.number(column)
        if self.sort_as == "time":
            return self.time(column)
        return F.lower(column) if coerce.is_text(self.dtype) else column


def typed(dtype: T.DataType) -> ColumnClass:
    """The class of a column as far as its declared type tells."""
    numeric = coerce.is_number(dtype) or isinstance(dtype, T.BooleanType)
    return ColumnClass(
        dtype=dtype,
        numbers=numeric,
        times=coerce.is_time(dtype),
        sort_as="native" if not coerce.is_text(dtype) else "text",
    )


def readable_text(numbers: bool = False, times: bool = False) -> ColumnClass:
    """A text column whose content is known without looking, such as a time-grain label."""
    sort_as = "number" if numbers else "time" if times else "text"
    return ColumnClass(T.StringType(), numbers, times, sort_as)


def day_numbers(dtype: T.DataType) -> ColumnClass:
    """Whole numbers that the caller knows to be YYYYMMDD days."""
    return ColumnClass(dtype, numbers=True, times=True, sort_as="native", day_numbers=True)


NUMBERS, TIMES, SHARES = "numbers", "times", "shares"


def questions(dtype: T.DataType, operator: str, value: object) -> tuple[str, ...]:
    """What a predicate on a column of this type needs to know about the cells.

    Later questions matter only if the earlier ones are answered with no.
    """
    if not (coerce.is_text(dtype) or coerce.is_whole(dtype) or coerce.is_float(dtype)):
        return ()
    if operator in ("in", "not_in", "is", "is_not"):
        return ()
    values = listed(value) if operator == "between" else [value]
    if operator in ("contains", "not_contains", "like", "not_like"):
        return (TIMES,) if any(period_of(str(v).strip("%*-/ ")) for v in values) else ()
    numeric = coerce.is_text(dtype) and any(number_of(v) is not None for v in values)
    dated = any(period_of(v) or moment_of(v) for v in values)
    return (NUMBERS,) * numeric + (TIMES,) * dated


def _counts(name: str, at: int) -> list[Column]:
    column = field(name)
    return [
        F.count(coerce.number_from_text(column)).alias(f"numbers_{at}"),
        F.count(F.when(~column.rlike(NUMBER_PATTERN), coerce.time_from_text(column))).alias(f"times_{at}"),
    ]


def _read(dtype: T.DataType, rows: int, numbers: int, times: int) -> ColumnClass:
    share = {"number": numbers / rows if rows else 0.0, "time": times / rows if rows else 0.0}
    sort_as = next((kind for kind, part in share.items() if part >= SORT_SHARE), "text")
    return ColumnClass(dtype, numbers > 0, times > 0, sort_as)


def _any(df: DataFrame, test: Column) -> bool:
    """Whether some row passes; the search stops at the first one."""
    return not df.where(test).select(F.lit(1)).limit(1).isEmpty()


def _are_day_numbers(df: DataFrame, name: str) -> bool:
    """Whether the column's numbers are YYYYMMDD days: all of them, or the share that a sort asks for; the rest is then missing.

    Other columns are mostly found out by their first rows, or by file statistics that hold no such number. Only where both kinds
    occur are the cells counted.
    """
    column = field(name)
    day = column.between(coerce.FIRST_DAY_NUMBER, coerce.LAST_DAY_NUMBER)
    whole = (column == F.floor(column)) if coerce.is_float(df.schema[name].dataType) else F.lit(True)
    if not _any(df, ~day):
        return not _any(df, ~whole)
    if not _any(df, day):
        return False
    row = df.agg(F.count(column).alias("all"), F.count_if(day & whole).alias("days")).first()
    return row["days"] >= SORT_SHARE * row["all"]


def _look(df: DataFrame, name: str, dtype: T.DataType, asked: tuple[str, ...]) -> ColumnClass:
    tests = {NUMBERS: coerce.number_from_text, TIMES: coerce.time_from_text}
    answers = dict.fromkeys(tests, False)
    for question in asked:
        answers[question] = _any(df, tests[question](field(name)).isNotNull())
        if answers[question]:
            break
    return ColumnClass(dtype, answers[NUMBERS], answers[TIMES])


def classify(df: DataFrame, asked: Mapping[str, Iterable[tuple[str, ...]]]) -> dict[str, ColumnClass]:
    """Look at the data as far as types leave the questions asked per column open.

    Whether any cell is a number or a date is a search that stops at the first hit. Shares
    need all cells: one aggregate job for all columns in question.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = {n: typed(types[n]) for n in asked}
    counted = []
    for name, wanted in asked.items():
        dtype, wanted = types[name], [w for w in wanted if w]
        if coerce.is_whole(dtype) or coerce.is_float(dtype):
            if any(TIMES in w for w in wanted) and _are_day_numbers(df, name):
                found[name] = day_numbers(dtype)
        elif coerce.is_text(dtype) and wanted:
            # Several different questions are answered by counting once.
            if len(set(wanted)) > 1 or SHARES in wanted[0]:
                counted.append(name)
            else:
                found[name] = _look(df, name, dtype, wanted[0])
    if counted:
        measures = [c for at, n in enumerate(counted) for c in _counts(n, at)]
        row = df.agg(F.count(F.lit(1)).alias("rows"), *measures).first()
        for at, name in enumerate(counted):
            found[name] = _read(types[name], row["rows"], row[f"numbers_{at}"], row[f"times_{at}"])
    return found
