"""Reading messy cells as numbers, dates or normalised text, with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsense.functions.literals import NUMBER_PATTERN

WHITE_SPACE = " \t\n\r\f\v"
YEAR_FIRST = r"^\s*\d{4}[-/]\d{1,2}"
NUMERIC_DATE = r"^\s*(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b"
DOTTED_DATE = r"^(\s*\d{4})\.(\d{1,2})\.(\d{1,2})\b"
COMPACT_DATE = r"^\s*(19\d{2}|20\d{2}|2100)(\d{2})(\d{2})\s*$"
#: Two-digit years are 1969 to 2068.
_DAY_AND_MONTH = r"^\s*(\d{1,2})(?:[/-](\d{1,2})[/-]|(?<=\d{2})\.(\d{2})\.)"
THIS_CENTURY, LAST_CENTURY = (_DAY_AND_MONTH + years + r"(?=\s|$)" for years in (r"([0-5]\d|6[0-8])", r"(69|[7-9]\d)"))
# Names of months and weekdays, whole or shortened.
MONTHS = "january february march april may june july august september october november december".split()
_MONTH = rf"(?=(?:{'|'.join(MONTHS)}|sept|{'|'.join(m[:3] for m in MONTHS)})\b)([a-z]{{3}})[a-z]*\.?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?[ ,]+)?"
_DAY, _GAP, _YEAR, _REST = r"(\d{1,2})(?:st|nd|rd|th)?", r"(?:[ ,-]+|, *)", r"(\d{4})", r"(?:[ ,T]+(\d.*))?\s*$"
DAY_MONTH_YEAR = rf"(?i)^\s*{_WEEKDAY}{_DAY}{_GAP}(?:of )?{_MONTH}{_GAP}{_YEAR}{_REST}"
MONTH_DAY_YEAR = rf"(?i)^\s*{_WEEKDAY}{_MONTH}{_GAP}{_DAY}{_GAP}{_YEAR}{_REST}"
MONTH_YEAR = rf"(?i)^\s*{_MONTH}{_GAP}{_YEAR}\s*$"
_HALF = r"[\sT,]+(0?[1-9]|1[0-2])((?::\d{2}){0,2}(?:\.\d+)?)\s*"
HALF_DAY = rf"(?i)^(.*\d.*?){_HALF}[ap]\.?m\.?\s*$"
AFTERNOON = r"(?i)[\sT,](0?[1-9]|1[01])(:[\d.:]+)?\s*p\.?m\.?\s*$"
AFTER_MIDNIGHT = r"(?i)[\sT,]12(:[\d.:]+)?\s*a\.?m\.?\s*$"
OFFSET = r"^(.*:\d{2}(?:\.\d+)?)\s*(?:[zZ]|UTC|GMT|[+-]\d{2}:?\d{2})\s*$"
#: A cell that is no date in plain figures is looked at again only if it begins like one and is short.
DATE_LIKE = rf"(?i)^\s*(?:\d|{'|'.join(m[:3] for m in MONTHS)}|mon|tue|wed|thu|fri|sat|sun)"
MOST_DATE_LETTERS = 60

# Whole numbers in this range may be calendar days written YYYYMMDD.
FIRST_DAY_NUMBER, LAST_DAY_NUMBER = 19000101, 21001231


def is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.IntegerType, T.LongType))


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def is_time(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def strip(column: Column) -> Column:
    """Blanks, tabs and line ends go at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(column, F.lit(WHITE_SPACE))


def number_from_text(column: Column) -> Column:
    """The number written in a text cell, else null. ``1d``, ``NaN`` and the like are not numbers."""
    return F.when(column.rlike(NUMBER_PATTERN), column.try_cast("double"))


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Any column as a number: typed numbers unchanged, NaN and unreadable cells null."""
    if is_float(dtype):
        return F.when(~F.isnan(column), column)
    if is_number(dtype):
        return column
    if isinstance(dtype, T.BooleanType):
        return column.cast("int")
    if is_text(dtype):
        return number_from_text(column)
    return F.lit(None).cast("double")


def _moment(column: Column) -> Column:
    return column.try_cast("timestamp_ntz")


def _plain_date(column: Column) -> Column:
    """Dates in figures with a four-digit year first or last; day-first, month-first where that is impossible."""
    day_first, month_first = (F.regexp_replace(column, NUMERIC_DATE, order) for order in ("$3-$2-$1", "$3-$1-$2"))
    return F.when(column.rlike(YEAR_FIRST), _moment(F.translate(column, "/", "-"))).when(
        column.rlike(NUMERIC_DATE), F.coalesce(_moment(day_first), _moment(month_first))
    )


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, apart from the generated code of the query, which stays short enough to be compiled."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _worded(column: Column, spelling: str, ordered: str) -> Column:
    """A date with its month's name, put as ``2023-Jan-5 10:30`` by ``ordered`` and then in figures."""
    names = F.lit("".join(m[:3] for m in MONTHS))

    def in_figures(text: Column) -> Column:
        month = ((F.instr(names, F.lower(F.substring(text, 6, 3))) + 2) / 3).cast("int").cast("string")
        return _moment(F.concat(F.substring(text, 1, 5), month, F.substring(text, 9, MOST_DATE_LETTERS)))

    return _once(F.regexp_replace(column, spelling, ordered), in_figures)


def _other_date(column: Column) -> Column:
    """Dates that must be rewritten; each spelling is tested before anything is rewritten, so a cell pays for its own only."""

    def short_year(spelling: str, century: str) -> Column:
        return F.coalesce(*(_moment(F.regexp_replace(column, spelling, century + order)) for order in ("$4-$2$3-$1", "$4-$1-$2$3")))

    return (
        F.when(column.rlike(DAY_MONTH_YEAR), _worded(column, DAY_MONTH_YEAR, "$3-$2-$1 $4"))
        .when(column.rlike(MONTH_DAY_YEAR), _worded(column, MONTH_DAY_YEAR, "$3-$1-$2 $4"))
        .when(column.rlike(MONTH_YEAR), _worded(column, MONTH_YEAR, "$2-$1-01"))
        .when(column.rlike(THIS_CENTURY), short_year(THIS_CENTURY, "20"))
        .when(column.rlike(LAST_CENTURY), short_year(LAST_CENTURY, "19"))
        .when(column.rlike(COMPACT_DATE), _moment(F.regexp_replace(column, COMPACT_DATE, "$1-$2-$3")))
        .when(column.rlike(DOTTED_DATE), _moment(F.regexp_replace(column, DOTTED_DATE, "$1-$2-$3")))
    )


def _any_date(column: Column) -> Column:
    return F.coalesce(_plain_date(column), _other_date(column))


def _rewritten(column: Column) -> Column:
    """A date whose time is AM or PM, has an offset, or that is spelled in another way."""
    hours = F.when(column.rlike(AFTERNOON), 12).when(column.rlike(AFTER_MIDNIGHT), -12).otherwise(0)
    whole_day = F.regexp_replace(F.regexp_replace(column, HALF_DAY, "$1 $2$3"), r"(\s\d{1,2})$", "$1:00")
    return (
        F.when(column.rlike(HALF_DAY), _once(whole_day, _any_date) + F.make_dt_interval(F.lit(0), hours))
        .when(column.rlike(OFFSET), _once(F.regexp_replace(column, OFFSET, "$1"), _any_date))
        .otherwise(_other_date(column))
    )


def time_from_text(column: Column) -> Column:
    """The moment written in a text cell, else null.

    Year-first spellings are unambiguous. The rest is day-first, and month-first only where the day-first reading is impossible
    (12/25/2023). Months may be written out or shortened, with a weekday before and an ordinal day; two-digit years are 1969 to
    2068, eight figures from 1900 on are YYYYMMDD, times may be AM or PM, and a month with a year alone is its first day. An offset
    from UTC is passed over: the time as written is meant.

    Plain figures are tried first, as they need no rewriting but that to year-first order; only a cell that they do not fit, and that
    begins like a date, is tested for the other spellings.
    """
    like_a_date = (F.length(column) <= MOST_DATE_LETTERS) & column.rlike(DATE_LIKE)
    return F.coalesce(_plain_date(column), F.when(like_a_date, _once(column, _rewritten)))


def time_from_day_number(column: Column) -> Column:
    """20230105 → 2023-01-05; impossible days become null."""
    digits = column.try_cast("long").cast("string")
    parts = [F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 10)]
    return F.concat_ws("-", *parts).try_cast("date").cast("timestamp_ntz")


def normalise_text(column: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends, null as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(column, F.lit(""))), r"\s+", " "))


def plain_number(value: Column) -> Column:
    """A double as text without an exponent, with at least one decimal: 12500000.0."""
    text = value.cast("string")
    wide = F.regexp_replace(value.try_cast("decimal(38,10)").cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when(text.contains("E"), F.coalesce(wide, text)).otherwise(text)
