"""Filters on loosely typed columns, as pushable Column predicates where the type allows."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from gridsense.errors import QueryIssue
from gridsense.functions import coerce, literals
from gridsense.functions.literals import Span
from gridsense.plans.classes import ColumnClass

# Accepted spellings of the filter operators.
OPERATORS = {
    "=": "eq", "==": "eq", "eq": "eq", "is": "is",
    "!=": "neq", "<>": "neq", "neq": "neq", "is not": "is_not",
    ">": ">", "<": "<", ">=": ">=", "<=": "<=",
    "contains": "contains", "not contains": "not_contains", "not_contains": "not_contains",
    "like": "like", "not like": "not_like",
    "in": "in", "not in": "not_in", "not_in": "not_in",
    "between": "between",
}


def canonical_operator(operator: object) -> str:
    word = str("=" if operator is None else operator).strip().lower()
    return OPERATORS.get(word, word)


def _day_bounds(column: Column, span: Span) -> list[Column]:
    """A span on YYYYMMDD numbers as plain integer comparisons, which reach the scan."""
    bounds = []
    if span.start is not None:
        day = literals.day_number(span.start)
        bounds.append(column >= day if span.start_in and literals.midnight(span.start) else column > day)
    if span.end is not None:
        day = literals.day_number(span.end)
        bounds.append(column <= day if span.end_in or not literals.midnight(span.end) else column < day)
    return bounds


def _valid_pattern(pattern: str) -> str:
    """The pattern, if Spark can read it as a regular expression; a constant row tells, without a job."""
    try:
        SparkSession.active().sql("SELECT '' RLIKE :pattern", {"pattern": pattern}).collect()
    except (PySparkException, Py4JJavaError) as error:
        raise QueryIssue(f"'{pattern}' is no regular expression.") from error
    return pattern


class _Subject:
    """One column under one reading, with the comparisons it supports."""

    def __init__(self, column: Column, cls: ColumnClass) -> None:
        self.column = column
        self.cls = cls

    def moment(self, value: datetime) -> Column:
        kind = "timestamp_ntz" if not coerce.is_time(self.cls.dtype) else self.cls.dtype.simpleString()
        if kind == "date" and not literals.midnight(value):
            kind = "timestamp_ntz"
        return F.lit(value.isoformat(sep=" ")).cast(kind)

    def within(self, span: Span) -> Column:
        if self.cls.day_numbers:
            bounds = _day_bounds(self.column, span)
            bounds.append(self.cls.time(self.column).isNotNull())
        else:
            time = self.cls.time(self.column)
            if span.start is not None and span.start == span.end:
                return time == self.moment(span.start)
            bounds = []
            if span.start is not None:
                start = self.moment(span.start)
                bounds.append(time >= start if span.start_in else time > start)
            if span.end is not None:
                end = self.moment(span.end)
                bounds.append(time <= end if span.end_in else time < end)
        kept = bounds[0]
        for bound in bounds[1:]:
            kept = kept & bound
        return kept

    def missing(self) -> Column:
        if coerce.is_text(self.cls.dtype):
            return self.column.isNull() | ~self.column.rlike(r"\S")
        if coerce.is_float(self.cls.dtype):
            return self.column.isNull() | F.isnan(self.column)
        return self.column.isNull()

    @property
    def comparable_number(self) -> Column:
        """The number to compare; a typed column stays bare so that the filter is pushed."""
        typed_number = coerce.is_number(self.cls.dtype)
        return self.column if typed_number else self.cls.number(self.column)

    def compare(self, operator: str, number: float) -> Column:
        left = self.comparable_number
        test = {
            ">": lambda: left > number,
            ">=": lambda: left >= number,
            "<": lambda: left < number,
            "<=": lambda: left <= number,
        }[operator]()
        if operator in (">", ">=") and coerce.is_float(self.cls.dtype):
            test = test & ~F.isnan(self.column)
        return test

    def lowered(self) -> Column:
        return F.lower(self.cls.text(self.column))

    def has_text(self, value: str, regex: bool) -> Column:
        if regex:
            return self.cls.text(self.column).rlike(f"(?i){_valid_pattern(value)}")
        return F.contains(self.lowered(), F.lit(value.lower()))

    def like(self, pattern: str) -> Column:
        return self.cls.text(self.column).ilike(pattern.replace("\\", "\\\\"))


def _equals(subject: _Subject, value: object, periods: bool, day_first: bool) -> Column:
    number = literals.number_of(value)
    if number is not None and subject.cls.numbers and not subject.cls.day_numbers:
        return subject.comparable_number == number
    if subject.cls.times:
        span = literals.equality_span(value, day_first)
        if span is not None and not periods and literals.year_of(value) is None:
            span = Span(span.start, span.start, True, True)
        if span is not None:
            return subject.within(span)
    return subject.lowered() == literals.text_of(value).lower()


def _member(subject: _Subject, value: object) -> Column:
    parts = literals.listed(value)
    if coerce.is_number(subject.cls.dtype):
        numbers = [n for n in map(literals.number_of, parts) if n is not None]
        return subject.column.isin(numbers) if numbers else F.lit(False)
    if coerce.is_time(subject.cls.dtype):
        moments = [m for m in map(literals.moment_of, parts) if m is not None]
        return subject.column.isin([subject.moment(m) for m in moments]) if moments else F.lit(False)
    words = {literals.text_of(part).lower() for part in parts}
    return subject.lowered().isin(sorted(words))


def _matches(subject: _Subject, operator: str, value: object, regex: bool) -> Column:
    text = literals.text_of(value)
    if subject.cls.times:
        period = literals.period_of(text.replace("%", "").replace("*", "").strip("-/"))
        if period is not None:
            return subject.within(period)
    return subject.like(text) if operator.endswith("like") else subject.has_text(text, regex)


def _ordered(subject: _Subject, operator: str, value: object, day_first: bool) -> Column | None:
    number = literals.number_of(value)
    if number is not None and subject.cls.numbers and not subject.cls.day_numbers:
        return subject.compare(operator, number)
    span = literals.comparison_span(operator, value, day_first) if subject.cls.times else None
    return None if span is None else subject.within(span)


def _between(subject: _Subject, value: object) -> Column | None:
    parts = literals.listed(value)
    if len(parts) < 2:
        return None
    low, high = (literals.number_of(part) for part in parts[:2])
    if low is not None and high is not None and subject.cls.numbers and not subject.cls.day_numbers:
        return subject.comparable_number.between(low, high)
    span = literals.between_span(*parts[:2]) if subject.cls.times else None
    if span is None and low is not None and high is not None and subject.cls.numbers:
        return subject.comparable_number.between(low, high)
    return None if span is None else subject.within(span)


def _negated(test: Column) -> Column:
    """Everything the test does not accept, rows it cannot judge included."""
    return ~F.coalesce(test, F.lit(False))


def predicate(
    name: str,
    column: Column,
    cls: ColumnClass,
    operator: object,
    value: object,
    *,
    regex: bool = False,
    periods_in_negation: bool = False,
    day_first: bool = False,
) -> Column:
    """The boolean column for one filter; raises ``QueryIssue`` if it makes no sense."""
    op = canonical_operator(operator)
    subject = _Subject(column, cls)
    if not isinstance(value, (list, tuple, set)) and literals.text_of(value).lower() in literals.MISSING_WORDS:
        if op in ("eq", "is"):
            return subject.missing()
        if op in ("neq", "is_not"):
            return ~subject.missing()

    builders: dict[str, Callable[[], Column | None]] = {
        "eq": lambda: _equals(subject, value, True, day_first),
        "neq": lambda: _negated(_equals(subject, value, periods_in_negation, day_first)),
        "contains": lambda: _matches(subject, op, value, regex),
        "like": lambda: _matches(subject, op, value, regex),
        "not_contains": lambda: _negated(_matches(subject, op, value, regex)),
        "not_like": lambda: _negated(_matches(subject, op, value, regex)),
        "in": lambda: _member(subject, value),
        "not_in": lambda: _negated(_member(subject, value)),
        "between": lambda: _between(subject, value),
        **{sign: (lambda sign=sign: _ordered(subject, sign, value, day_first)) for sign in (">", "<", ">=", "<=")},
    }
    if op not in builders:
        raise QueryIssue(f"Filters know no operator '{operator}' (asked for on '{name}').")
    test = builders[op]()
    if test is None:
        raise QueryIssue(f"'{name}' cannot be compared: {operator} {value} needs numbers or dates in it.")
    return test


NEGATIONS = ("neq", "is_not", "not_in", "not_contains", "not_like")


def sheet_matches(sheet: str, operator: object, value: object) -> bool:
    """Whether a filter on the virtual ``sheet`` column keeps a sheet of this name."""
    op, wanted, name = canonical_operator(operator), literals.text_of(value).lower(), sheet.lower()
    asked, negated = {"neq": "eq", "is": "eq", "is_not": "eq"}.get(op, op.removeprefix("not_")), op in NEGATIONS
    if asked == "eq":  # no sheet is without a name
        kept = name == wanted and wanted not in literals.MISSING_WORDS
    elif asked == "in":
        kept = name in {literals.text_of(part).lower() for part in literals.listed(value)}
    elif asked == "contains":
        kept = wanted in name
    elif asked == "like":
        signs = {"%": ".*", "_": "."}
        kept = re.fullmatch("".join(signs.get(c) or re.escape(c) for c in wanted), name, re.DOTALL) is not None
    else:
        raise QueryIssue(f"Sheets have no filter '{operator}'.")
    return kept != negated


# How a filter is worded in a summary.
_WORDING = {">=": "at least", ">": "greater than", "<": "less than", "<=": "at most",
            "=": "is", "==": "is", "contains": "containing", "like": "containing"}
_DATE_WORDING = {">=": "after or on", ">": "after", "<": "before", "<=": "before or on"}


def describe_filters(filters: list[tuple[str, object, object]]) -> str:
    """`` where a is 1 and b at least 2``, for summaries."""
    if not filters:
        return ""
    parts = []
    for name, operator, value in filters:
        sign = str(operator or "=").strip().lower()
        words = {**_WORDING, **_DATE_WORDING} if "date" in str(name).lower() else _WORDING
        parts.append(f"{name} {words.get(sign, sign)} {value}")
    return " where " + " and ".join(parts)
