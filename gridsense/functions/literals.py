"""What a filter literal can mean: a number, a calendar period, a moment in time."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime

# Literals that ask for missing data.
MISSING_WORDS = ("null", "none", "nan", "", "empty")

NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

MONTH_FIRST = ("%m/%d/%Y", "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S")
DAY_FIRST = ("%d/%m/%Y", "%d/%m/%Y %H:%M", "%d/%m/%Y %H:%M:%S")
NAMED_MONTH = ("%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y")


@dataclass(frozen=True)
class Span:
    """A stretch of time; an open end is None, and each end may be in or out."""

    start: datetime | None = None
    end: datetime | None = None
    start_in: bool = True
    end_in: bool = False


def text_of(value: object) -> str:
    return "" if value is None else str(value).strip()


def number_of(value: object) -> float | int | None:
    if isinstance(value, bool):
        return None
    text = text_of(value)
    if not re.match(NUMBER_PATTERN, text):
        return None
    whole = int(text) if re.fullmatch(r"[+-]?\d+", text) else None
    return whole if whole is not None and -(2**63) <= whole < 2**63 else float(text)


def year_of(value: object) -> int | None:
    text = text_of(value)
    return int(text) if re.fullmatch(r"\d{4}", text) and int(text) > 0 else None


def _months_from(year: int, month: int, length: int) -> Span:
    after = year * 12 + (month - 1) + length
    if after // 12 > datetime.max.year:  # the last period has no end
        return Span(datetime(year, month, 1))
    return Span(datetime(year, month, 1), datetime(after // 12, after % 12 + 1, 1))


def period_of(value: object) -> Span | None:
    """A year, a quarter (2023Q1, 2023-Q1, Q1 2023) or a month (2023-03, 03/2023, Mar 2023)."""
    text = text_of(value)
    year = year_of(text)
    if year is not None:
        return _months_from(year, 1, 12)
    for pattern in (r"(?P<y>\d{4})[- ]?[qQ](?P<q>[1-4])", r"[qQ](?P<q>[1-4])[- ]?(?P<y>\d{4})"):
        hit = re.fullmatch(pattern, text)
        if hit and int(hit["y"]):
            return _months_from(int(hit["y"]), int(hit["q"]) * 3 - 2, 3)
    for pattern in (r"(?P<y>\d{4})[-/](?P<m>\d{1,2})", r"(?P<m>\d{1,2})[-/](?P<y>\d{4})"):
        hit = re.fullmatch(pattern, text)
        if hit and int(hit["y"]) and 1 <= int(hit["m"]) <= 12:
            return _months_from(int(hit["y"]), int(hit["m"]), 1)
    for layout in ("%b %Y", "%B %Y"):
        try:
            month = datetime.strptime(text, layout)
        except ValueError:
            continue
        return _months_from(month.year, month.month, 1)
    return None


def moment_of(value: object, day_first: bool = False) -> datetime | None:
    """A point in time. ISO spellings are never ambiguous; others follow ``day_first``."""
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day)
    text = text_of(value)
    if not re.search(r"\d", text) or (number_of(text) is not None and not re.fullmatch(r"\d{8}", text)):
        return None
    try:
        return datetime.fromisoformat(text.replace("/", "-")).replace(tzinfo=None)
    except ValueError:
        pass
    numeric = DAY_FIRST + MONTH_FIRST if day_first else MONTH_FIRST + DAY_FIRST
    slashed = re.sub(r"(?<=\d)[.-](?=\d)", "/", text)
    worded = re.sub(r"[,\s-]+", " ", text)
    for candidate, layouts in ((slashed, numeric), (worded, NAMED_MONTH)):
        for layout in layouts:
            try:
                return datetime.strptime(candidate, layout)
            except ValueError:
                continue
    return None


def comparison_span(operator: str, value: object, day_first: bool = False) -> Span | None:
    """The times that satisfy ``> < >= <=`` against a year or a moment.

    A quarter or month stands for the moment it starts.
    """
    year = year_of(value)
    if year is not None:
        first = datetime(year, 1, 1)
        if year == datetime.max.year:  # no moment comes after it
            later, upto = Span(start=datetime.max, start_in=False), Span(end=datetime.max, end_in=True)
        else:
            later, upto = Span(start=datetime(year + 1, 1, 1)), Span(end=datetime(year + 1, 1, 1))
        return {
            ">": later,
            ">=": Span(start=first),
            "<": Span(end=first),
            "<=": upto,
        }[operator]
    period = period_of(value)
    moment = period.start if period else moment_of(value, day_first)
    if moment is None:
        return None
    return {
        ">": Span(start=moment, start_in=False),
        ">=": Span(start=moment),
        "<": Span(end=moment),
        "<=": Span(end=moment, end_in=True),
    }[operator]


def equality_span(value: object, day_first: bool = False) -> Span | None:
    """The times meant by ``= value``: a whole period, or a single instant."""
    period = period_of(value)
    if period is not None:
        return period
    moment = moment_of(value, day_first)
    return None if moment is None else Span(moment, moment, True, True)


def between_span(low: object, high: object) -> Span | None:
    """Inclusive range between two moments; a bare year, month or quarter starts at its first day."""
    ends = []
    for value in (low, high):
        period = period_of(value)
        ends.append(period.start if period else moment_of(value, day_first=True))
    if None in ends:
        return None
    return Span(ends[0], ends[1], True, True)


def listed(value: object) -> list[object]:
    """A list literal, or the parts of a comma-separated one."""
    if isinstance(value, (list, tuple, set)):
        return list(value)
    return str(value).split(",")


def midnight(moment: datetime) -> bool:
    return moment == datetime(moment.year, moment.month, moment.day)


def day_number(moment: datetime) -> int:
    return moment.year * 10000 + moment.month * 100 + moment.day

