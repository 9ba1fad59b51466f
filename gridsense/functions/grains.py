"""Time grains for grouping.

Each grain has a compact *key* (a date or a small integer) to group by and a *label* made
from the key after the aggregation, so rows are never formatted one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    key: Callable[[Column], Column]
    label: Callable[[Column], Column]


def _name_of(names: str) -> Callable[[Column], Column]:
    words = F.split(F.lit(names), " ")
    return lambda key: F.element_at(words, key)


def _week_label(monday: Column) -> Column:
    return F.concat(monday.cast("string"), F.lit("/"), F.date_add(monday, 6).cast("string"))


def _quarter_label(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def _day_text(day: Column) -> Column:
    return day.cast("string")


def grain(name: str) -> Grain:
    """Year, quarter, month, month_name, week, day or day_name; any other word means day."""
    months = "January February March April May June July August September October November December"
    days = "Monday Tuesday Wednesday Thursday Friday Saturday Sunday"
    grains = {
        "year": Grain(F.year, lambda key: F.lpad(key.cast("string"), 4, "0")),
        "quarter": Grain(lambda day: F.trunc(day, "quarter"), _quarter_label),
        "month": Grain(lambda day: F.trunc(day, "month"), lambda key: F.date_format(key, "yyyy-MM")),
        "month_name": Grain(F.month, _name_of(months)),
        "week": Grain(lambda day: F.date_sub(F.next_day(day, "Mon"), 7), _week_label),
        "day_name": Grain(lambda day: F.weekday(day) + 1, _name_of(days)),
    }
    return grains.get(name, Grain(lambda day: day, _day_text))
