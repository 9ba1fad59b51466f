"""The request: what to filter, group, compute, sort and keep."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from gridsense.errors import QueryIssue
from gridsense.functions import names

# Spellings of a descending sort direction.
DESCENDING = ("desc", "descending", "-1", "false")
NO_GRAIN = ("", "none", "null")


@dataclass(frozen=True)
class Condition:
    column: str
    operator: str = "="
    value: Any = None


@dataclass(frozen=True)
class GroupKey:
    column: str
    grain: str | None = None


@dataclass(frozen=True)
class SortKey:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class Aggregation:
    function: str
    column: str | None = None


@dataclass(frozen=True)
class Intent:
    """A validated request.

    ``limit=None`` keeps the whole result. ``approximate`` allows estimated distinct counts,
    which need no shuffle of the values. ``row_key`` names the column that fixes the order of
    otherwise equal rows.
    """

    operations: tuple[str, ...] = ("none",)
    columns: tuple[str, ...] = ()
    filters: tuple[Condition, ...] = ()
    group_by: tuple[GroupKey, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    having: tuple[Condition, ...] = ()
    sort: tuple[SortKey, ...] = ()
    limit: int | None = None
    top_k: int | None = None
    bins: Any = 10
    percentile: Any = 0.5
    regex: bool = False
    approximate: bool = False
    row_key: str | None = None
    named: tuple[str, ...] = field(default=())

    @classmethod
    def of(cls, request: Mapping[str, Any] | Intent) -> Intent:
        """Read a plain dict request; an ``Intent`` passes through."""
        if isinstance(request, Intent):
            return request
        aggregations = tuple(_aggregation(a) for a in request.get("aggregations") or ())
        spoken = request.get("operation") or "none"
        return cls(
            operations=tuple(names.operations_in(spoken, *(a.function for a in aggregations))),
            columns=tuple(_as_list(request.get("columns"))),
            filters=_conditions(request.get("filters")),
            group_by=tuple(_group_key(g) for g in _as_list(request.get("group_by"))),
            aggregations=aggregations,
            having=_conditions(request.get("having")),
            sort=tuple(_sort_key(s) for s in _as_list(request.get("sort"))),
            limit=_whole("limit", request.get("limit")),
            top_k=_whole("top_k", request.get("top_k")),
            bins=request.get("bins", 10),
            percentile=request.get("percentile", request.get("quantile", 0.5)),
            regex=bool(request.get("regex", False)),
            approximate=bool(request.get("approximate", False)),
            row_key=request.get("row_key"),
            named=tuple(op for op in names.operations_in(spoken) if op not in ("none", "filter")),
        )


def _as_list(value: Any) -> list[Any]:
    if value is None:
        return []
    return list(value) if isinstance(value, (list, tuple)) else [value]


def _whole(name: str, value: Any) -> int | None:
    if value is None:
        return None
    try:
        number = int(value)
    except (TypeError, ValueError):
        raise QueryIssue(f"'{name}' must be a whole number, got {value!r}.") from None
    if number < 0:
        raise QueryIssue(f"'{name}' must not be negative, got {value!r}.")
    return number


def _conditions(value: Any) -> tuple[Condition, ...]:
    if isinstance(value, Mapping):
        return tuple(Condition(column, "=", wanted) for column, wanted in value.items())
    return tuple(
        item
        if isinstance(item, Condition)
        else Condition(item.get("column"), item.get("operator", "="), item.get("value"))
        for item in value or ()
    )


def _group_key(value: Any) -> GroupKey:
    if isinstance(value, GroupKey):
        return value
    if not isinstance(value, Mapping):
        return GroupKey(str(value))
    grain = str(value.get("time_grain") or "").strip().lower()
    return GroupKey(value.get("column"), None if grain in NO_GRAIN else grain)


def _sort_key(value: Any) -> SortKey:
    if isinstance(value, SortKey):
        return value
    if not isinstance(value, Mapping):
        return SortKey(str(value))
    return SortKey(value.get("column"), str(value.get("direction", "asc")).strip().lower() in DESCENDING)


def _aggregation(value: Any) -> Aggregation:
    if isinstance(value, Aggregation):
        return value
    if isinstance(value, Mapping):
        return Aggregation(names.canonical_operation(value.get("function")), value.get("column"))
    return Aggregation(names.canonical_operation(value))
