"""Sorting with nulls last and a fixed order among ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from gridsense.functions.names import field

UNORDERED = (T.MapType, T.VariantType)


def _orderable(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, UNORDERED)]


def sort_and_limit(
    df: DataFrame, keys: list[tuple[Column, bool]], ties: list[str], limit: int | None
) -> DataFrame:
    """``keys`` are (expression, descending) pairs.

    A limit without a tie-breaking column orders ties by the row's own content, so the same
    rows come back whatever the partitioning. Sort plus limit is planned as a distributed
    top-k: no full sort.
    """
    order = [c.desc_nulls_last() if descending else c.asc_nulls_last() for c, descending in keys]
    if limit is not None and not ties:
        ties = _orderable(df)
    if order or limit is not None:
        df = df.orderBy(*order, *(field(t).asc_nulls_last() for t in ties))
    return df if limit is None else df.limit(limit)
