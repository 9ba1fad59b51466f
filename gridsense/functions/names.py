"""Loose column names and operation names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings accepted for an operation.
OPERATION_ALIASES = {
    "average": "avg",
    "mean": "avg",
    "corr": "correlation",
    "summary": "profile",
    "summarise": "profile",
    "summarize": "profile",
    "describe": "profile",
    "stdev": "std",
    "stddev": "std",
    "var": "variance",
    "percentile": "quantile",
    "distribution": "histogram",
    "frequency": "value_counts",
    "value_count": "value_counts",
    "distinct": "distinct_count",
    "unique_count": "distinct_count",
    "nulls": "null_count",
    "missing": "null_count",
    "missing_count": "null_count",
    "missing_pct": "null_pct",
    "missing_percent": "null_pct",
}

# Wording looked for when no single word names an operation.
OPERATION_PHRASES = {
    "value count": "value_counts",
    "unique count": "distinct_count",
    "null count": "null_count",
    "missing count": "null_count",
    "null pct": "null_pct",
    "missing pct": "null_pct",
}

# The operations that exist.
OPERATIONS = (
    "sum", "avg", "count", "max", "min", "median", "mode", "std", "variance", "quantile",
    "histogram", "value_counts", "distinct_count", "null_count", "null_pct",
    "correlation", "profile", "filter", "none",
)


def field(name: str) -> Column:
    """A column by its literal name, whatever characters the name contains."""
    return F.col("`" + name.replace("`", "``") + "`")


def _squeeze(name: object) -> str:
    return re.sub(r"[^a-z0-9]", "", str(name).lower())


def resolve(columns: Iterable[str], wanted: object) -> str | None:
    """Exact name, else the first equal when case is ignored, else when punctuation is too."""
    columns = list(columns)
    if wanted is None or wanted == "":
        return None
    if wanted in columns:
        return str(wanted)
    folded = str(wanted).lower()
    squeezed = _squeeze(wanted)
    same_case = [c for c in columns if c.lower() == folded]
    same_letters = [c for c in columns if squeezed and _squeeze(c) == squeezed]
    return next(iter(same_case + same_letters), None)


def resolve_all(columns: Iterable[str], wanted: Iterable[object]) -> list[str]:
    """Resolve several names; misses and repeats disappear."""
    columns = list(columns)
    hits = (resolve(columns, name) for name in wanted or ())
    return list(dict.fromkeys(hit for hit in hits if hit is not None))


def canonical_operation(name: object) -> str:
    word = str(name or "").strip().lower()
    return OPERATION_ALIASES.get(word, word)


def operations_in(*texts: object) -> list[str]:
    """Every operation named in the given texts, in order: ``"avg|sum"`` gives both."""
    found: dict[str, None] = {}
    for text in texts:
        for word in re.findall(r"[A-Za-z_]+", str(text or "")):
            operation = canonical_operation(word)
            if operation in OPERATIONS:
                found[operation] = None
    if found:
        return list(found)
    wording = " ".join(str(text or "").lower() for text in texts)
    spelled = [op for phrase, op in OPERATION_PHRASES.items() if phrase in wording]
    embedded = [op for alias, op in OPERATION_ALIASES.items() if len(alias) > 4 and alias in wording]
    return (spelled + embedded)[:1] or ["none"]
