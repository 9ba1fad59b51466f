"""Keyword search over the text columns of a table or workbook."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsense.errors import QueryIssue
from gridsense.functions import coerce
from gridsense.functions.names import field, resolve, resolve_all
from gridsense.operators.ordering import sort_and_limit
from gridsense.operators.predicates import canonical_operator, predicate, sheet_matches
from gridsense.plans.classes import ColumnClass, classify, questions, typed
from gridsense.plans.intent import Condition

# Words never searched for, and what counts as a word.
STOP_WORDS = (
    "the", "and", "for", "with", "what", "who", "how", "are",
    "were", "was", "have", "has", "that", "this", "from", "where",
    "show", "find", "get", "list", "give", "tell", "all", "any",
    "can", "does", "did", "please", "me", "you", "of", "in", "on",
    "at", "by", "an", "a", "is", "to", "be", "do",
)
WORD = r"\b[a-z0-9_-]{3,}\b"
NO_EXCERPT = ("nan", "none", "")


@dataclass(frozen=True)
class Search:
    """What to search for, where, and how many rows to keep per sheet (None keeps all).

    In a dict request a missing or null ``top_k``, like ``"all"``, keeps all; 0 keeps none.
    """

    query_text: str = ""
    keywords: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()
    id_filters: tuple[Condition, ...] = ()
    post_filters: tuple[Condition, ...] = ()
    top_k: int | None = None
    row_key: str | None = None

    @classmethod
    def of(cls, request: Mapping[str, Any] | Search) -> Search:
        if isinstance(request, Search):
            return request
        plan = request.get("semantic_plan", request) or {}
        return cls(
            query_text=plan.get("query_text") or "",
            keywords=tuple(plan.get("keywords") or ()),
            columns=tuple(plan.get("target_text_columns") or ()),
            id_filters=_conditions(plan.get("id_filters")),
            post_filters=_conditions(plan.get("post_filters")),
            top_k=None if plan.get("top_k") in (None, "", "all") else int(plan["top_k"]),
            row_key=plan.get("row_key"),
        )

    @property
    def words(self) -> list[str]:
        explicit = [str(k).strip().lower() for k in self.keywords if str(k).strip()]
        return explicit or keywords_in(self.query_text)


def _conditions(items: Any) -> tuple[Condition, ...]:
    return tuple(
        i if isinstance(i, Condition) else Condition(i.get("column"), i.get("operator", "="), i.get("value"))
        for i in items or ()
    )


def keywords_in(text: str) -> list[str]:
    """The words of a question that are worth searching for."""
    return [word for word in re.findall(WORD, text.lower()) if word not in STOP_WORDS]


def keyword_column(text: Column) -> Column:
    """``keywords_in`` for a column of questions."""
    words = F.regexp_extract_all(F.lower(text), F.lit(f"(?U){WORD}"), F.lit(0))
    stops = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words, lambda word: ~F.array_contains(stops, word))


def search(data: DataFrame | Mapping[str, DataFrame], request: Mapping[str, Any] | Search) -> DataFrame:
    """Matching rows with ``_summary``, ``_matched_columns`` and ``_keywords``.

    Every keyword must occur; where no row of a sheet has them all, any keyword will do.
    """
    wanted = Search.of(request)
    if not wanted.query_text.strip() and not wanted.keywords and not wanted.id_filters:
        raise QueryIssue(
            "No search text or id filter was given.",
            ["Which keyword or phrase should be searched for?", "Or which id should the rows have?"],
        )
    sheets = {"default": data} if isinstance(data, DataFrame) else dict(data)
    tag = len(sheets) > 1
    found, issues = [], []
    for name, df in sheets.items():
        virtual = not isinstance(data, DataFrame) or "sheet" not in df.columns
        scope = [
            c for c in (*wanted.id_filters, *wanted.post_filters) if virtual and str(c.column).lower() == "sheet"
        ]
        if not all(sheet_matches(name, c.operator, c.value) for c in scope):
            continue
        try:
            rows = _search_sheet(df, name, wanted, scope)
        except QueryIssue as issue:
            issues += issue.issues
            continue
        if tag and "sheet" not in rows.columns:
            rows = rows.withColumn("sheet", F.lit(name))
        found.append(rows)
    if not found or (issues and not tag):
        schema = "\n".join(f"{n}: {', '.join(df.columns)}" for n, df in sheets.items())
        raise QueryIssue("The search cannot be done.", issues or ["No sheet is in scope."], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


def _tests(
    df: DataFrame, conditions: list[Condition], classes: dict[str, ColumnClass], ids: bool
) -> list[Column]:
    tests, issues = [], []
    for c in conditions:
        name = resolve(df.columns, c.column)
        if name is None:
            issues.append(f"There is no column '{c.column}' to filter by.")
        elif ids and c.value is not None:
            cls = classes[name]
            plain = ColumnClass(cls.dtype, cls.numbers, False, cls.sort_as)
            tests.append(predicate(name, field(name), plain, "=", c.value))
        elif not ids:
            tests.append(
                predicate(
                    name, field(name), classes[name], c.operator, c.value, periods_in_negation=True, day_first=True
                )
            )
    if issues:
        raise QueryIssue("A filter of the search cannot be applied.", issues)
    return tests


def _classes(df: DataFrame, conditions: list[Condition]) -> dict[str, ColumnClass]:
    types = {f.name: f.dataType for f in df.schema.fields}
    asked: dict[str, list[tuple[str, ...]]] = {}
    for c in conditions:
        name = resolve(df.columns, c.column)
        if name:
            asked.setdefault(name, []).append(questions(types[name], canonical_operator(c.operator), c.value))
    return {**{n: typed(t) for n, t in types.items()}, **classify(df, asked)}


def _phrase(columns: list[str], phrase: str) -> Column:
    """A phrase in the row's text, where any white space counts as one blank."""
    if re.search(r"\s\s|[^\S ]", phrase):
        return F.lit(False)
    pattern = r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", part) for part in phrase.split(" "))
    return F.lower(F.concat_ws(" ", *map(field, columns))).rlike(pattern)


def _hits(columns: list[str], words: list[str]) -> list[Column]:
    """One boolean per word, on the raw text: nothing is normalised first.

    A word without blanks can only occur inside one column; a phrase may span columns.
    """
    tests = []
    for word in words:
        inside = [F.coalesce(F.contains(F.lower(field(c)), F.lit(word)), F.lit(False)) for c in columns]
        tests.append(_phrase(columns, word) if re.search(r"\s", word) else reduce(lambda a, b: a | b, inside))
    return tests


def _matching(rows: DataFrame, hits: list[Column], filters: list[Column], wanted: Search, ties: list[str]) -> DataFrame:
    def kept(df: DataFrame, first: list[tuple[Column, bool]] | None = None) -> DataFrame:
        for test in filters:
            df = df.where(test)
        return df if wanted.top_k is None else sort_and_limit(df, first or [], ties, wanted.top_k)

    if not hits:
        return kept(rows)
    some, every = reduce(lambda a, b: a | b, hits), reduce(lambda a, b: a & b, hits)
    if len(hits) == 1:
        return kept(rows.where(some))
    matched = rows.where(some).withColumn("__all", every)
    if wanted.top_k is not None and not filters:
        # Full matches sort first, so the top k alone show whether there are any: one pass.
        top = kept(matched, [(F.col("__all"), True)])
        best = F.max("__all").over(Window.partitionBy(F.lit(1)))
        return top.withColumn("__best", best).where(F.col("__all") == F.col("__best")).drop("__all", "__best")
    # Each task stops at its first full match.
    full = rows.where(every).select(F.lit(1)).limit(1).agg(F.count(F.lit(1)) > 0).scalar()
    return kept(matched.where(F.col("__all") == full).drop("__all"))


def _search_sheet(df: DataFrame, sheet: str, wanted: Search, scope: list[Condition]) -> DataFrame:
    ids = [c for c in wanted.id_filters if c not in scope]
    post = [c for c in wanted.post_filters if c not in scope]
    classes = _classes(df, [*ids, *post])
    rows = reduce(lambda d, test: d.where(test), _tests(df, ids, classes, ids=True), df)

    columns = resolve_all(df.columns, wanted.columns)
    columns = columns or [f.name for f in df.schema.fields if coerce.is_text(f.dataType)]
    if not columns:
        raise QueryIssue("No searchable text column was found.", [f"Sheet '{sheet}' has no text column."])

    key = resolve(df.columns, wanted.row_key) or next((c for c in df.columns if c.lower() == "id"), None)
    ties = [key] if key else []
    words = wanted.words
    found = _matching(rows, _hits(columns, words), _tests(df, post, classes, ids=False), wanted, ties)

    excerpts = []
    for c in columns:
        text = coerce.strip(field(c).cast("string"))
        shown = F.concat(F.lit(f"{c}: "), text)
        excerpts.append(F.when(~F.lower(text).isin(*NO_EXCERPT), shown))
    heading = f"[{sheet}] Matched '{', '.join(words) or wanted.query_text}' — "
    return found.select(
        *map(field, df.columns),
        F.concat(F.lit(heading), F.concat_ws(" | ", *excerpts)).alias("_summary"),
        F.array(*map(F.lit, columns)).alias("_matched_columns"),
        (F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")).alias("_keywords"),
    )
