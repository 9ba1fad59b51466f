"""Turn a request into a DataFrame plan.

``run`` resolves names, looks at the data of columns whose type leaves their meaning open,
reports everything that cannot be done as one ``QueryIssue``, and otherwise returns lazy
DataFrames. The only other jobs started here count the leading digits for exact quantiles and
try regular expressions on an empty text.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field as attribute
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsense.errors import QueryIssue
from gridsense.functions import coerce
from gridsense.functions.grains import grain
from gridsense.functions.names import field, resolve, resolve_all
from gridsense.operators import aggregates, ordering, statistics, summaries
from gridsense.operators.cleaning import united
from gridsense.operators.predicates import canonical_operator, describe_filters, predicate, sheet_matches
from gridsense.plans.classes import NUMBERS, SHARES, TIMES, ColumnClass, classify, questions, readable_text, typed
from gridsense.plans.intent import Condition, Intent

DEFAULT_ROWS = 1000
SHEET = "sheet"
ONLY_SHEET = "default"
WHOLE_COLUMN = ("histogram", "value_counts", "correlation", "profile")
SCALAR = aggregates.NUMERIC_FUNCTIONS + aggregates.ANY_FUNCTIONS
# Aggregate prefixes tried when a name only exists with one.
PREFIXES = ("sum", "avg", "count", "min", "max", "median", "std", "variance")


@dataclass
class Result:
    """A lazy answer. ``parts`` has one DataFrame per kind of output, ``df`` is the first."""

    parts: dict[str, DataFrame]
    issues: list[str] = attribute(default_factory=list)
    filters: str = ""
    measures: list[aggregates.Measure] = attribute(default_factory=list)
    order: list[Column] = attribute(default_factory=list)
    matched: list[DataFrame] = attribute(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return next(iter(self.parts.values()))

    def rows(self, limit: int = DEFAULT_ROWS) -> list[dict[str, Any]]:
        """The first rows on the driver, for display.

        Groups and frequencies are put in order here only: ``df`` itself does not pay for a
        sort that nobody asked for. That there are more rows is added to ``issues``.
        """
        df = self.df.orderBy(*self.order) if self.order else self.df
        found = df.limit(limit + 1).collect()
        said = f"Only the first {limit} rows are shown."
        if len(found) > limit and said not in self.issues:
            self.issues.append(said)
        return [row.asDict(recursive=True) for row in found[:limit]]

    def summary_rows(self) -> DataFrame:
        """The answer with a ``_summary`` sentence per row; a last row tells what failed."""
        kind, df = next(iter(self.parts.items()))
        return summaries.summarise(kind, df, self.measures, self.filters, self.issues)

    def sentences(self) -> DataFrame:
        """``operation, _summary`` over all parts of an answer to several operations."""
        told = [
            summaries.summarise(kind, df, self.measures, self.filters, []).select(
                *(["operation"] if kind == "scalar" else [F.lit(kind).alias("operation")]), "_summary"
            )
            for kind, df in self.parts.items()
            if kind not in ("rows", "grouped")
        ]
        if not told:
            raise QueryIssue("Plain rows and groups have no sentences.")
        return reduce(DataFrame.unionByName, told)

    def no_rows_matched(self) -> bool:
        """Runs a job: whether the filters left no row at all."""
        return all(df.isEmpty() for df in self.matched)


def run(
    data: DataFrame | Mapping[str, DataFrame],
    request: Mapping[str, Any] | Intent,
    classes: Mapping[str, ColumnClass] | None = None,
) -> Result:
    """Answer a request over one table, or over each sheet of a workbook with a ``sheet`` column.

    ``classes`` overrides what would be found by looking at the data, and saves that job.
    """
    intent = Intent.of(request)
    if isinstance(data, DataFrame):
        return _Plan(data, ONLY_SHEET, SHEET not in map(str.lower, data.columns), intent, classes or {}).result()
    return _federated(data, intent, classes or {})


def _federated(sheets: Mapping[str, DataFrame], intent: Intent, classes: Mapping[str, ColumnClass]) -> Result:
    results: dict[str, Result] = {}
    skipped: list[str] = []
    for name, df in sheets.items():
        plan = _Plan(df, name, True, intent, classes)
        if not plan.in_scope():
            continue
        absent = [k.column for k in intent.group_by if resolve(df.columns, k.column) is None]
        if absent:
            skipped.append(f"Sheet '{name}' has no column {', '.join(map(repr, absent))}.")
            continue
        results[name] = plan.result(lenient=True)
    results = {name: r for name, r in results.items() if r.parts}
    if not results:
        schema = "\n".join(_schema_line(name, df) for name, df in sheets.items())
        raise QueryIssue("No sheet can answer this request.", skipped or None, schema)
    parts: dict[str, DataFrame] = {}
    for kind in dict.fromkeys(kind for r in results.values() for kind in r.parts):
        tagged = [
            df if SHEET in map(str.lower, df.columns) else df.select(F.lit(name).alias(SHEET), *map(field, df.columns))
            for name, r in results.items()
            for df in [r.parts[kind]] if kind in r.parts
        ]
        parts[kind] = united(tagged)
    first = next(iter(results.values()))
    issues = skipped + [issue for r in results.values() for issue in r.issues]
    matched = [df for r in results.values() for df in r.matched]
    order = [F.col(SHEET), *first.order] if first.order else []
    return Result(parts, issues, first.filters, first.measures, order, matched)


def _schema_line(name: str, df: DataFrame) -> str:
    return f"{name}: {', '.join(df.columns)}"


class _Plan:
    """One table and one request on the way to a result."""

    def __init__(
        self, df: DataFrame, name: str, virtual_sheet: bool, intent: Intent, classes: Mapping[str, ColumnClass]
    ) -> None:
        self.df = df
        self.name = name
        self.intent = intent
        self.types = {f.name: f.dataType for f in df.schema.fields}
        self.known = {k: v for k, v in classes.items() if k in self.types}
        self.issues: list[str] = []
        self.order: list[Column] = []
        on_sheet = [c for c in intent.filters if str(c.column).lower() == SHEET] if virtual_sheet else []
        self.sheet_filters = on_sheet
        self.filters = [c for c in intent.filters if c not in on_sheet]
        self.columns = resolve_all(df.columns, intent.columns)

    def in_scope(self) -> bool:
        return all(sheet_matches(self.name, c.operator, c.value) for c in self.sheet_filters)

    def refuse(self, summary: str, issues: list[str] | None = None) -> QueryIssue:
        return QueryIssue(summary, issues or self.issues or None, _schema_line(self.name, self.df))

    # -- what the columns contain -------------------------------------------------------

    def _open_questions(self) -> dict[str, list[tuple[str, ...]]]:
        """Per column, what must be known about its cells before the plan can be built."""
        asked: dict[str, list[tuple[str, ...]]] = {}

        def ask(wanted: str | None, *questions: str, text_only: bool = False) -> None:
            name = resolve(self.df.columns, wanted)
            if name and name not in self.known and (not text_only or coerce.is_text(self.types[name])):
                asked.setdefault(name, []).append(questions)

        for c in [*self.filters, *self.intent.having]:
            name = resolve(self.df.columns, c.column)
            if name:
                ask(name, *questions(self.types[name], canonical_operator(c.operator), c.value))
        for key in self.intent.sort:
            ask(key.column, SHARES, text_only=True)
        for key in self.intent.group_by:
            if key.grain:
                ask(key.column, TIMES)
        targets = [*self.columns, *(a.column for a in self.intent.aggregations)]
        if {*aggregates.NUMERIC_FUNCTIONS, "correlation", "histogram"} & set(self.intent.operations):
            for name in targets:
                ask(name, NUMBERS, text_only=True)
        return asked

    def _learn(self) -> None:
        self.classes = {n: typed(t) for n, t in self.types.items()}
        self.classes.update(classify(self.df, self._open_questions()))
        self.classes.update(self.known)

    # -- filters ------------------------------------------------------------------------

    def _test(self, condition: Condition, columns: list[str], classes: dict[str, ColumnClass]) -> Column | None:
        name = self._with_prefix(columns, condition.column)
        if name is None:
            self.issues.append(f"There is no column '{condition.column}' to filter by.")
            return None
        try:
            return predicate(
                name, field(name), classes[name], condition.operator, condition.value, regex=self.intent.regex
            )
        except QueryIssue as issue:
            self.issues.append(issue.summary)
            return None

    def _with_prefix(self, columns: list[str], wanted: str) -> str | None:
        tried = [wanted, *(f"{p}_{wanted}" for p in (*self.intent.operations, *PREFIXES))]
        return next((hit for hit in (resolve(columns, name) for name in tried) if hit), None)

    def _filtered(self) -> DataFrame:
        tests = []
        for condition in self.filters:
            if resolve(self.df.columns, condition.column) is None:
                self.issues.append(f"There is no column '{condition.column}' to filter by.")
            else:
                tests.append(self._test(condition, self.df.columns, self.classes))
        if self.issues:
            raise self.refuse("Some filters do not fit this table.")
        return reduce(lambda df, test: df.where(test), tests, self.df)

    def _after(self, df: DataFrame, classes: dict[str, ColumnClass]) -> DataFrame:
        for condition in self.intent.having:
            test = self._test(condition, df.columns, classes)
            if test is None:
                raise self.refuse("Some conditions do not fit the result.")
            df = df.where(test)
        return df

    # -- the four shapes of result ------------------------------------------------------

    def result(self, lenient: bool = False) -> Result:
        if not self.in_scope():
            raise self.refuse("No sheet matches the sheet filter.")
        self._learn()
        rows = self._filtered()
        described = describe_filters([(c.column, c.operator, c.value) for c in self.intent.filters])
        measures: list[aggregates.Measure] = []
        if self.intent.group_by:
            parts = {"grouped": self._grouped(rows)}
        elif set(self.intent.operations) <= {"none", "filter"}:
            parts = {"rows": self._rows(rows)}
        else:
            parts, measures = self._computed(rows, lenient)
        if not lenient:
            self._report_unknown([*self.intent.columns, *(a.column for a in self.intent.aggregations if a.column)])
        if next(iter(parts)) == "value_counts":
            self.order = [F.col("column"), F.desc("count"), F.col("value")]
        elif next(iter(parts)) == "histogram":
            self.order = [F.col("bin")]
        return Result(parts, self.issues, described, measures, self.order, [rows])

    def _sorted(self, df: DataFrame, classes: dict[str, ColumnClass], ties: list[str]) -> DataFrame:
        """Order by the request (nulls last), ties in a fixed order, then keep the limit."""
        keys = []
        for key in self.intent.sort:
            name = self._with_prefix(df.columns, key.column)
            if name is None:
                self.issues.append(f"There is no column '{key.column}' to sort by; the sort goes without it.")
            else:
                keys.append((classes[name].sort_key(field(name)), key.descending))
        return ordering.sort_and_limit(df, keys, ties, self.intent.limit)

    def _row_ties(self, df: DataFrame) -> list[str]:
        key = resolve(df.columns, self.intent.row_key) or next((c for c in df.columns if c.lower() == "id"), None)
        return [key] if key else []

    def _rows(self, rows: DataFrame) -> DataFrame:
        if self.intent.columns and not self.columns:
            raise self.refuse(f"None of the columns {list(self.intent.columns)} exist.")
        rows = self._after(rows, self.classes)
        rows = self._sorted(rows, self.classes, self._row_ties(rows))
        return rows.select(*map(field, self.columns)) if self.columns else rows

    def _grouped(self, rows: DataFrame) -> DataFrame:
        keys, labels, classes = [], {}, {}
        for at, wanted in enumerate(self.intent.group_by):
            name = resolve(self.df.columns, wanted.column)
            if name is None:
                self.issues.append(f"There is no column '{wanted.column}' to group by.")
                continue
            cls, key = self.classes[name], f"__key{at}"
            if wanted.grain is None:
                value, label, output, output_class = field(name), F.col(key), name, cls
            elif cls.times:
                step = grain(wanted.grain)
                value = step.key(cls.time(field(name)).cast("date"))
                label, output = step.label(F.col(key)), f"{name}_{wanted.grain}"
                dated = wanted.grain not in ("year", "quarter", "month_name", "week", "day_name")
                output_class = readable_text(numbers=wanted.grain == "year", times=dated)
            else:
                self.issues.append(f"Column '{name}' holds no dates to group by {wanted.grain}.")
                continue
            if output in labels:
                continue
            source_tells = wanted.grain is None or coerce.is_time(cls.dtype)
            rows = rows.where((field(name) if source_tells else value).isNotNull()).withColumn(key, value)
            if coerce.is_float(cls.dtype):
                rows = rows.where(~F.isnan(field(name)))
            keys.append(key)
            labels[output], classes[output] = label, output_class
        if self.issues:
            raise self.refuse("The grouping cannot be done.")
        measures = self._grouped_measures(list(labels))
        grouped = aggregates.aggregate(rows, keys, measures, self.classes)
        shown = grouped.select(
            *(label.alias(name) for name, label in labels.items()), *(field(m.alias) for m in measures)
        )
        classes.update({f.name: typed(f.dataType) for f in shown.schema.fields if f.name not in classes})
        kept = self._after(shown, classes)
        if not self.intent.sort and self.intent.limit is None:
            self.order = [field(name).asc_nulls_last() for name in labels]
            return kept
        return self._sorted(kept, classes, list(labels))

    def _grouped_measures(self, keys: list[str]) -> list[aggregates.Measure]:
        grouped = [resolve(self.df.columns, k.column) for k in self.intent.group_by]
        pairs = [(a.function, resolve(self.df.columns, a.column)) for a in self.intent.aggregations]
        whole = [("count", None)] * any(a.function == "count" and not a.column for a in self.intent.aggregations)
        pairs = whole + [(fn, c) for fn, c in pairs if fn in SCALAR and c and c not in grouped]
        if len(pairs) < 2 and (self.intent.named or not pairs):
            columns = [c for c in self.columns if c not in grouped]
            operations = self.intent.named or ("count",)
            refused = [op for op in operations if op in WHOLE_COLUMN]
            if refused:
                raise self.refuse(f"'{refused[0]}' describes a whole column and has no meaning per group.")
            fallback = [c for _, c in pairs if c]
            crossed = [(op, c) for op in operations if op != "count" for c in columns or fallback]
            if not crossed and any(op != "count" for op in operations):
                raise self.refuse(f"No column to compute {', '.join(operations)} over.")
            pairs = [("count", None)] * ("count" in operations) + crossed
        usable = [(fn, c) for fn, c in pairs if self._computable(fn, c)]
        if not usable:
            raise self.refuse("There are no numbers in any of the columns asked for.")
        return aggregates.named_measures(usable, self._share(usable), self.intent.approximate)

    def _share(self, pairs: list[tuple[str, str | None]]) -> float:
        wanted = any(function == "quantile" for function, _ in pairs)
        return aggregates.quantile_share(self.intent.percentile) if wanted else 0.5

    def _computable(self, function: str, column: str | None) -> bool:
        if column is None or function not in aggregates.NUMERIC_FUNCTIONS or self.classes[column].numbers:
            return True
        self.issues.append(f"{function}: column '{column}' holds no numbers")
        return False

    def _computed(self, rows: DataFrame, lenient: bool) -> tuple[dict[str, DataFrame], list[aggregates.Measure]]:
        operations = [op for op in self.intent.operations if op not in ("none", "filter")]
        targets = [resolve(self.df.columns, a.column) for a in self.intent.aggregations]
        columns = self.columns or [c for c in dict.fromkeys(targets) if c]
        parts: dict[str, DataFrame] = {}

        specified = self._specified(lenient)
        peak = operations[0] if operations in (["max"], ["min"]) and len(columns) > 1 and not specified else None
        if peak:
            metric = next((c for c in columns if self._computable(peak, c)), None)
            if metric is not None:
                self.issues = [i for i in self.issues if not i.startswith(f"{peak}: ")]
                return {peak: self._peak_rows(rows, peak, metric, columns)}, []

        pairs: list[tuple[str, str | None]] = [(fn, c) for fn, c in specified if c not in self.types or self._computable(fn, c)]
        named = {fn for fn, _ in specified}
        for op in operations:
            if op in named:
                continue
            if op in WHOLE_COLUMN:
                part = self._whole_column(rows, op, columns)
                if part is not None:
                    parts[op] = part
            elif op == "count":
                pairs.append(("count", None))
            else:
                if lenient:
                    pairs += [(op, c) for c in self._as_requested() if c not in self.types or self._computable(op, c)]
                else:
                    pairs += [(op, c) for c in columns if self._computable(op, c)]
                if not columns:
                    self.issues.append(f"{op}: the request names no column of this table")

        measures = aggregates.named_measures(pairs, self._share(pairs), self.intent.approximate)
        if measures:
            present = [m for m in measures if m.column is None or m.column in self.types]
            scalar = aggregates.aggregate(rows, [], present, self.classes) if present else rows.agg(
                F.count(F.lit(1)).alias("__rows")
            )
            absent = [F.lit(None).cast("double").alias(m.alias) for m in measures if m not in present]
            scalar = scalar.select(*(field(m.alias) for m in present), *absent)
            parts = {"scalar": scalar, **parts}
        if not parts:
            raise self.refuse("Nothing in this request could be computed.")
        return parts, measures

    def _report_unknown(self, names: list[str]) -> None:
        for name in dict.fromkeys(names):
            if resolve(self.df.columns, name) is None:
                self.issues.append(f"There is no column '{name}'; the result goes without it.")

    def _specified(self, lenient: bool) -> list[tuple[str, str]]:
        """Aggregations given as pairs of function and column; empty if the request means every operation over every column."""
        pairs = [(a.function, resolve(self.df.columns, a.column) or (a.column if lenient else None)) for a in self.intent.aggregations]
        pairs = [(fn, c) for fn, c in pairs if fn in SCALAR and c]
        return pairs if pairs and (len(pairs) > 1 or not self.intent.named) else []

    def _as_requested(self) -> list[str]:
        """Requested columns, those this sheet lacks included: they yield null here."""
        for wanted in self.intent.columns:
            if resolve(self.df.columns, wanted) is None:
                self.issues.append(f"Sheet '{self.name}' has no column '{wanted}'.")
        return list(dict.fromkeys(resolve(self.df.columns, c) or c for c in self.intent.columns))

    def _peak_rows(self, rows: DataFrame, op: str, metric: str, columns: list[str]) -> DataFrame:
        found = statistics.extremes(rows, metric, self.classes[metric], largest=op == "max")
        found = self._sorted(found, self.classes, self._row_ties(found))
        return found.select(*(field(c) for c in columns if c != metric), field(metric))

    def _whole_column(self, rows: DataFrame, op: str, columns: list[str]) -> DataFrame | None:
        if op == "profile":
            return statistics.describe(rows, columns, self.intent.approximate)
        if not columns:
            self.issues.append(f"{op}: the request names no column of this table")
            return None
        if op == "value_counts":
            return statistics.value_counts(rows, columns, self.classes, self.intent.limit if self.intent.top_k is None else self.intent.top_k)
        if op == "histogram":
            if not self._computable("avg", columns[0]):
                return None
            return statistics.histogram(rows, columns[0], self.classes[columns[0]], self.intent.bins)
        numeric = [c for c in columns if self._computable("avg", c)]
        if len(numeric) < 2:
            self.issues.append("correlation: at least two numeric columns are required")
            return None
        return statistics.correlations(rows, numeric, self.classes)
