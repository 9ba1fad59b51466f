"""Delimited text files: delimiter choice, quoting, missing-value tokens, type inference."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.errors import QueryIssue
from gridsense.functions.literals import NUMBER_PATTERN
from gridsense.functions.names import field
from gridsense.sources import records

DELIMITERS = (",", ";", "\t", "|")
EXTRA = "__extra"
# Other spellings of the character sets that the reader accepts.
CHARSETS = {"latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "ascii": "US-ASCII", "utf8": "UTF-8", "utf-8-sig": "UTF-8"}
WHOLE_PATTERN = r"^\s*[+-]?\d+\s*$"
#: Whole numbers that may need more than 18 digits; shorter ones are longs without a try.
WIDE_PATTERN = r"^\s*[+-]?\d{19,}\s*$"

# Cells read as missing.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Spellings of truth values.
TRUTH = ("True", "TRUE", "true", "False", "FALSE", "false")


def _lines(spark: SparkSession, path: str, charset: str = "UTF-8") -> DataFrame:
    """Raw lines (column ``value``). Only delimiters and quotes matter, so any ASCII-like set will do."""
    if not _is_wide(charset):
        return spark.read.text(path)
    raw = spark.read.csv(path, sep="\x01", quote="", encoding=charset, multiLine=True)
    return raw.select(field(raw.columns[0]).alias("value"))


def _is_wide(charset: str) -> bool:
    return charset.upper().startswith(("UTF-16", "UTF-32"))


def _first_line(lines: DataFrame) -> str:
    found = lines.where(F.col("value").rlike(r"\S")).limit(1).collect()
    return found[0]["value"] if found else ""


def sniff_delimiter(spark: SparkSession, path: str, charset: str = "UTF-8") -> str:
    """The candidate that occurs as often in most lines of all files as in the first one; a comma if none occurs in that.

    Quoted cells are left out. One parallel aggregate counts the lines; on equal shares the mark that occurs more often wins.
    """
    lines = _lines(spark, path, charset)
    first = re.sub(r'"[^"]*"', "", _first_line(lines))
    wanted = {mark: first.count(mark) for mark in DELIMITERS if mark in first}
    if len(wanted) < 2:
        return next(iter(wanted), DELIMITERS[0])
    bare = lines.where(F.col("value").rlike(r"\S")).select(F.regexp_replace("value", r'"[^"]*"', "").alias("bare"))
    agreeing = [F.count_if(F.length("bare") - F.length(F.replace("bare", F.lit(m))) == n).alias(f"m{i}") for i, (m, n) in enumerate(wanted.items())]
    found = bare.agg(*agreeing).first()
    return max(enumerate(wanted.items()), key=lambda x: (found[x[0]], x[1][1], -x[0]))[1][0]


def has_multiline_cells(spark: SparkSession, path: str) -> bool:
    """Whether any line has an odd number of quotes, as the first line of a multi-line cell must.

    If none has, lines are records. The look is itself parallel and stops at the first hit.
    """
    lines = spark.read.text(path)
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).select(F.lit(1)).limit(1).isEmpty()


def header_names(cells: list[str | None]) -> list[str]:
    """Column names from the cells of a header: ``_c1`` for the second if it is empty, ``a``, ``a.1``, ``a.2`` for repeated ones."""
    found: list[str] = []
    taken: set[str] = set()
    for at, cell in enumerate(cells):
        base = name = cell if cell else f"_c{at}"
        times = 0
        while name.lower() in taken:
            times += 1
            name = f"{base}.{times}"
        found.append(name)
        taken.add(name.lower())
    return found


def _cells(spark: SparkSession, path: str, sep: str, charset: str, multi_line: bool) -> DataFrame:
    """All records below the header as text cells, and ``EXTRA``, which holds a cell too many if there is one."""
    form = {"sep": sep, "quote": '"', "escape": '"', "encoding": charset}
    first = spark.read.csv(path, **form, multiLine=True).first()
    if first is None:
        return spark.createDataFrame([], f"{EXTRA} string")
    names = header_names([cell.lstrip("\ufeff") if cell else cell for cell in first])
    places = [f"c{at}" for at in range(len(names))]
    schema = ", ".join(f"{place} string" for place in [*places, EXTRA])
    if multi_line and charset in records.DECODED:
        below = records.records(spark, path, sep, charset).where((F.col("block") > 0) | (F.col("at") > 0))
        options = {"sep": sep, "quote": '"', "escape": '"'}
        raw = below.select(F.from_csv("record", schema, options).alias("cells")).select("cells.*")
    else:
        raw = spark.read.schema(schema).csv(path, header=True, multiLine=multi_line, **form)
    return raw.select(*(field(place).alias(name) for place, name in zip(places, names, strict=True)), EXTRA)


def blank_tokens(df: DataFrame, tokens: tuple[str, ...] = NA_TOKENS) -> DataFrame:
    """Missing-value tokens in text columns become null."""
    text = {f.name for f in df.schema.fields if f.dataType.simpleString() == "string"}
    return df.select(
        *(F.when(~field(c).isin(*tokens), field(c)).alias(c) if c in text else field(c) for c in df.columns)
    )


def _typed(column: Column, filled: int, whole: int, past: int, long: int, wide: int, numbers: int, truths: int, rows: int) -> Column:
    if filled == 0:
        return column.cast("double") if rows else column
    if filled == whole:  # ids keep every digit
        return F.trim(column).cast("long" if long == past else "decimal(38,0)" if wide == past else "string")
    if filled == numbers:
        return F.trim(column).cast("double")
    if filled == truths:
        return column.cast("boolean")
    return column


def infer_types(df: DataFrame, empty: str | None = None) -> DataFrame:
    """Text columns whose every filled cell is a whole number, number or truth value become that.

    One aggregate decides for all columns. Dates stay text. A column ``empty`` must hold nothing.
    """
    if not df.columns:
        return df
    measured = [F.count(F.lit(1)).alias("rows")]
    for at, name in enumerate(df.columns):
        c = field(name)
        measured += [
            F.count(c).alias(f"filled{at}"),
            F.count_if(c.rlike(WHOLE_PATTERN)).alias(f"whole{at}"),
            F.count_if(c.rlike(WIDE_PATTERN)).alias(f"past{at}"),
            F.count_if(c.rlike(WIDE_PATTERN) & F.trim(c).try_cast("long").isNotNull()).alias(f"long{at}"),
            F.count_if(c.rlike(WIDE_PATTERN) & F.trim(c).try_cast("decimal(38,0)").isNotNull()).alias(f"wide{at}"),
            F.count_if(c.rlike(NUMBER_PATTERN)).alias(f"numbers{at}"),
            F.count_if(c.isin(*TRUTH)).alias(f"truths{at}"),
        ]
    seen = df.agg(*measured).first()
    filled = seen[f"filled{df.columns.index(empty)}"] if empty else 0
    if filled:
        raise QueryIssue(f"{filled} of {seen['rows']} records have more cells than the header.")
    return df.select(
        *(
            _typed(
                field(name), *(seen[f"{kind}{at}"] for kind in ("filled", "whole", "past", "long", "wide", "numbers", "truths")), seen["rows"]
            ).alias(name)
            for at, name in enumerate(df.columns)
        )
    )


def read_csv(
    spark: SparkSession,
    path: str,
    *,
    sep: str | None = None,
    encoding: str = "UTF-8",
    multi_line: bool | None = None,
    tokens: tuple[str, ...] = NA_TOKENS,
    types: Mapping[str, str] | None = None,
    overlong: str = "refuse",
) -> DataFrame:
    """A delimited file or folder with a header row.

    ``types`` names column types where they are known; with it no scan is spent on inference, columns it does not mention stay text, and
    cells that do not fit become null.

    Unless given, the delimiter is sniffed, and cells are looked for that hold line ends. Files stay splittable in any case (``records``),
    but for wide character sets. Repeated names in the header become ``a``, ``a.1``. A record with fewer cells than the header ends in
    nulls; records with more are refused with their number, unless ``overlong`` is ``"cut"``, which drops the cells too many.
    """
    charset = CHARSETS.get(encoding.lower(), encoding)
    if sep is None:
        sep = sniff_delimiter(spark, path, charset)
    if multi_line is None:
        multi_line = _is_wide(charset) or has_multiline_cells(spark, path)
    cells = blank_tokens(_cells(spark, path, sep, charset, multi_line), tokens)
    if types is not None:
        if overlong == "refuse":
            told = F.raise_error(F.lit("A record has more cells than the header."))
            cells = cells.where(F.when(field(EXTRA).isNotNull(), told.cast("boolean")).otherwise(True))
        return cells.select(
            *(F.trim(field(c)).try_cast(types[c]).alias(c) if c in types else field(c) for c in cells.columns if c != EXTRA)
        )
    return infer_types(cells, None if overlong == "cut" else EXTRA).drop(EXTRA)
