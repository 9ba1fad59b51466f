"""Cutting long text cells into labelled pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsense.functions import coerce
from gridsense.functions.names import field

# Piece length, cells that hold no text, and the mark that separates id parts.
PIECE_LENGTH = 500
NO_TEXT = ("", "n/a")
SEPARATOR, SAFE = "|", "_"


def pieces(text: Column, length: int = PIECE_LENGTH) -> Column:
    """Consecutive pieces of at most ``length`` characters, in one linear walk over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{length}}}"), F.lit(0))


def _safe(part: Column) -> Column:
    return F.translate(part.cast("string"), SEPARATOR, SAFE)


def chunk_text(
    df: DataFrame, columns: list[str], row_id: str, sheet: str | None = None, length: int = PIECE_LENGTH
) -> DataFrame:
    """``chunk_id, sheet, row, column, chunk_index, text, label`` for every piece of every cell.

    Rows are only widened, never shuffled.
    """
    cells = F.array(
        *(F.struct(F.lit(c).alias("column"), coerce.strip(field(c)).alias("value")) for c in columns)
    )
    filled = (
        df.select(field(row_id).cast("string").alias("row"), F.inline(cells))
        .where(F.col("value").isNotNull() & ~F.lower("value").isin(*NO_TEXT))
        .select("row", "column", F.posexplode(pieces(F.col("value"), length)).alias("chunk_index", "text"))
    )
    parts = [F.lit(f"sheet:{sheet.replace(SEPARATOR, SAFE)}")] if sheet else []
    parts += [
        F.concat(F.lit("row:"), _safe(F.col("row"))),
        F.concat(F.lit("col:"), _safe(F.col("column"))),
        F.concat(F.lit("chunk:"), F.col("chunk_index").cast("string")),
    ]
    prefix = f"Sheet {sheet} | " if sheet else ""
    return filled.withColumn("chunk_id", F.concat_ws(SEPARATOR, *parts)).select(
        "chunk_id",
        F.lit(sheet).cast("string").alias("sheet"),
        "row",
        "column",
        "chunk_index",
        "text",
        F.concat(
            F.lit(f"{prefix}Chunk "), F.col("chunk_id"), F.lit(" | Row "), F.col("row"), F.lit(" | "),
            F.col("column"), F.lit(": "), F.col("text"),
        ).alias("label"),
    )
