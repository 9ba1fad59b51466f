"""What the operators share: tables, results settled in the shared folder, Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.functions.names import field
from gridsense.sources.storage import scratch_path

BATCH_BYTES = 4_000_000
FILTER_BITS = 1 << 25


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps then start from files that outlive any executor, and columns such as row numbers keep
    the values that were written.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sifted(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Most of the rows that a join with ``wanted`` by ``keys`` would drop are dropped, without a shuffle; none that it keeps.

    What is broadcast is a filter of ``FILTER_BITS`` bits, whatever the tables; the more of it is set, the more rows pass.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS)).alias("spot")
    marks = wanted.select(spot).groupBy(F.expr("shiftright(spot, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(spot & 63)))").alias("mark"))
    spotted = rows.withColumn("spot", spot).withColumn("word", F.expr("shiftright(spot, 6)"))
    return spotted.join(F.broadcast(marks), "word").where("(shiftrightunsigned(mark, int(spot & 63)) & 1L) = 1").select(*rows.columns)


def columns(df: DataFrame, **named: str) -> list[Column]:
    """The named columns under the operator's own names; all other columns stay behind, so none can clash."""
    return [field(source).alias(target) for target, source in named.items()]


def packed(df: DataFrame, **named: str) -> DataFrame:
    """Each whole row as the struct ``row``, beside the named columns; so what is added to it cannot clash with columns of the input."""
    return df.select(F.struct(*map(field, df.columns)).alias("row"), *columns(df, **named))


def unpacked(df: DataFrame, names: list[str], **changed: Column) -> DataFrame:
    """The columns that ``packed`` put away, ``changed`` ones anew."""
    return df.select(*(changed.get(name, F.col("row").getField(name)).alias(name) for name in names))


def text_of(name: str = "text") -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], by: str = "text", size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``size`` bytes of the column ``by``, and one row at least."""
    for batch in batches:
        widths = pc.binary_length(batch.column(by)).fill_null(0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, width in enumerate(widths):
            if held and held + width > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(width)
        if start < batch.num_rows:
            yield batch.slice(start)
