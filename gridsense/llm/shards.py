"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in an order that their content decides. The permutation turns a number into a
position; position modulo shards is the shard, position divided by shards the slot. Shard sizes thus differ
by one at most, slots have no gaps, and both can be computed, in either direction, without looking at data.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsense.llm.base import columns, settle, text_of

SHARDS = 16
SEED = 20
ROUNDS = 4
BUCKETS = 4096
#: The modulus is prime, so that round values stay in 31 bits and products in 63.
PRIME, FACTOR = 2147483647, 48271


def _whole(value: Column | int) -> Column:
    return (F.lit(value) if isinstance(value, int) else value).cast("long")


def _mixed(half: Column, turn: Column, seed: int) -> Column:
    """A value below ``PRIME`` that depends on all bits of ``half``, the round and the seed."""
    first = F.pmod(F.pmod(half, F.lit(PRIME)) * FACTOR + (turn + 1) * 69621 + F.lit(seed), F.lit(PRIME).cast("long"))
    squared = F.pmod(first * first + half, F.lit(PRIME).cast("long"))
    return F.pmod(squared * FACTOR + first, F.lit(PRIME).cast("long"))


def _side(rows: Column) -> Column:
    """The smallest side of a square that holds all row numbers."""
    root = F.floor(F.sqrt(F.greatest(rows, F.lit(1)).cast("double"))).cast("long")
    return F.when(root * root >= rows, root).when((root + 1) * (root + 1) >= rows, root + 1).otherwise(root + 2)


def _divided(number: Column, by: Column) -> Column:
    return F.call_function("div", number, by).cast("long")


def _turns(number: Column, side: Column, seed: int, back: bool) -> Column:
    """The permutation of the square: ``ROUNDS`` Feistel rounds that add modulo the side."""

    def forth(state: Column, turn: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.struct(
            right.alias("left"), F.pmod(left + F.pmod(_mixed(right, turn, seed), side), side).alias("right")
        )

    def undo(state: Column, turn: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.struct(
            F.pmod(right - F.pmod(_mixed(left, turn, seed), side) + side, side).alias("left"), left.alias("right")
        )

    left = _divided(number, side)
    start = F.struct(left.alias("left"), (number - left * side).alias("right"))
    order = F.sequence(_whole(ROUNDS - 1), _whole(0)) if back else F.sequence(_whole(0), _whole(ROUNDS - 1))
    return F.aggregate(order, start, undo if back else forth, lambda s: s["left"] * side + s["right"])


def _walked(number: Column, rows: Column, seed: int, back: bool) -> Column:
    """Apply the permutation until the value is a row number again.

    Values outside visited on the way all differ, so there are at most side² - rows of them: the walk is
    bounded, and about 2/sqrt(rows) of all rows walk at all.
    """
    side = _side(rows)
    once = _turns(number, side, seed, back)
    more = F.aggregate(
        F.sequence(_whole(1), F.greatest(side * side - rows, _whole(1))),
        once,
        lambda at, _: F.when(at < rows, at).otherwise(_turns(at, side, seed, back)),
    )
    return F.when(once < rows, once).otherwise(more)


def position_of(number: Column, rows: Column, seed: int = SEED) -> Column:
    """Where row ``number`` of ``rows`` stands after the shuffle."""
    return _walked(_whole(number), _whole(rows), seed, back=False)


def number_at(position: Column, rows: Column, seed: int = SEED) -> Column:
    """The row number at a position: the inverse of ``position_of``."""
    return _walked(_whole(position), _whole(rows), seed, back=True)


def numbered(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """``(key, size, text_crc32, number, rows)``: global row numbers, an arbitrary but reproducible order.

    Equal rows are counted before any shuffle and take neighbouring numbers, so a row that is a third of
    the table is one row here. The rest is spread by hash over ``buckets``; one row per bucket holds where
    its numbers begin.
    """
    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(
        F.col("key").cast("long"),
        (F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    counted = rows.groupBy("key", "size", "text_crc32").agg(F.count("*").alias("n"))
    bucket = F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets)).alias("bucket")
    kept = settle(counted.select("*", bucket), "row-counts")
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = kept.groupBy("bucket").agg(F.sum("n").alias("held"))
    begins = totals.select(
        "bucket",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("begins"),
        F.sum("held").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("rows"),
    )
    within = Window.partitionBy("bucket").orderBy("key", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = kept.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(begins), "bucket")
    first = F.col("begins") + F.col("own")
    return placed.select(
        "key", "size", "text_crc32", "rows", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("number")
    )


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, buckets: int = BUCKETS, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """One row per document: key, size, text_crc32, law (``rows``), shard, slot, grown_shard (null), number.

    Null texts have size 1 and the checksum of the empty text; a null key is a value like others; equal
    rows are documents of their own; no rows give no rows. Other columns are not looked at.
    """
    position = position_of(F.col("number"), F.col("rows"), seed)
    rows = numbered(docs, key, text, buckets).withColumn("position", position)
    return rows.select(
        "key",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.pmod("position", F.lit(shards)).cast("int").alias("shard"),
        _divided(F.col("position"), F.lit(shards)).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "number",
    )
