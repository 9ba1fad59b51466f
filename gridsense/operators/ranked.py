"""Exact quantiles and modes whose memory does not grow with the largest group.

``percentile`` keeps every distinct value of a group in one task. Here no values are sorted or gathered: the wanted rank is
narrowed down by leading digits. Each level counts rows per key and digit map-side, so that a shuffle holds no more than the
digits that occur; the digit in which the rank falls is kept, and the next level counts only rows below it. The last level's
digit is the value itself, so the answer is exact for any values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsense.functions.names import field

VALUE, COPIES = "__value", "__copies"
FLOOR, CEILING, PART = "__floor", "__ceiling", "__part"
DIGITS = ("__leading", "__middle", VALUE)
#: Up to so many keys, what is kept of a level (two rows a key at most) is sent to all tasks; beyond, it is joined by a shuffle.
MOST_BROADCAST_KEYS = 10_000
#: The middle digit is passed over where the leading one holds no more rows than this, by their count; the values are then few.
FEW_BELOW = 1_000_000
#: Times this, minus the same less the value, leaves the value's leading 12 of 53 bits.
_COARSE = 2.0**41 + 1


def _values(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    return df.select(*map(field, keys), value.alias(VALUE))


def with_digits(values: DataFrame) -> DataFrame:
    """Add the digits of a double: its leading 12 bits, the next 24, and the value itself.

    Rounding never changes the order of two values, and below one leading digit neither does taking it away, so digits ascend as
    values do. Where the first digits cannot tell values apart (beyond the range of floats) the value itself does. Both zeros are one.
    """
    rounded = values.withColumn("__rounded", F.col(VALUE).cast("float").cast("double"))
    near, scaled = F.col("__rounded"), F.col("__rounded") * F.lit(_COARSE)
    leading = F.when(F.abs(near) == float("inf"), near).otherwise(scaled - (scaled - near))
    middle = F.when(F.abs(F.col(DIGITS[0])) == float("inf"), F.lit(0.0)).otherwise((F.col(VALUE) - F.col(DIGITS[0])).cast("float").cast("double"))
    return rounded.withColumn(DIGITS[0], leading).withColumn(DIGITS[1], middle).drop("__rounded")


def _kept(counted: DataFrame, within: list[str], digit: str) -> DataFrame:
    """Of the digits counted below one prefix, those that hold a wanted rank, with the rank among their own rows."""
    upto = Window.partitionBy(*map(field, within)).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("__before", F.coalesce(F.sum(COPIES).over(upto), F.lit(0)))

    def inside(rank: str) -> Column:
        own = F.col(rank) - F.col("__before")
        return F.when((own >= 0) & (own < F.col(COPIES)), own)

    found = ranked.select(
        *map(field, within), digit, inside(FLOOR).alias("__in_floor"), inside(CEILING).alias("__in_ceiling"), PART, COPIES
    ).withColumnsRenamed({"__in_floor": FLOOR, "__in_ceiling": CEILING})
    return found.where(F.col(FLOOR).isNotNull() | F.col(CEILING).isNotNull())


def _first_level(values: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Kept digits of each key, and a row without a digit for a key without values."""
    counted = values.groupBy(*map(field, keys), DIGITS[0]).agg(F.count(VALUE).alias(COPIES))
    whole = counted.withColumn("__rows", F.sum(COPIES).over(Window.partitionBy(*map(field, keys))))
    place = (F.col("__rows") - 1) * F.lit(share)
    placed = whole.select("*", F.floor(place).alias(FLOOR), F.ceil(place).alias(CEILING), (place - F.floor(place)).alias(PART))
    nothing = placed.where("__rows = 0").select(*map(field, keys), DIGITS[0], FLOOR, CEILING, PART, COPIES)
    return _kept(placed.where("__rows > 0"), keys, DIGITS[0]).unionByName(nothing)


def _next_level(values: DataFrame, kept: DataFrame, keys: list[str], known: tuple[str, ...], digit: str) -> DataFrame:
    """Count the rows below the kept digits by the next one."""
    within = [*keys, *known]
    counted = values.join(kept.drop(COPIES), within).groupBy(*map(field, within), FLOOR, CEILING, PART, digit).agg(F.count("*").alias(COPIES))
    return _kept(counted, within, digit)


def quantile(df: DataFrame, keys: list[str], value: Column, share: float, alias: str) -> DataFrame:
    """One row per key with the linearly interpolated quantile, null for a key without values.

    The answer is exact, infinities included, whatever the values; between equal neighbours no arithmetic is done. The leading digits are
    counted at once: this job tells how many keys there are and how many rows lie below the digits kept, so what is sent to all
    tasks is known to be small, and a level that would not narrow anything down is left out.
    """
    given = _values(df, keys, value.cast("double"))
    values = with_digits(given)
    first = _first_level(values, keys, share)
    rows = first.take(2 * MOST_BROADCAST_KEYS + 1)
    few = len(rows) <= 2 * MOST_BROADCAST_KEYS
    if few:
        first = df.sparkSession.createDataFrame(rows, first.schema)
    middle = [] if few and all(row[COPIES] <= FEW_BELOW for row in rows) else [DIGITS[1]]
    kept, known = first, DIGITS[:1]
    for digit in [*middle, VALUE]:
        kept = _next_level(values, F.broadcast(kept) if few else kept, keys, known, digit)
        known = (*known, digit)
    empty = first.where(F.col(DIGITS[0]).isNull()).withColumn(VALUE, F.lit(None).cast("double"))
    ends = [*map(field, keys), VALUE, FLOOR, CEILING, PART]
    ends = kept.select(*ends).unionByName(empty.select(*ends)).groupBy(*map(field, keys)).agg(
        F.max(F.when(F.col(FLOOR).isNotNull(), F.col(VALUE))).alias("__a"),
        F.max(F.when(F.col(CEILING).isNotNull(), F.col(VALUE))).alias("__b"),
        F.max(PART).alias(PART),
    )
    a, b = F.col("__a"), F.col("__b")
    between = F.when(a == b, a).otherwise(a + (b - a) * F.col(PART))
    return ends.select(*map(field, keys), between.alias(alias))


def mode(df: DataFrame, keys: list[str], value: Column, alias: str) -> DataFrame:
    """One row per key with its most frequent value in the column's own type, the smallest one on ties."""
    counted = _values(df, keys, value).groupBy(*map(field, keys), VALUE).agg(F.count(F.lit(1)).alias(COPIES))
    candidate = F.when(F.col(VALUE).isNotNull(), F.struct((-F.col(COPIES)).alias("rarity"), F.col(VALUE)))
    return counted.groupBy(*map(field, keys)).agg(F.min(candidate).getField(VALUE).alias(alias))
