"""Links among rows that share buckets, found with star-shaped candidate edges.

In each bucket one row is the centre and all others are compared with it: as many pairs as rows. Centres are the rows that share
buckets with most others, so the text that copies were made from comes before its copies. Where that leaves a bucket in several
components, its rows are dealt into blocks of bounded size. Within a block rows are compared exactly, by their whole traits, but never
two rows that links hold together already, so a block gives fewer edges than it has rows. One row of each component then meets the
others in blocks again, as long as a bucket has more components than a block has rows. At last every block meets those blocks that
hold other components. No pair of rows that share a bucket is left uncompared unless links join it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsense.llm.base import settle, sifted
from gridsense.llm.components import components

Verify = Callable[[DataFrame], DataFrame]
#: Nearness of row i to the rows given by number, exactly: (score, links), from all rows' traits and sizes.
Near = Callable[[pa.Array, np.ndarray], Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]]

BLOCK = 512
#: Items (hashes, components of vectors) in a block, so that long traits make smaller blocks.
BLOCK_ITEMS = 2_000_000
PAIR = "a binary, b binary"


def crowded(buckets: DataFrame) -> DataFrame:
    """The rows whose bucket holds another row, with the bucket's size. Most rows are alone and are not shuffled with all they hold."""
    sizes = settle(buckets.groupBy("bucket").agg(F.count("*").alias("held")).where("held > 1"), "crowds")
    return sifted(buckets, sizes, "bucket").join(sizes, "bucket")


def candidates(group: np.ndarray, own: np.ndarray, i: int, j: int, nearness) -> Iterator[tuple[int, int]]:
    """Links between the blocks i and j of one bucket that join groups; rows are numbers.

    Rows of one group are not compared, and a row gets one link to each group it is near to, so links are fewer than groups.
    """
    group = group.copy()
    there = np.flatnonzero(own == j)
    for row in np.flatnonzero(own == i):
        others = there[group[there] != group[row]]
        if i == j:
            others = others[others > row]
        if not len(others):
            continue
        score, near = nearness(row, others)
        met = group[others]
        joined = np.unique(met[near])
        for g in joined:
            best = np.flatnonzero(near & (met == g))
            yield row, others[best[score[best].argmax()]]
        if len(joined):
            one = [group[row], *joined]
            group[np.isin(group, one)] = min(one)


def _compared(dealt: DataFrame, traits: DataFrame, near: Near) -> DataFrame:
    """Links between components ``(a, b)`` from ``(bucket, node, size, root, own, i, j)``, rows of the blocks i and j."""
    group = ["bucket", "wide", "i", "j"]
    rows = dealt.join(traits, "node").select(*group, "node", "size", "root", "own", "trait")
    rows = rows.repartition(*group).sortWithinPartitions(*group, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def work(held: pa.Table) -> pa.RecordBatch:
            roots = held.column("root").combine_chunks().dictionary_encode()
            codes, names = roots.indices.to_numpy().astype(np.int64), roots.dictionary.to_pylist()
            own, i, j = held.column("own").to_numpy(), held.column("i")[0].as_py(), held.column("j")[0].as_py()
            pairs = []
            if len(names) > 1:
                nearness = near(held.column("trait").combine_chunks(), held.column("size").to_numpy())
                pairs = [sorted((names[codes[x]], names[codes[y]])) for x, y in candidates(codes, own, i, j, nearness)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["a", "b"])

        def keys(batch: pa.RecordBatch) -> np.ndarray:
            return np.stack([batch.column(c).to_numpy().astype(np.int64) for c in group])

        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            found = keys(batch)
            edges = [0, *(np.flatnonzero((found[:, 1:] != found[:, :-1]).any(axis=0)) + 1), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                own = tuple(found[:, start])
                if kept and own != last:
                    yield work(pa.Table.from_batches(kept))
                    kept = []
                last = own
                kept.append(batch.slice(start, stop - start))
        if kept:
            yield work(pa.Table.from_batches(kept))

    return rows.mapInArrow(compare, PAIR).distinct()


def _blocks(rows: Column, items: Column, block: int) -> Column:
    return F.greatest(F.ceil(rows / block), F.ceil(items / BLOCK_ITEMS)).cast("int")


def _divided(rest: DataFrame) -> DataFrame:
    """The rows of buckets that still hold several components."""
    several = rest.groupBy("bucket").agg(F.min("root").alias("first"), F.max("root").alias("last")).where("first != last")
    return rest.join(several.select("bucket"), "bucket", "left_semi")


def _unlike(rest: DataFrame, block: int) -> DataFrame:
    """``_divided`` rows, with the number of blocks of their bucket.

    Of buckets that hold the same nodes (by 128 bits) one stays; the others would give the same pairs again.
    """
    hashes = [F.sum(F.xxhash64(F.lit(i), "node").cast("decimal(20,0)")) for i in (0, 1)]
    told = [F.count("*"), F.min("node"), F.max("node"), *hashes]
    names = [f"t{i}" for i in range(len(told))]
    ends = [F.min("root").alias("first"), F.max("root").alias("last"), _blocks(F.count("*"), F.sum("size"), block).alias("blocks")]
    held = rest.groupBy("bucket").agg(*ends, *(t.alias(name) for t, name in zip(told, names, strict=True))).where("first != last")
    one = held.groupBy(*names).agg(F.min("bucket").alias("bucket"), F.first("blocks").alias("blocks"))
    return rest.join(one.select("bucket", "blocks"), "bucket")


def _within_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Each row in one block of its bucket, which meets no other."""
    held = rows.groupBy("bucket").agg(_blocks(F.count("*"), F.sum("size"), block).alias("blocks"))
    return _in_blocks(rows.join(held, "bucket"))


def _in_blocks(rows: DataFrame) -> DataFrame:
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own")
    return rows.select("bucket", "node", "size", "root", own).withColumn("i", F.col("own")).withColumn("j", F.col("own"))


def _across_blocks(rows: DataFrame, block: int) -> DataFrame:
    """Rows beside all rows of other components of their bucket.

    A component of many rows has blocks of its own, which need not meet each other; the others share blocks by hash, each component in one.
    """
    parts = rows.groupBy("bucket", "root").agg(_blocks(F.count("*"), F.sum("size"), block).alias("own_blocks"), F.count("*").alias("n"), F.sum("size").alias("items"))
    large = F.col("own_blocks") > 1
    shared = parts.groupBy("bucket").agg(
        _blocks(F.coalesce(F.sum(F.when(~large, F.col("n"))), F.lit(0)), F.coalesce(F.sum(F.when(~large, F.col("items"))), F.lit(0)), block).alias("shared"),
        F.coalesce(F.sum(F.when(large, F.col("own_blocks"))), F.lit(0)).alias("apart"),
    )
    before = Window.partitionBy("bucket").orderBy("root").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("start", F.coalesce(F.sum(F.when(large, F.col("own_blocks")).otherwise(0)).over(before), F.lit(0))).join(shared, "bucket")
    placed = placed.select(
        "bucket", "root", large.alias("large"), "own_blocks", (F.col("shared") + F.col("start")).cast("int").alias("start"), "shared",
        (F.col("shared") + F.col("apart")).cast("int").alias("blocks"),
    )
    place = F.when(F.col("large"), F.col("start") + F.pmod(F.xxhash64("node"), F.col("own_blocks"))).otherwise(F.pmod(F.xxhash64("root"), F.col("shared")))
    cut = rows.join(placed, ["bucket", "root"]).withColumn("own", place.cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = ~F.col("large") | (F.col("other") < F.col("start")) | (F.col("other") >= F.col("start") + F.col("own_blocks"))
    return cut.where(apart).select("bucket", "node", "size", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


class _Components:
    """Nodes with the component they are known to belong to; what links are found later join components."""

    def __init__(self, links: DataFrame, rest: DataFrame, block: int):
        self.roots = settle(components(links), "roots")
        known = self.roots.select("node", "root")
        self.rest = settle(_unlike(rest.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")), block), "rest")

    def join(self, edges: DataFrame) -> bool:
        """Take in links between components; whether there were any."""
        edges = settle(edges, "more-links")
        if edges.isEmpty():
            return False
        moved = settle(components(edges), "moved")
        to = moved.select(F.col("node").alias("root"), F.col("root").alias("to"))
        known = self.roots.union(moved.select("node", F.col("node").alias("root"))).distinct()
        self.roots = settle(known.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        rest = self.rest.join(to, "root", "left").withColumn("root", F.coalesce("to", "root")).drop("to")
        self.rest = settle(_divided(rest), "rest")
        return True


def linked_components(
    buckets: DataFrame, traits: DataFrame, near: Near, verify: Verify, able: Column | None = None, block: int = BLOCK
) -> DataFrame:
    """``(node, root)`` of the links among ``crowded`` rows ``(bucket, node, size, held)``; others do not appear.

    ``traits`` is ``(node, trait, wide)`` for these nodes; only traits of one ``wide`` are compared. ``near`` says from them
    which rows link, exactly. ``verify`` gets the stars' pairs ``(a, b, n_a, n_b)`` that fulfil ``able`` and returns those ``(a, b)`` that link.
    """
    able = F.lit(True) if able is None else able
    weight = buckets.groupBy("node").agg((-F.sum("held")).alias("rank"))
    ranked = buckets.join(weight, "node")
    least = ranked.groupBy("bucket").agg(F.min(F.struct("rank", "node", "size")).alias("least"))
    stars = ranked.join(least, "bucket")
    one, two = F.struct("node", "size"), F.struct(F.col("least.node").alias("node"), F.col("least.size").alias("size"))
    stars = stars.where("node != least.node").select(F.least(one, two).alias("one"), F.greatest(one, two).alias("two"))
    pair = [F.col("one.node").alias("a"), F.col("two.node").alias("b"), F.col("one.size").alias("n_a"), F.col("two.size").alias("n_b")]
    links = settle(verify(stars.select(*pair).where(able).distinct()), "links")
    found = _Components(links, buckets.where("held > 2").select("bucket", "node", "size"), block)
    if found.rest.isEmpty():
        return found.roots
    edges = _compared(_in_blocks(found.rest), traits, near)
    found.rest = found.rest.where("blocks > 1").drop("blocks")  # in a bucket of one block all rows were beside each other
    found.join(edges)
    if found.rest.isEmpty():
        return found.roots
    while True:
        one_each = found.rest.groupBy("bucket", "root").agg(F.min(F.struct("node", "size")).alias("row")).select("bucket", "row.*", "root")
        many = one_each.groupBy("bucket").count().where(F.col("count") > block)
        if many.isEmpty():
            break
        leaders = settle(one_each.join(many.select("bucket"), "bucket", "left_semi"), "leaders")
        if not found.join(_compared(_within_blocks(leaders, block), traits, near)):
            break
    if not found.rest.isEmpty():
        found.join(_compared(_across_blocks(found.rest, block), traits, near))
    return found.roots
