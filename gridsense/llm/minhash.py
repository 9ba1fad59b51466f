"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

One hash per shingle: its high bits name one of ``BINS`` bins, the smallest hash of a bin is the bin's value. An
empty bin takes the value of the first filled bin in a fixed pseudo-random sequence that depends on the bin
alone, so that equal sets stay equal and each filled bin is as likely a donor as any other. Rows of bins make bands; documents that
share a band are candidates and are compared as stars (see ``stars``). All comparisons are on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.llm.base import columns, packed, settle, sifted, slices, text_of, unpacked
from gridsense.llm.stars import Near, crowded, linked_components
from gridsense.llm.words import mixed, shingle_sets

BANDS, ROWS = 48, 8
BINS = BANDS * ROWS
#: Text whose words are hashed at a time; that takes some 70 bytes of memory for each byte.
HASHED_BYTES = 1_000_000
SIGNED = "key long, check long, n long, node binary, bands array<long>"


def signature(sets: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The bins' values of one ascending, non-empty set of hashes."""
    spread = mixed(sets ^ np.uint64(0x5851F42D4C957F2D))
    spread.sort()
    place = ((spread >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(place, return_index=True)
    values = np.zeros(bins, np.uint64)
    values[filled.astype(np.int64)] = spread[first]
    full = np.zeros(bins, bool)
    full[filled.astype(np.int64)] = True
    lacking = np.flatnonzero(~full)
    attempt = 0
    donor = np.zeros(bins, np.int64)
    while len(lacking):
        attempt += 1
        seed = mixed(lacking.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt))
        donor[lacking] = (seed % np.uint64(bins)).astype(np.int64)
        lacking = lacking[~full[donor[lacking]]]
    empty = np.flatnonzero(~full)
    values[empty] = values[donor[empty]]
    return values


def bands_of(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One hash per band of bins; the band's number is part of it."""
    table = values.reshape(bands, -1)
    found = np.arange(1, bands + 1, dtype=np.uint64)
    for column in table.T:
        found = mixed(found * np.uint64(0x9E3779B97F4A7C15) + column)
    return found.view(np.int64)


def identity(sets: np.ndarray) -> bytes:
    """128 bits that stand for a set: two sums over differently mixed hashes."""
    return np.array([mixed(sets).sum(dtype=np.uint64), mixed(sets + np.uint64(len(sets))).sum(dtype=np.uint64)]).tobytes()


def alike(percent: int) -> Near:
    """Nearness by the sets themselves: how many hashes two rows have in common."""

    def prepare(traits: pa.Array, sizes: np.ndarray):
        held = traits.flatten().to_numpy()
        names, code = np.unique(held, return_inverse=True)
        starts = traits.offsets.to_numpy()[:-1] - traits.offsets.to_numpy()[0]
        length = np.diff(traits.offsets.to_numpy())

        def nearness(row: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = np.zeros(len(names), bool)
            own[code[starts[row] : starts[row] + length[row]]] = True
            common = np.add.reduceat(own[code], starts, dtype=np.int64)[others]
            union = length[row] + length[others] - common
            return common / union, 100 * common >= percent * union

        return nearness

    return prepare


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Each row's set size, set identity and bands; without words no identity."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=HASHED_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("check"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([identity(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([bands_of(signature(s)) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                ["key", "check", "n", "node", "bands"],
            )

    return settle(docs.mapInArrow(sign, SIGNED), "signed")


def full_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(node, hashes)`` for ``(node, of)``, where ``of`` has key and text hash of a document with that set.

    Few texts are wanted, so the others are sifted out before any is shuffled.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=HASHED_BYTES):
            sets = shingle_sets(batch.column("text").to_pylist(), width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("node"),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ],
                ["node", "hashes"],
            )

    same = F.col("key").eqNullSafe(F.col("of.key")) & (F.col("check") == F.col("of.check"))
    sought = sifted(rows, wanted.select("of.key", "of.check"), "key", "check")
    texts = sought.join(wanted, same).select("node", "text").dropDuplicates(["node"])
    return settle(texts.mapInArrow(hashes, "node binary, hashes array<long>"), "sets")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (smallest key linked with it, itself included), kept.

    Two columns follow: root (the component's own name, null for empty sets) and check (the text's hash).

    Sets of shingles stand as sets of 64-bit hashes. Documents with equal sets are one node from the start,
    whatever their number. Null and wordless texts have an empty set and link with nothing; a null key is no
    smallest key (its component takes the smallest of the others, or null), and is kept only if it is alone. Of rows that share a key
    and a component all are kept if any is. No rows give no rows. Other columns are not looked at.
    """
    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(F.col("key").cast("long"), text_of().alias("text")).withColumn("check", F.xxhash64("text"))
    marks = signed(rows, width)
    # One row per set: equal sets have equal bands, so any row's will do.
    nodes = marks.where("n > 0").groupBy("node").agg(
        F.min("key").alias("least"), F.min(F.struct("key", "check")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands")
    )
    nodes = settle(nodes, "nodes")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node", F.col("n").alias("size"))
    buckets = settle(crowded(buckets), "buckets")
    wanted = settle(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "of"), "wanted")
    sets = full_sets(rows, wanted, width)

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
        full = full.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return full.where(100 * common >= percent * (F.col("n_a") + F.col("n_b") - common)).select("a", "b")

    able = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    roots = linked_components(buckets, sets.select("node", F.col("hashes").alias("trait"), F.lit(0).alias("wide")), alike(percent), verify, able)
    grouped = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    members = grouped.join(smallest, "root").select("node", "root", "component_id")
    found = marks.select("key", "check", "n", "node").join(members, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return found.select(
        "key", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"),
        "root", "check",
    )


def one_of_each(docs: DataFrame, width: int = 3, percent: int = 85, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay if one document of each component does: that with the smallest key, null being no smallest.

    Rows with an empty set all stay, but for repetitions of key and text. Rows keep all their columns.
    """
    found = near_duplicates(docs, width, percent, key, text)
    name = F.coalesce(F.col("key"), F.lit(0))
    best = F.min(F.struct(F.col("key").isNull().alias("k0"), name.alias("k1"), F.col("check").alias("k2")))
    stays = found.where("root is not null").groupBy("root").agg(best.alias("best")).select("best.*")
    stays = stays.union(found.where("root is null").select(F.col("key").isNull(), name, "check")).distinct()
    own = F.col("key").cast("long")
    names = {"k0": own.isNull(), "k1": F.coalesce(own, F.lit(0)), "k2": F.xxhash64(text_of())}
    marked = packed(docs, key=key, text=text).withColumns(names).drop("key", "text")
    return unpacked(marked.join(stays, list(names), "left_semi").dropDuplicates(list(names)), docs.columns)
