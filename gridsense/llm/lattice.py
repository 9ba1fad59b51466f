"""Embedding near-duplicates: random projections decoded to E8 lattice points, neighbouring cells probed, cosines verified.

Each table projects a vector to 16 numbers and decodes them as two points of the E8 lattice. The pair of
points is the vector's cell; replacing either point by the closest one of the lattice's other coset gives
the neighbouring cells that are probed. Vectors that meet in a cell are candidates, compared as stars (see
``stars``), and links found join into components. The links of each vector are then counted within its
component, by blocks of vectors, so that no list of pairs is ever made and a link that hashing missed still counts if
other links join its two ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.llm.base import columns, settle
from gridsense.llm.stars import Near, crowded, linked_components
from gridsense.llm.words import mixed

TABLES, POINTS, WIDTH, SEED = 20, 2, 2.0, 2
BLOCK = 1024
HASHED = "key long, node binary, vector array<double>, cells array<long>"


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Closest points of whole numbers with an even sum."""
    found = np.rint(x)
    off = x - found
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0)
    odd = found.sum(-1, keepdims=True) % 2 != 0
    np.put_along_axis(found, worst, np.take_along_axis(found, worst, -1) + np.where(odd, step, 0.0), -1)
    return found


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest lattice point, and the closest of the coset that it is not in."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    swap = ((x - half) ** 2).sum(-1, keepdims=True) < ((x - whole) ** 2).sum(-1, keepdims=True)
    return np.where(swap, half, whole), np.where(swap, whole, half)


def cells_of(units: np.ndarray, tables: int = TABLES, points: int = POINTS, width: float = WIDTH, seed: int = SEED) -> np.ndarray:
    """Hashes of each unit vector's cell and probed cells in every table; the same for equal vectors of equal length."""
    size = units.shape[1]
    random = np.random.default_rng([seed, size])
    found = []
    for number in range(tables):
        spread = random.normal(size=(size, 8 * points)) / width
        shift = random.uniform(0, 2, 8 * points)
        best, other = nearest_e8((units @ spread + shift).reshape(len(units), points, 8))
        probes = [best]
        for i in range(points):
            probe = best.copy()
            probe[:, i] = other[:, i]
            probes.append(probe)
        for probe in probes:
            twice = np.rint(2 * probe).astype(np.int64).reshape(len(units), -1).view(np.uint64)
            code = np.full(len(units), np.uint64(number * 65536 + size), np.uint64)
            for column in twice.T:
                code = mixed(code * np.uint64(0x9E3779B97F4A7C15) + column)
            found.append(code.view(np.int64))
    return np.stack(found, axis=1)


def _units(vectors: list) -> np.ndarray:
    """Unit vectors, for the hash only."""
    x = np.array(vectors, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: list | None) -> bool:
    return bool(vector) and None not in vector and bool(np.isfinite(vector).all()) and any(vector)


def hashed(rows: DataFrame) -> DataFrame:
    """Each vector's identity (its bytes) and cells; null for vectors that cannot link."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            nodes, cells = [None] * len(vectors), [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for i, vector in enumerate(vectors):
                if usable(vector):
                    by_size.setdefault(len(vector), []).append(i)
            for held in by_size.values():
                found = cells_of(_units([vectors[i] for i in held]))
                for i, row in zip(held, found, strict=True):
                    cells[i] = row
                    nodes[i] = hashlib.blake2b((np.array(vectors[i], np.float64) + 0.0).tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(nodes, pa.binary()), batch.column("vector"), pa.array(cells, pa.list_(pa.int64()))],
                ["key", "node", "vector", "cells"],
            )

    return settle(rows.mapInArrow(work, HASHED), "hashed")


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of ``least`` or more, in double precision, whatever their length."""
    x, y = (v / np.abs(v).max(axis=-1, keepdims=True) for v in (x, y))
    return x @ y.T >= least * np.sqrt((x * x).sum(-1))[:, None] * np.sqrt((y * y).sum(-1))[None, :]


def alike(least: float) -> Near:
    """Nearness by the cosine itself."""

    def prepare(traits: pa.Array, sizes: np.ndarray):
        vectors = traits.flatten().to_numpy().reshape(len(traits), -1)

        def nearness(row: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            near = linked(vectors[row : row + 1], vectors[others], least)[0]
            return near.astype(float), near

        return nearness

    return prepare


def near_duplicates(vectors: DataFrame, least: float = 0.9, block: int = BLOCK, key: str = "vec_id",
                    vector: str = "embedding") -> DataFrame:
    """One row per vector: key, n_links, component_id (smallest key reachable), kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, as do vectors of different length.
    Equal vectors are one node from the start. Rows that share a key are vectors of their own. A null key is
    never the smallest; alone, its component is null and it is kept. No rows give no rows. Other columns are
    not looked at. Recall is below 1 only for links whose two ends no other links join.
    """
    named = vectors.select(*columns(vectors, key=key, vector=vector))
    rows = hashed(named.select(F.col("key").cast("long"), F.col("vector").cast("array<double>")))
    nodes = rows.where("node is not null").groupBy("node").agg(
        F.min("key").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("cells").alias("cells")
    )
    nodes = settle(nodes, "nodes")
    size = F.size("vector").alias("size")
    buckets = nodes.select(F.explode(F.array_distinct("cells")).alias("bucket"), "node", size)
    buckets = settle(crowded(buckets), "buckets")

    def verify(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (batch.column(c).to_pylist() for c in ("x", "y"))
                found = [bool(linked(np.array([u]), np.array([v]), least)[0, 0]) for u, v in zip(x, y, strict=True)]
                yield batch.filter(pa.array(found, pa.bool_())).select(["a", "b"])

        first = nodes.select(F.col("node").alias("a"), F.col("vector").alias("x"))
        second = nodes.select(F.col("node").alias("b"), F.col("vector").alias("y"))
        return pairs.select("a", "b").join(first, "a").join(second, "b").mapInArrow(check, "a binary, b binary")

    traits = nodes.select("node", F.col("vector").alias("trait"), size.alias("wide"))
    roots = linked_components(buckets, traits, alike(least), verify, F.col("n_a") == F.col("n_b"))
    roots = settle(roots, "roots")
    counts = link_counts(nodes.join(roots, "node"), least, block)
    grouped = nodes.select("node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    members = grouped.join(smallest, "root").join(counts, "node", "left")
    links = F.coalesce("others", F.lit(0)) + F.col("copies") - 1
    members = members.select("node", "component_id", links.cast("long").alias("n_links"))
    found = rows.select("key", "node").join(members, "node", "left")
    component = F.when(F.col("node").isNotNull(), F.col("component_id")).otherwise(F.col("key"))
    return found.select(
        "key", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
        F.col("key").eqNullSafe(component).alias("kept"),
    )


def link_counts(members: DataFrame, least: float, block: int) -> DataFrame:
    """``(node, others)``: linked vectors of other nodes of the component, copies counted.

    A component is cut into blocks, and each pair of blocks is one group; components of one block share
    groups by hash, about one group for each block of rows.
    """
    sizes = members.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cut = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    shared = members.count() // block + 1
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(shared))).otherwise(F.xxhash64("root"))
    paired = cut.withColumn("group", group).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = paired.select(
        "root", "node", "copies", "vector", "own", "group", "blocks",
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
    )

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        for _, held in rows.groupby("root", sort=False):
            x = np.array(held["vector"].tolist(), float)
            i, j = held["i"].iat[0], held["j"].iat[0]
            first = (held["own"] == i).to_numpy()
            second = first if i == j else ~first
            near = linked(x[first], x[second], least)
            copies = held["copies"].to_numpy()
            nodes = held["node"].to_numpy()
            if i == j:
                np.fill_diagonal(near, False)
            else:
                found.append(pd.DataFrame({"node": nodes[second], "n": near.T @ copies[first]}))
            found.append(pd.DataFrame({"node": nodes[first], "n": near @ copies[second]}))
        return pd.concat(found)

    counted = paired.groupBy("group", "blocks", "i", "j").applyInPandas(count, "node binary, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("others"))
