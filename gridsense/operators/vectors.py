"""Exact nearest-neighbour search over a column of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridsense.functions.names import field

# Matches returned by default, and characters shown of each.
NEIGHBOURS = 5
SHOWN = 100
#: Queries that meet the vectors in one pass.
QUERY_BLOCK = 2_000


def mean_vector(df: DataFrame, vector: str, size: int) -> list[float]:
    """The element-wise mean of a column of vectors: a job that combines map-side to one row."""
    elements = [F.avg(F.get(field(vector), F.lit(i))) for i in range(size)]
    return df.agg(F.array(*elements).alias("mean")).first()["mean"]


def squared_distance(vector: Column, query: list[float]) -> Column:
    """Squared Euclidean distance, in doubles."""
    target = F.array(*(F.lit(float(x)) for x in query))

    def squared_gap(a: Column, b: Column) -> Column:
        return (a.cast("double") - b) * (a.cast("double") - b)

    return F.aggregate(F.zip_with(vector, target, squared_gap), F.lit(0.0), lambda total, part: total + part)


def nearest(df: DataFrame, query: list[float], vector: str, key: str, k: int = NEIGHBOURS) -> DataFrame:
    """The k rows nearest to the query vector, with ``vector_score`` (smaller is nearer).

    Vectors of another length, or with a null or NaN element, have no distance and are left out. Each task
    keeps its own k best; only those meet.
    """
    fits = F.size(field(vector)) == len(query)
    scored = df.where(fits).withColumn("vector_score", squared_distance(field(vector), query))
    measured = scored.where(F.col("vector_score").isNotNull() & ~F.isnan("vector_score"))
    return measured.orderBy(F.col("vector_score"), field(key)).limit(k)


class _Best:
    """The k nearest keys of each query so far, by exact distance and then by key."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.held: list[list[tuple[float, int]]] = [[] for _ in queries]
        self.lengths = (queries * queries).sum(axis=1)

    def add(self, vectors: np.ndarray, keys: np.ndarray) -> None:
        """A matrix product tells which vectors may be among the best; their distances are then taken exactly."""
        lengths = (vectors * vectors).sum(axis=1)
        near = lengths[:, None] + self.lengths[None, :] - 2 * (vectors @ self.queries.T)
        slack = 1e-9 * (lengths.max(initial=0.0) + self.lengths)
        if len(vectors) > self.k:
            limit = np.partition(near, self.k - 1, axis=0)[self.k - 1] + slack
        else:
            limit = np.full(len(self.queries), np.inf)
        for q, best in enumerate(self.held):
            bound = limit[q] if len(best) < self.k else min(limit[q], best[-1][0] + slack[q])
            rows = np.flatnonzero(near[:, q] <= bound)
            if len(rows):
                gaps = vectors[rows] - self.queries[q]
                found = zip((gaps * gaps).sum(axis=1).tolist(), keys[rows].tolist(), strict=True)
                self.held[q] = sorted([*best, *found])[: self.k]


def nearest_batch(df: DataFrame, queries: DataFrame, vector: str, key: str, query_key: str, k: int = NEIGHBOURS) -> DataFrame:
    """``query, key, vector_score, place``: the k rows of ``df`` nearest to each row of ``queries``, place 1 being the nearest.

    Both tables have a whole-number key and the vector column. Vectors that are null, hold null, NaN or infinite elements, or differ in length
    from a query's have no distance to it. Ties go to the smaller key. Queries are taken in blocks of ``QUERY_BLOCK``, each of which meets
    all vectors in one pass as a product of matrices; a task keeps k rows for each query, and only those are shuffled.
    """
    named = queries.select(field(query_key).cast("long").alias("query"), field(vector).cast("array<double>").alias("vector"))
    named = named.where(F.col("query").isNotNull() & F.col("vector").isNotNull())
    blocks = -(-max(named.count(), 1) // QUERY_BLOCK)
    rows = df.select(field(key).cast("long").alias("key"), field(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("key").isNotNull() & F.col("vector").isNotNull())
    found = []
    for block in range(blocks):
        asked = [(r["query"], r["vector"]) for r in named.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).collect()]
        found.append(rows.mapInArrow(_search(asked, k), "query long, key long, vector_score double"))
    whole = found[0]
    for part in found[1:]:
        whole = whole.unionByName(part)
    place = F.row_number().over(Window.partitionBy("query").orderBy("vector_score", "key"))
    return whole.withColumn("place", place).where(F.col("place") <= k)


def _search(asked: list[tuple[int, list[float]]], k: int):
    def usable(v: list[float | None]) -> bool:
        return None not in v and bool(np.isfinite(v).all())

    by_size: dict[int, list[tuple[int, list[float]]]] = {}
    for query, v in asked:
        if v and usable(v):
            by_size.setdefault(len(v), []).append((query, v))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: _Best(np.array([v for _, v in held]), k) for size, held in by_size.items()}
        for batch in batches:
            keys, vectors = batch.column("key").to_numpy(), batch.column("vector")
            sizes = vectors.value_lengths().to_numpy()
            for size, held in best.items():
                rows = np.flatnonzero(sizes == size)
                if not len(rows):
                    continue
                flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                good = np.isfinite(flat).all(axis=1)
                held.add(flat[good], keys[rows][good])
        for size, held in best.items():
            told = [(query, key, score) for (query, _), rows in zip(by_size[size], held.held, strict=True) for score, key in rows]
            columns = [pa.array([t[i] for t in told], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "key", "vector_score"])

    return work


def unique_matches(matches: DataFrame, text: str, key: str) -> DataFrame:
    """Of matches with equal text only the nearest, with a ``_summary``.

    ``matches`` has at most the k rows that ``nearest`` returned.
    """
    first = F.row_number().over(Window.partitionBy(field(text)).orderBy("vector_score", field(key)))
    shown = F.format_string(
        "Semantic Match (Score: %.4f): %s...", F.col("vector_score"), F.substring(field(text), 1, SHOWN)
    )
    return matches.withColumn("__place", first).where(F.col("__place") == 1).drop("__place").withColumn("_summary", shown)
