"""Best-fit packing of documents into sequences, in bulk-synchronous rounds.

Documents of one length are interchangeable, and so are gaps of one size. Sorting both by size therefore
leaves at most ``capacity`` runs of equal documents and of equal gaps, however many rows there are. A round
sweeps the document runs from long to short; each takes the gaps of its successor (the smallest gap size
that holds it), as many as both have, and goes on to the next successor with the rest. Conflicts are thus
resolved by rank: longer documents first, then by number within the run. Filled gaps change size when the
round ends. What found no gap opens new sequences, no more than its tokens need. Rounds repeat until all
is placed. The plan they leave is a table of rank intervals; Spark numbers the documents of each length
and looks every number up in it.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsense.llm.base import columns, settle, slices, text_of
from gridsense.llm.tokens import encoded

CAPACITY = 4096
BUCKETS = 256
#: New sequences in one round: the documents over half a sequence, or else what their tokens need over this.
SHARE = 4
PIECES = "row long, key long, piece int, start long, length int, ids_crc32 long"
PLACED = "key long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces_of(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, key: str, text: str) -> DataFrame:
    """Cut each document's ids (end id included) every ``capacity`` ids; only lengths and checksums are kept."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            keys, numbers = batch.column("key").to_pylist(), batch.column("row").to_pylist()
            for number, name, ids in zip(numbers, keys, encoded(vocabulary, batch.column("text").to_pylist()), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    rows.append((number, name, piece, start, len(own), zlib.crc32(own.tobytes())))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                ["row", "key", "piece", "start", "length", "ids_crc32"],
            )

    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(F.monotonically_increasing_id().alias("row"), F.col("key").cast("long"), text_of().alias("text"))
    return settle(rows.mapInArrow(cut, PIECES), "pieces")


def plan_rounds(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows ``(length, first number, end number, first sequence, offset)``; their count depends on the lengths only."""
    left = {length: n for length, n in counts.items() if n}
    given = dict.fromkeys(left, 0)
    gaps: dict[int, deque] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(length: int, sequence: int, n: int, gap: int, changed: list) -> None:
        plan.append((length, given[length], given[length] + n, sequence, capacity - gap))
        given[length] += n
        left[length] -= n
        if gap > length:
            changed.append((gap - length, sequence, n))

    while left:
        changed: list = []
        sizes = sorted(gaps)
        for length in sorted(left, reverse=True):
            at = bisect_left(sizes, length)
            while left[length] and at < len(sizes):
                runs = gaps[sizes[at]]
                while left[length] and runs:
                    sequence, n = runs.popleft()
                    taken = min(n, left[length])
                    place(length, sequence, taken, sizes[at], changed)
                    if taken < n:
                        runs.appendleft((sequence + taken, n - taken))
                if not runs:
                    del gaps[sizes[at]]
                    del sizes[at]
        largest = max([0, *sizes, *(gap for gap, _, _ in changed)])
        rest = sorted((length for length, n in left.items() if n and length > largest), reverse=True)
        halves = sum(left[length] for length in rest if 2 * length > capacity)
        tokens = sum(length * left[length] for length in rest)
        fresh = halves or -(-tokens // (SHARE * capacity))
        for length in rest:
            taken = min(fresh, left[length])
            if not taken:
                break
            place(length, opened, taken, capacity, changed)
            opened += taken
            fresh -= taken
        for gap, sequence, n in changed:
            gaps.setdefault(gap, deque()).append((sequence, n))
        left = {length: n for length, n in left.items() if n}
    return np.array(plan, np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY, buckets: int = BUCKETS,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts are empty (the end id alone). Rows that share a key, or are equal altogether, are documents
    of their own. No rows give no rows. Other columns are not looked at. A run of equal lengths is numbered
    in ``buckets`` parts, so that no length needs one task.
    """
    pieces = pieces_of(docs, vocabulary, end_id, capacity, key, text)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_rounds(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        lengths = rows[:, 0]
        bits = 48
        starts = (lengths << bits) + rows[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            number = batch.column("number").to_numpy()
            at = np.searchsorted(starts, (length << bits) + number, side="right") - 1
            sequence = rows[at, 3] + number - rows[at, 1]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(name) for name in ("key", "piece", "start")),
                    pa.array(length, pa.int64()),
                    batch.column("ids_crc32"),
                    pa.array(sequence, pa.int64()),
                    pa.array(rows[at, 4], pa.int64()),
                ],
                ["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    parted = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    # At most capacity x buckets rows: where each part of a run begins.
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = parted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    begins = begins.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begins"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece"))
    numbered = parted.withColumn("own", own).join(begins, ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("begins") + F.col("own") - 1)
    return numbered.select("key", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, PLACED)
