"""Token ids in files: frequency-ranked ids, one to four data bytes each, lengths in separate control bytes.

File format (a Parquet folder, one row per block of documents):

``part``      number of the file in key order
``begins``    ids in this file before the block
``keys``      the documents' keys, ascending; ``counts`` the ids of each, end id included
``control``   two bits per id (its data bytes less one), four ids to a byte, first id in the low bits
``data``      each id's rank, little-endian, without leading zero bytes

A second folder ``ranks`` holds the vocabulary by falling frequency, ties by id: rank 0 is the most
frequent id. Frequent ids thus take one byte. Both tables come from all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridsense.llm.base import BATCH_BYTES, columns, settle, slices, text_of
from gridsense.llm.tokens import encoded
from gridsense.sources.storage import scratch_path

#: Data bytes of the four ids of each control byte, and their sum.
WIDTHS = 1 + ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8)
BLOCK_IDS = 1_000_000
SETTLED = "row long, key long, n long, ids binary, seen binary"
BLOCKS = "part int, begins long, keys array<long>, counts array<long>, control binary, data binary"
READ = "key long, part int, begins long, n_tokens long, ids_crc32 long"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of a run of ranks."""
    ranks = ranks.astype("<u4", copy=False)
    widths = np.ones(len(ranks), np.uint8)
    for most in (0xFF, 0xFFFF, 0xFFFFFF):
        widths += ranks > most
    at = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
    data = np.empty(at[-1], np.uint8)
    data[at[:-1]] = ranks.astype(np.uint8)
    for byte in (1, 2, 3):
        wide = np.flatnonzero(widths > byte)
        if not len(wide):
            break
        data[at[wide] + byte] = (ranks[wide] >> np.uint32(8 * byte)).astype(np.uint8)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = widths - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ranks again: widths by table lookup, then one gather per byte position."""
    widths = WIDTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:count].astype(np.int64)
    at = np.cumsum(widths) - widths
    held = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)))
    ranks = held[at].astype(np.uint32)
    for byte in (1, 2, 3):
        wide = np.flatnonzero(widths > byte)
        if not len(wide):
            break
        ranks[wide] |= held[at[wide] + byte].astype(np.uint32) << np.uint32(8 * byte)
    return ranks


def token_table(docs: DataFrame, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Settle ``(row, key, n, ids, seen)`` for all rows: the ids' byte planes, the end id last.

    Each task adds a row without ``row``: its distinct ids and, in ``seen``, how often they occurred.
    """

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], np.uint32)
        total = np.zeros(0, np.int64)
        for batch in slices(batches):
            found = [np.append(ids, end) for ids in encoded(vocabulary, batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("key"),
                    pa.array([len(ids) for ids in found], pa.int64()),
                    pa.array([planes(ids) for ids in found], pa.binary()),
                    pa.nulls(len(found), pa.binary()),
                ],
                ["row", "key", "n", "ids", "seen"],
            )
            own = np.bincount(np.concatenate(found), minlength=len(total))
            own[: len(total)] += total
            total = own
        seen = np.flatnonzero(total)
        if len(seen):
            counts = total[seen].astype(np.int64).tobytes()
            row = [None, None, len(seen), planes(seen.astype(np.uint32)), counts]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["row", "key", "n", "ids", "seen"])

    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(F.monotonically_increasing_id().alias("row"), F.col("key").cast("long"), text_of().alias("text"))
    return settle(rows.mapInArrow(tokenise, SETTLED), "tokens")


def planes(ids: np.ndarray) -> bytes:
    """All low bytes, then all second bytes, and so on, without planes that are zero throughout."""
    used = max(1, -(-int(ids.max()).bit_length() // 8))
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :used].T).tobytes()


def from_planes(data: bytes, count: int) -> np.ndarray:
    raw = np.zeros((count, 4), np.uint8)
    used = np.frombuffer(data, np.uint8).reshape(-1, count)
    raw[:, : len(used)] = used.T
    return raw.view("<u4").reshape(-1)


def ids_in(batch: pa.RecordBatch) -> np.ndarray:
    """The ids of all documents of a batch in a row."""
    held = zip(batch.column("ids").to_pylist(), batch.column("n").to_pylist(), strict=True)
    return np.concatenate([np.zeros(0, np.uint32), *(from_planes(data, n) for data, n in held)])


def ranked_ids(tokens: DataFrame) -> DataFrame:
    """``(id, rank)``; one row for each id of the vocabulary that occurs, so at most the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, seen in zip(*(batch.column(c).to_pylist() for c in ("ids", "n", "seen")), strict=True):
                found = from_planes(ids, n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.frombuffer(seen, np.int64))], ["id", "n"])

    told = tokens.where("row IS NULL").select("ids", "n", "seen")
    counts = told.mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.select("id", (F.row_number().over(Window.orderBy(F.desc("n"), "id")) - 1).alias("rank"))


def lookup(ranks: DataFrame, source: str, target: str) -> np.ndarray:
    """One side of the rank table as an array; its size is bounded by the vocabulary."""
    rows = ranks.toPandas()
    found = np.zeros(int(rows[source].max()) + 1 if len(rows) else 1, np.uint32)
    found[rows[source].to_numpy(np.int64)] = rows[target].to_numpy(np.uint32)
    return found


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, key: str = "doc_id",
                      text: str = "text") -> None:
    """Write ``path/blocks`` and ``path/ranks``; documents ascend by key over all files.

    Null texts are empty (just the end id). Null keys come first. Rows that share a key are documents of
    their own and stand in the order in which they were read. Other columns are not looked at.
    """
    tokens = token_table(docs, vocabulary, end_id, key, text)
    spark = docs.sparkSession
    ranked_ids(tokens).coalesce(1).write.parquet(f"{path}/ranks")
    rank_of = lookup(spark.read.parquet(f"{path}/ranks"), "id", "rank")
    shared = spark.sparkContext.broadcast(rank_of)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begins = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "ids", 2 * BLOCK_IDS):
            counts = batch.column("n").to_numpy(zero_copy_only=False)
            ids = ids_in(batch)
            control, data = pack(shared.value[ids])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([begins], pa.int64()),
                    pa.array([batch.column("key").to_pylist()], pa.list_(pa.int64())),
                    pa.array([counts.tolist()], pa.list_(pa.int64())),
                    pa.array([control], pa.binary()),
                    pa.array([data], pa.binary()),
                ],
                ["part", "begins", "keys", "counts", "control", "data"],
            )
            begins += int(counts.sum())

    ordered = tokens.where("row IS NOT NULL").repartitionByRange("key", "row").sortWithinPartitions("key", "row").select("key", "n", "ids")
    blocks = ordered.mapInArrow(write, BLOCKS)
    blocks.write.option("compression", "zstd").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of each document, decoded from the files."""
    id_of = lookup(spark.read.parquet(f"{path}/ranks"), "rank", "id")
    shared = spark.sparkContext.broadcast(id_of)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data", BATCH_BYTES):
            for block in batch.to_pylist():
                counts = np.array(block["counts"], np.int64)
                ids = shared.value[unpack(block["control"], block["data"], int(counts.sum()))].astype("<u4")
                ends = np.cumsum(counts)
                checks = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["keys"], pa.int64()),
                        pa.array(np.full(len(ends), block["part"], np.int32)),
                        pa.array(block["begins"] + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(checks, pa.int64()),
                    ],
                    ["key", "part", "begins", "n_tokens", "ids_crc32"],
                )

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row per file, so the running total over files is a small window and a small broadcast.
    files = blocks.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    files = files.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return (
        blocks.mapInArrow(read, READ)
        .join(F.broadcast(offsets), "part")
        .select("key", (F.col("before") + F.col("begins")).alias("start"), "n_tokens", "ids_crc32")
    )


def token_digests(docs: DataFrame, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to token files in the shared folder, read these back and report on each document."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, path, vocabulary, end_id, key, text)
    return read_token_files(docs.sparkSession, path)
