"""Records of delimited files whose cells may hold line ends, read split by split.

A line inside a quoted cell looks like any other, so a reader that starts in the middle of a file cannot know whether it starts inside a
cell. Each split therefore tells how it ends for both cases; taking these in file order gives every split its true start. Then each
split puts its lines together into records, and only the pieces of records that cross a border between splits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Character sets whose lines can be told apart by bytes and decoded afterwards.
DECODED = ("UTF-8", "ISO-8859-1", "US-ASCII")
PIECES = "file string, block long, at long, opens boolean, closes boolean, record string"
Split = tuple[str, int]


class Quoting:
    """Whether a line ends inside a quoted cell. Quotes count at the start of a cell only; elsewhere they are plain characters."""

    def __init__(self, sep: str):
        mark = re.escape(sep)
        self.closed = re.compile(rf'(?:^|(?<={mark}))"(?:[^"]|"")*+"(?!")[^{mark}]*')
        self.opened = re.compile(rf'(?:^|{mark})"')
        self.rest = re.compile(r'(?:[^"]|"")*+"(?!")')

    def after(self, line: str, inside: bool) -> bool:
        if inside:
            end = self.rest.match(line)
            if not end:
                return True
            line = "x" + line[end.end() :]
        return self.opened.search(self.closed.sub("x", line)) is not None


def lines(spark: SparkSession, path: str, charset: str) -> DataFrame:
    """``(file, block, value)``: the lines of each split in order."""
    value = F.col("value") if charset == "UTF-8" else F.decode(F.col("value").cast("binary"), charset)
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, pa.Array]]:
    """Lines in a row of one split."""
    for batch in batches:
        start = 0
        blocks, files = batch.column("block").to_pylist(), batch.column("file").dictionary_encode().indices.to_pylist()
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or blocks[i] != blocks[start] or files[i] != files[start]:
                yield (batch.column("file")[start].as_py(), blocks[start]), batch.column("value").slice(start, i - start)
                start = i


def _quoted(values: pa.Array) -> list[int]:
    """The places of lines that hold a quote; no other line changes anything."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring(values, '"'), False)).to_pylist()


def split_ends(found: DataFrame, sep: str) -> dict[Split, tuple[bool, bool]]:
    """For each split, whether it ends inside a cell if it starts outside, and if it starts inside.

    One row a split reaches the driver, which knows all splits anyway as it deals them out.
    """

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoting, ends = Quoting(sep), {}
        for split, values in _stretches(batches):
            outside, inside = ends.get(split, (False, True))
            for i in _quoted(values):
                line = values[i].as_py()
                same = outside == inside
                outside, inside = quoting.after(line, outside), quoting.after(line, inside)
                inside = outside if same else inside
            ends[split] = outside, inside
        rows = [(file, block, *end) for (file, block), end in ends.items()]
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
        columns = [pa.array([row[i] for row in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["file", "block", "outside", "inside"])

    rows = found.mapInArrow(tell, "file string, block long, outside boolean, inside boolean").collect()
    return {(row["file"], row["block"]): (row["outside"], row["inside"]) for row in rows}


def starts_inside(ends: dict[Split, tuple[bool, bool]]) -> tuple[set[Split], bool]:
    """The splits that start inside a cell, and whether any record crosses a border."""
    inside, state, before = set(), False, None
    crossing = False
    for split in sorted(ends):
        if split[0] != before:
            state, before = False, split[0]
        if state:
            inside.add(split)
        state = ends[split][state]
        crossing |= state
    return inside, crossing


def _pieces(found: DataFrame, sep: str, inside: set[Split], whole: bool) -> DataFrame:
    """Records that lie in one split (``whole``), or the pieces of those that do not. Blank lines between records are dropped."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quoting = Quoting(sep)
        split, held, rows = None, [], []
        state = opens = False
        at = 0

        def finish(closes: bool) -> None:
            nonlocal held, at
            text = "\n".join(held)
            if (held and text.strip()) or not (opens and closes):
                if (opens and closes) == whole and held:
                    rows.append((*split, at, opens, closes, text))
                at += opens
            held = []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
            names = ["file", "block", "at", "opens", "closes", "record"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)
            rows = []

        for own, values in _stretches(batches):
            if own != split:
                if split and held:
                    finish(False)
                split, state, at = own, own in inside, 0
                opens = not state
            quoted = set(_quoted(values))
            for i, line in enumerate(values.to_pylist()):
                held.append(line or "")
                if i in quoted:
                    state = quoting.after(line, state)
                if not state:
                    finish(True)
                    opens = True
            yield from out()
        if split and held:
            finish(False)
        yield from out()

    return found.mapInArrow(cut, PIECES)


def records(spark: SparkSession, path: str, sep: str, charset: str = "UTF-8") -> DataFrame:
    """``(file, block, at, record)`` of all records: the split a record begins in and its place there.

    A cell that is never closed holds the rest of its file. Line ends within cells become line feeds.
    """
    found = lines(spark, path, charset)
    inside, crossing = starts_inside(split_ends(found, sep))
    complete = _pieces(found, sep, inside, whole=True).select("file", "block", "at", "record")
    if not crossing:
        return complete
    pieces = _pieces(found, sep, inside, whole=False)
    in_order = Window.partitionBy("file").orderBy("block", "opens")
    numbered = pieces.withColumn("number", F.sum(F.col("opens").cast("long")).over(in_order))
    parts = F.array_sort(F.collect_list(F.struct("block", "opens", "at", "record")))
    joined = numbered.groupBy("file", "number").agg(parts.alias("parts"))
    crossed = joined.select(
        "file", F.col("parts")[0]["block"].alias("block"), F.col("parts")[0]["at"].alias("at"), F.array_join("parts.record", "\n").alias("record")
    )
    return complete.unionByName(crossed)
