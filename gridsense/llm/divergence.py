"""Which terms set a source apart within its language, and how far the sources of a language lie from each other.

Only terms of at least ``least`` documents count. They are found by prefix: each level counts, per language, the
documents that hold a term with a given byte prefix, and only terms below prefixes with enough documents are looked
at again under prefixes of twice the length. A term that ends within its level's width is counted whole there, so the
levels end when no prefix is left open, after about the logarithm of the longest kept term's length. The many
terms of one or two documents are thus seldom shuffled whole.

What is handed from level to level is a filter of ``FILTER_BITS`` bits, whatever the corpus. A bit set by two prefixes
lets terms through that needn't be counted; they are then counted exactly and dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsense.llm.base import columns, settle, slices, text_of
from gridsense.llm.token_files import from_planes, planes
from gridsense.llm.words import mixed

FIRST_WIDTH = 4
FILTER_BITS = 1 << 23
UNIT = 1_000_000_000
CELLS = 1 << 20
#: Cells (kept terms times groups of their language) that make a part worth its own partial results.
PART_CELLS = 1 << 18
#: Letters A-Z count as a-z; a-z and all bytes of characters beyond ASCII belong to terms, the rest parts them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BLOCKS = "langs array<binary>, sources array<binary>, lang_of binary, source_of binary, terms binary, sizes binary, codes binary, counts binary"
FOUND = "lang binary, source binary, part string, item binary, value long"
MOST_ROWS = 400_000
BLOCK_BYTES = 16_000_000


def _digests(values: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, values), np.uint64, len(values))


def _coded(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and for each row the number of its value."""
    held = values.dictionary_encode()
    return held.dictionary, held.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _packed(numbers: np.ndarray) -> bytes:
    return planes(numbers.astype(np.uint32)) if len(numbers) else b""


class _Block:
    """The distinct terms of a block of documents, ascending, and each document's terms as numbers with their counts."""

    def __init__(self, row: dict):
        self.langs, self.sources = row["langs"], row["sources"]
        self.lang_of, self.source_of, sizes = (np.frombuffer(row[c], np.int32).astype(np.int64) for c in ("lang_of", "source_of", "sizes"))
        self.terms = row["terms"].split(b" ") if row["terms"] else []
        held = int(sizes.sum())
        self.codes, self.counts = (from_planes(row[c], held).astype(np.int64) if held else np.zeros(0, np.int64) for c in ("codes", "counts"))
        self.document = np.repeat(np.arange(len(sizes)), sizes)
        self.lang = self.lang_of[self.document]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The (language, term) numbers that occur, and for each occurrence which of them it is."""
        return np.unique(self.lang * max(len(self.terms), 1) + self.codes, return_inverse=True)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Block(batch.slice(i, 1).to_pylist()[0])


def _spots(langs: list[bytes], which: np.ndarray, prefixes: list[bytes], at: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bit of each (language, prefix), both given as numbers of distinct values."""
    pair = mixed(_digests(langs))[which] ^ _digests(prefixes)[at]
    return (mixed(pair) & np.uint64(bits - 1)).astype(np.int64)


class _Filter:
    """Which (language, prefix) pairs may go on; a set bit is no proof."""

    def __init__(self, words: np.ndarray, marks: np.ndarray, bits: int):
        self.bits = bits
        self.held = np.zeros(bits // 64, np.uint64)
        self.held[words] = marks.astype(np.int64).view(np.uint64)

    def passes(self, langs: list[bytes], which: np.ndarray, prefixes: list[bytes], at: np.ndarray) -> np.ndarray:
        spots = _spots(langs, which, prefixes, at, self.bits)
        return (self.held[spots >> 6] >> (spots & 63).astype(np.uint64)) & np.uint64(1) > 0


def _filter_of(kept: DataFrame, bits: int) -> _Filter:
    """The filter of ``(lang, term)`` rows; at most ``bits / 64`` numbers reach the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, which = _coded(batch.column("lang"))
            spots = _spots(langs.to_pylist(), which, batch.column("term").to_pylist(), np.arange(batch.num_rows), bits)
            words, place = np.unique(spots >> 6, return_inverse=True)
            marks = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(marks, place, np.uint64(1) << (spots & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(marks.view(np.int64))], ["word", "mark"])

    found = kept.select("lang", "term").mapInArrow(mark, "word long, mark long")
    rows = found.groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    return _Filter(rows["word"].to_numpy(), rows["mark"].to_numpy(), bits)


def term_table(docs: DataFrame) -> DataFrame:
    """Settle blocks of documents by their terms, from ``(lang, source, text)`` as bytes."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=BLOCK_BYTES):
            texts = pa.array([t.translate(TERM_BYTES) for t in batch.column("text").to_pylist()], pa.large_binary())
            words = pc.ascii_split_whitespace(texts.view(pa.large_utf8()))
            which = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
            values, codes = _coded(words.flatten().view(pa.large_binary()))
            terms = np.array(values.to_pylist(), object)
            order = np.argsort(terms, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            terms = terms[order].tolist()
            span = max(len(terms), 1)
            pairs, counts = np.unique(which * span + rank[codes], return_counts=True)
            some = np.ones(len(pairs), bool)
            if terms and not terms[0]:  # what lies between two blanks is no term
                some = pairs % span > 0
            pairs, counts = pairs[some], counts[some]
            codes = pairs % span - (bool(terms) and not terms[0])
            langs, lang_of = _coded(batch.column("lang"))
            sources, source_of = _coded(batch.column("source"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([langs.to_pylist()], pa.list_(pa.binary())),
                    pa.array([sources.to_pylist()], pa.list_(pa.binary())),
                    pa.array([lang_of.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([source_of.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([b" ".join(t for t in terms if t)], pa.binary()),
                    pa.array([np.bincount(pairs // span, minlength=batch.num_rows).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([_packed(codes)], pa.binary()),
                    pa.array([_packed(counts)], pa.binary()),
                ],
                [part.split()[0] for part in BLOCKS.split(", ")],
            )

    return settle(docs.mapInArrow(split, BLOCKS), "terms")


def _summed(tables: Iterator[pa.Table], total: str, most: int = MOST_ROWS) -> Iterator[pa.RecordBatch]:
    """Add up the rows of a task that agree in all other columns, holding about ``most`` rows at a time."""
    held, size = [], 0

    def added() -> pa.Table:
        rows = pa.concat_tables(held)
        names = rows.column_names
        keys = [c for c in names if c != total]
        found = rows.group_by(keys, use_threads=False).aggregate([(total, "sum")])
        return found.rename_columns([*keys, total] if found.column_names[-1].endswith("_sum") else [total, *keys]).select(names)

    for rows in tables:
        held.append(rows)
        size += rows.num_rows
        if size > most:
            held = [added()]
            size = held[0].num_rows
            if 2 * size > most:
                yield from held[0].combine_chunks().to_batches()
                held, size = [], 0
    if held:
        yield from added().combine_chunks().to_batches()


def prefix_counts(blocks: DataFrame, before: int, width: int, open_: _Filter | None) -> DataFrame:
    """``(lang, term, docs)`` of prefixes of ``width`` bytes and of whole terms shorter than that.

    Terms that were whole at the level ``before`` are passed over, as are those whose prefix there was dropped. Within a document
    terms ascend, so equal prefixes stand together and are counted once.
    """

    def counted(block: _Block) -> pa.Table:
        going = np.array([len(t) >= before for t in block.terms], bool)
        codes = block.codes
        if open_ is None:
            allowed = going[codes]
        else:
            pairs, place = block.pairs()
            span = max(len(block.terms), 1)
            passing = going[pairs % span]
            heads, head = _coded(pa.array([t[:before] for t in block.terms], pa.binary()))
            some = pairs[passing]
            passing[passing] = open_.passes(block.langs, some // span, heads.to_pylist(), head[some % span])
            allowed = passing[place]
        prefixes, prefix = _coded(pa.array([t[:width] for t in block.terms], pa.binary()))
        which, own, lang = block.document[allowed], prefix[codes[allowed]], block.lang[allowed]
        new = np.ones(len(which), bool)
        new[1:] = (which[1:] != which[:-1]) | (own[1:] != own[:-1])
        pairs, docs = np.unique(lang[new] * max(len(prefixes), 1) + own[new], return_counts=True)
        langs = pa.array(block.langs, pa.binary()).take(pa.array(pairs // max(len(prefixes), 1)))
        return pa.table({"lang": langs, "term": prefixes.take(pa.array(pairs % max(len(prefixes), 1))), "docs": pa.array(docs, pa.int64())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summed(map(counted, _blocks(batches)), "docs")

    found = blocks.mapInArrow(count, "lang binary, term binary, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def kept_terms(blocks: DataFrame, least: int, bits: int = FILTER_BITS) -> DataFrame:
    """``(lang, term, docs)`` of all terms that at least ``least`` documents of their language hold."""
    whole, before, width, open_ = [], 0, FIRST_WIDTH, None
    while True:
        level = settle(prefix_counts(blocks, before, width, open_).where(F.col("docs") >= least), "prefixes")
        whole.append(level.where(F.octet_length("term") < width))
        longer = level.where(F.octet_length("term") == width)
        if longer.isEmpty():
            return reduce(DataFrame.unionByName, whole)
        before, width, open_ = width, 2 * width, _filter_of(longer, bits)


def group_table(blocks: DataFrame) -> DataFrame:
    """``(lang, source, number)`` of every group that occurs; the number identifies the source."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            groups = np.unique(block.lang_of * len(block.sources) + block.source_of)
            langs = pa.array(block.langs, pa.binary()).take(pa.array(groups // max(len(block.sources), 1)))
            sources = [block.sources[i] for i in (groups % max(len(block.sources), 1)).tolist()]
            numbers = pa.array(_digests(sources).view(np.int64))
            yield pa.RecordBatch.from_arrays([langs, pa.array(sources, pa.binary()), numbers], ["lang", "source", "number"])

    return blocks.mapInArrow(named, "lang binary, source binary, number long").distinct()


def _binaries(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The 64-bit numbers as one binary value for each size."""
    ends = np.concatenate([[0], np.cumsum(sizes)]) * 8
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(numbers.astype(np.int64).tobytes())]
    ).cast(pa.binary())


def _numbers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What ``_binaries`` packed, and how many numbers each value held."""
    held = values.to_pylist()
    return np.frombuffer(b"".join(v for v in held if v), np.int64), np.array([len(v or b"") // 8 for v in held], np.int64)


def _added_up(row: np.ndarray, source: np.ndarray, n: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """Counts of each row by source, packed."""
    names, code = np.unique(source, return_inverse=True)
    pairs, place = np.unique(row * max(len(names), 1) + code, return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, place, n)
    sizes = np.bincount(pairs // max(len(names), 1), minlength=rows)
    return _binaries(names[pairs % max(len(names), 1)], sizes), _binaries(sums, sizes)


def kept_counts(blocks: DataFrame, kept: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """Settle ``(lang, term, sources, counts)``: a row for each kept term, its occurrences by source number packed.

    Each block sends one row for a term, not one for each source. Kept terms join in as rows of their own, without which the
    filter's false hits fall away.
    """
    may = _filter_of(kept, bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            pairs, place = block.pairs()
            span = max(len(block.terms), 1)
            passing = may.passes(block.langs, pairs // span, block.terms, pairs % span)
            allowed = passing[place]
            row = (np.cumsum(passing) - 1)[place[allowed]]
            numbers = _digests(block.sources).view(np.int64)
            source = numbers[block.source_of[block.document[allowed]]] if len(row) else row
            found = pairs[passing]
            sources, counts = _added_up(row, source, block.counts[allowed], len(found))
            langs = pa.array(block.langs, pa.binary()).take(pa.array(found // span))
            terms = pa.array(block.terms, pa.binary()).take(pa.array(found % span))
            for start in range(0, len(found), MOST_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [c.slice(start, MOST_ROWS) for c in (langs, terms, sources, counts)], ["lang", "term", "sources", "counts"]
                )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def merged(rows: pa.Table, final: bool) -> tuple[pa.RecordBatch, pa.Table | None]:
            rows = rows.combine_chunks()
            lang, term = (rows[c].combine_chunks() if isinstance(rows[c], pa.ChunkedArray) else rows[c] for c in ("lang", "term"))
            new = np.ones(rows.num_rows, bool)
            same = pc.and_(pc.equal(lang.slice(1), lang.slice(0, len(lang) - 1)), pc.equal(term.slice(1), term.slice(0, len(term) - 1)))
            new[1:] = ~same.to_numpy(zero_copy_only=False)
            last = rows.num_rows if final else int(np.flatnonzero(new)[-1])  # the last term may go on
            whole, rest = rows.slice(0, last), rows.slice(last)
            group = np.cumsum(new[:last]) - 1
            size = int(group[-1]) + 1 if last else 0
            sources, held = _numbers(whole["sources"].combine_chunks()) if last else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            counts = _numbers(whole["counts"].combine_chunks())[0] if last else sources
            packed = _added_up(np.repeat(group, held), sources, counts, size)
            marked = np.zeros(size, bool)
            marked[group[held == 0]] = True
            first = pa.array(np.flatnonzero(new[:last])[marked])
            keep = pa.array(marked)
            columns = [lang.take(first), term.take(first), *(c.filter(keep) for c in packed)]
            return pa.RecordBatch.from_arrays(columns, ["lang", "term", "sources", "counts"]), rest

        def condensed(rows: pa.Table) -> pa.Table:
            """The rows of one term as a row of sums and, if it was there, its mark."""
            sources, held = _numbers(rows["sources"].combine_chunks())
            n = _numbers(rows["counts"].combine_chunks())[0]
            sums = _added_up(np.zeros(len(n), np.int64), sources, n, 1)
            total = rows.slice(0, 1).drop_columns(["sources", "counts"])
            for name, value in zip(("sources", "counts"), sums, strict=True):
                total = total.append_column(name, value)
            marks = rows.filter(pa.array(held == 0)).slice(0, 1)
            return pa.concat_tables([total, marks]) if len(n) else marks

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            done, rest = merged(pa.concat_tables([waiting, rows]) if waiting is not None else rows, False)
            waiting = condensed(rest)
            yield done
        if waiting is not None and waiting.num_rows:
            yield merged(waiting, True)[0]

    schema = "lang binary, term binary, sources binary, counts binary"
    nothing = F.lit(None).cast("binary")
    marks = kept.select("lang", "term", nothing.alias("sources"), nothing.alias("counts"))
    dealt = blocks.mapInArrow(count, schema).unionByName(marks).repartition("lang", "term").sortWithinPartitions("lang", "term")
    return settle(dealt.mapInArrow(merge, schema), "counts")


def group_sizes(counts: DataFrame) -> DataFrame:
    """``(lang, number, n)``: occurrences of kept terms by group."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang_of = _coded(batch.column("lang"))
            sources, held = _numbers(batch.column("sources"))
            names, code = np.unique(sources, return_inverse=True)
            pairs, place = np.unique(np.repeat(lang_of, held) * max(len(names), 1) + code, return_inverse=True)
            n = np.zeros(len(pairs), np.int64)
            np.add.at(n, place, _numbers(batch.column("counts"))[0])
            lang = langs.take(pa.array(pairs // max(len(names), 1)))
            yield pa.RecordBatch.from_arrays([lang, pa.array(names[pairs % max(len(names), 1)]), pa.array(n)], ["lang", "number", "n"])

    found = counts.mapInArrow(add, "lang binary, number long, n long")
    return found.groupBy("lang", "number").agg(F.sum("n").alias("n"))


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), exact for any counts."""
    if not n.size or int(n.max()) < 9 * 10**9:
        return 1 + UNIT * (n + 1) // total
    n, total = np.broadcast_arrays(n.astype(object), total.astype(object))
    return (1 + UNIT * (n + 1) // total).astype(np.int64)


class _Groups:
    """The groups of one language: their names, and occurrences and number of kept terms."""

    def __init__(self, rows: pa.Table):
        self.sources = rows["name"].to_pylist()
        self.numbers = rows["number"].to_numpy()
        self.place = np.argsort(self.numbers)
        self.held = rows["n"].to_numpy()
        self.kept = rows["kept"][0].as_py()

    def against_each_other(self, p: np.ndarray) -> np.ndarray:
        """Per group and other group the sum over the given terms; all lie below 2**62 as the shares sum to about UNIT."""
        return np.stack([((p[:, [g]] - p) ** 2 // p).sum(axis=0) for g in range(len(self.sources))])

    def found(self, lang: bytes, rows: pa.Table, top: int) -> Iterator[pa.RecordBatch]:
        """Partial sums for pairs of groups, and of each group the ``top`` terms, from some terms' rows in their order."""
        size = len(self.sources)
        terms = rows["term"].combine_chunks()
        sources, held = _numbers(rows["sources"].combine_chunks())
        row_of = np.repeat(np.arange(len(terms)), held)
        group_of = self.place[np.searchsorted(self.numbers, sources, sorter=self.place)]
        n = _numbers(rows["counts"].combine_chunks())[0]
        step = max(1, CELLS // size)
        for first in range(0, len(terms), step):
            a, b = np.searchsorted(row_of, (first, first + step))
            counts = np.zeros((min(step, len(terms) - first), size), np.int64)
            counts[row_of[a:b] - first, group_of[a:b]] = n[a:b]
            p = shares(counts, self.held[None, :] + self.kept)
            yield self.pairs(lang, self.against_each_other(p))
            q = shares(counts.sum(axis=1), self.held.sum() + self.kept)[:, None]
            value = np.where((counts > 0) & (p > q), (p - q) ** 2 // q, -1)
            for g in range(size):
                best = np.argsort(-value[:, g], kind="stable")[:top]
                best = best[value[best, g] >= 0]
                yield self._rows(lang, [self.sources[g]] * len(best), "term", terms.take(pa.array(best + first)), value[best, g])

    def no_terms(self, lang: bytes) -> pa.RecordBatch:
        return self.pairs(lang, np.zeros((len(self.sources), len(self.sources)), np.int64))

    def pairs(self, lang: bytes, sums: np.ndarray) -> pa.RecordBatch:
        one, two = np.nonzero(~np.eye(len(self.sources), dtype=bool))
        names = pa.array(self.sources, pa.binary())
        return self._rows(lang, names.take(pa.array(one)), "pair", names.take(pa.array(two)), sums[one, two])

    def _rows(self, lang: bytes, sources, part: str, items: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        size = len(values)
        held = [pa.array([lang] * size, pa.binary()), pa.array(sources, pa.binary()), pa.array([part] * size, pa.string())]
        return pa.RecordBatch.from_arrays([*held, items, pa.array(values, pa.int64())], ["lang", "source", "part", "item", "value"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, bytes], bool, pa.RecordBatch]]:
    """Rows in a row of one part and language, groups apart from terms."""
    for batch in batches:
        deal, lang = batch.column("deal").to_numpy(), batch.column("lang")
        is_group = batch.column("term").is_null().to_numpy(zero_copy_only=False)
        change = (np.diff(deal) != 0) | (np.diff(_coded(lang)[1]) != 0) | (np.diff(is_group.astype(np.int8)) != 0)
        edges = [0, *(np.flatnonzero(change) + 1), batch.num_rows]
        for start, stop in zip(edges, edges[1:], strict=False):
            if start < stop:
                yield (int(deal[start]), lang[start].as_py()), bool(is_group[start]), batch.slice(start, stop - start)


def parts_for(groups: DataFrame, most: int) -> int:
    """How many parts the terms are dealt to: at most ``most``, and none without ``PART_CELLS`` cells but the first."""
    cells = groups.agg(F.sum("kept").alias("cells")).first()["cells"] or 0
    return max(1, min(most, -(-cells // PART_CELLS)))


def _compared(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """``FOUND`` rows of all terms, dealt by (language, term); each part gets its languages' groups beside its terms.

    The groups of a language are as many as the root of its rows in the result. Each part gives partial results for all groups, so there
    are as many parts as the cells to compare are worth, however many partitions a shuffle has.
    """
    parts = parts_for(groups, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nothing = {c: F.lit(None).cast(kind).alias(c) for c, kind in (("term", "binary"), ("sources", "binary"), ("counts", "binary"),
                                                                  ("number", "long"), ("name", "binary"), ("n", "long"), ("kept", "long"))}
    deal = F.pmod(F.xxhash64("lang", "term"), F.lit(parts)).cast("int").alias("deal")
    dealt = counts.select(deal, "lang", "term", "sources", "counts", *(nothing[c] for c in ("number", "name", "n", "kept")))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("deal")
    beside = groups.select(everywhere, "lang", *(nothing[c] for c in ("term", "sources", "counts")), "number", F.col("source").alias("name"), "n", "kept")
    rows = dealt.unionByName(beside).repartition("deal").sortWithinPartitions("deal", "lang", F.col("term").asc_nulls_first(), "name")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, named, groups, held = None, [], None, []

        def rest() -> Iterator[pa.RecordBatch]:
            beside = groups or (_Groups(pa.Table.from_batches(named)) if named else None)
            if held:
                yield from beside.found(own[1], pa.Table.from_batches(held), top)
            if beside and own[0] == 0:  # each language once
                yield beside.no_terms(own[1])

        for key, is_group, piece in _stretches(batches):
            if key != own:
                yield from rest()
                own, named, groups, held = key, [], None, []
            if is_group:
                named.append(piece)
                continue
            groups = groups or _Groups(pa.Table.from_batches(named))
            held.append(piece)
            if sum(p.num_rows for p in held) >= CELLS:
                yield from groups.found(own[1], pa.Table.from_batches(held), top)
                held = []
        yield from rest()

    return rows.mapInArrow(compare, FOUND)


def audit(docs: DataFrame, least: int = 3, top: int = 200, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (lang, source) group.

    Every row is a document. Null text, lang and source are empty, an empty text has no terms but its group counts; repeated
    rows count each. Texts of any length are read whole. Ties rank by the item's bytes. An empty table gives no rows, and
    other columns are not looked at.
    """
    named = docs.select(*columns(docs, lang=lang, source=source, text=text))
    named = named.select(*(text_of(c).cast("binary").alias(c) for c in ("lang", "source", "text")))
    blocks = term_table(named)
    kept = kept_terms(blocks, least)
    counts = kept_counts(blocks, kept)
    held = group_sizes(counts)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    groups = group_table(blocks).join(held, ["lang", "number"], "left").join(sizes, "lang", "left")
    groups = settle(
        groups.select("lang", "source", "number", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups"
    )
    found = settle(_compared(counts, groups, top), "found")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(own)).unionByName(
        found.where("part = 'term'").withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= top)
    )
    return ranked.select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")), "value", F.col("rank").cast("int").alias("rank"))
