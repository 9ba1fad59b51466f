"""How the tokens of two tokenizers lie over the same bytes, and how often two tokens meet in the corpus.

Each text is cut by both tokenizers; a token covers bytes, and the byte offsets where it ends form one ascending list per
tokenizer. The shorter list drives a search into the longer one: from a place guessed by proportion, steps double until
they pass the offset, then the bracket is halved. All offsets of a block of documents take each step together. Offsets found in
both lists cut the tokens into groups, and the difference of two neighbouring ranks is the range of tokens that a token overlaps.

Counts of linked ids come from the whole corpus. Documents are handled in blocks of bounded bytes; what is shuffled is each
block's distinct pairs, so the most frequent pair is one row a block, never one a document or link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.llm.base import columns, settle, slices, text_of
from gridsense.llm.token_files import from_planes, planes

BLOCK_BYTES = 3_000_000
#: A link's key is A's id above, B's id in the low bits.
LOW = 32
SETTLED = (
    "block long, row long, key long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, pairs binary, times binary"
)
RESULT = "key long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
DOCUMENT = ["key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Spellings of ids with what follows them: a comma, a bar, a semicolon, nothing.
ENDS = (b",", b"|", b";", b"")
SPELLED: list[bytes] = []


class PlainBytes:
    """A byte-level vocabulary that reads the spelling of a special token as plain text.

    The vocabulary's ids follow its merges, so that they serve as ranks. ``bytes`` holds each id's bytes.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        spelled = byte_letters()
        special = library.get_added_tokens_decoder()
        tokens = [library.id_to_token(i) for i in range(library.get_vocab_size(with_added_tokens=True))]
        self.bytes = [special[i].content.encode() if i in special else bytes(spelled[c] for c in t) for i, t in enumerate(tokens)]
        ranks = {token: i for i, token in enumerate(self.bytes) if i not in special}
        self.encoding = tiktoken.Encoding("plain", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(text), np.uint32) for text in texts]


class PlainPieces:
    """A sentencepiece vocabulary for texts that begin with a blank, which it puts before every text by itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = [self._spelling(i) for i in range(self.library.get_piece_size())]

    def _spelling(self, number: int) -> bytes:
        piece = self.library.id_to_piece(number)
        return bytes([int(piece[3:-1], 16)]) if self.library.is_byte(number) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self.library.encode([text[1:] for text in texts], num_threads=1)
        return [np.array(ids, np.uint32) for ids in found]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(other)}}


_LOADED: dict[tuple[type, str], PlainBytes | PlainPieces] = {}


def _loaded(kind: type, path: str) -> PlainBytes | PlainPieces:
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


def galloping(wanted: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each wanted offset the first place in ``first..last`` whose end is not below it; the end at ``last`` never is.

    From the guess, steps double (forwards where the end there is too small, else backwards) until the place is between two
    probes; then the bracket is halved.
    """
    low, high = first - 1, last.copy()  # the place is above low and at most high
    place, step = guess.copy(), 1
    forwards = ends[place] < wanted
    active = np.arange(len(wanted))
    while len(active):
        at, ahead = place[active], forwards[active]
        below = ends[at] < wanted[active]
        low[active] = np.where(below, np.maximum(low[active], at), low[active])
        high[active] = np.where(below, high[active], np.minimum(high[active], at))
        at = np.where(ahead, at + step, at - step)
        going = (below == ahead) & (at > low[active]) & (at < high[active])
        active = active[going]
        place[active] = at[going]
        step *= 2
    active = np.flatnonzero(high - low > 1)
    while len(active):
        middle = (low[active] + high[active]) >> 1
        below = ends[middle] < wanted[active]
        low[active] = np.where(below, middle, low[active])
        high[active] = np.where(below, high[active], middle)
        active = active[high[active] - low[active] > 1]
    return high


class Block:
    """The alignment of a block of documents whose token bytes agree, as one stream of bytes.

    ``a`` and ``b`` are ids, ``n_a`` and ``n_b`` tokens by document, all at least one.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.a, self.b, self.n_a, self.n_b = a, b, n_a, n_b
        self.from_a, self.from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        doc_a, doc_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        first = np.empty(len(a) + len(b), np.int64)  # links as runs: each token of the driving side with a range of the other
        drives_a = n_a <= n_b
        sides = []
        for driving, ends, others, doc, start, other_start, n, other_n in (
            (drives_a, ends_a, ends_b, doc_a, self.from_a, self.from_b, n_a, n_b),
            (~drives_a, ends_b, ends_a, doc_b, self.from_b, self.from_a, n_b, n_a),
        ):
            token = np.flatnonzero(driving[doc])
            own = doc[token]
            low, high = other_start[own], other_start[own] + other_n[own] - 1
            guess = low + (token - start[own]) * other_n[own] // n[own]
            place = galloping(ends[token], others, low, high, guess)
            common = others[place] == ends[token] if len(token) else np.zeros(0, bool)
            begin = np.empty(len(token), np.int64)
            begin[1:] = place[:-1] + common[:-1]
            head = token == start[own]
            begin[head] = low[head]
            sides.append((token, begin, place, common))
        (at, begin_a, place_a, common_a), (bt, begin_b, place_b, common_b) = sides
        # Last tokens of groups on both sides, document by document.
        last_a = np.zeros(len(a), bool)
        last_b = np.zeros(len(b), bool)
        last_a[at[common_a]] = last_b[place_a[common_a]] = True
        last_b[bt[common_b]] = last_a[place_b[common_b]] = True
        self.last_a, self.last_b = last_a, last_b
        runs_a, runs_b = place_a - begin_a + 1, place_b - begin_b + 1
        left = np.concatenate([np.repeat(at, runs_a), _ranges(begin_b, runs_b)])
        right = np.concatenate([_ranges(begin_a, runs_a), np.repeat(bt, runs_b)])
        order = np.argsort(doc_a[left], kind="stable")
        self.left, self.right = left[order], right[order]
        self.n_links = np.bincount(doc_a[left], minlength=len(n_a))
        self.n_groups = np.bincount(doc_a[last_a], minlength=len(n_a))
        self.doc_a, self.doc_b = doc_a, doc_b

    def keys(self) -> np.ndarray:
        return self.a[self.left].astype(np.int64) << LOW | self.b[self.right]

    def spelled(self) -> list[bytes]:
        """Each document's groups as ``a1,a2|b1;a3|b2,b3``."""
        size = len(self.a) + len(self.b)
        group_a = np.cumsum(self.last_a) - self.last_a
        group_b = np.cumsum(self.last_b) - self.last_b
        upto_a = np.flatnonzero(self.last_a) + 1
        upto_b = np.concatenate([[0], np.flatnonzero(self.last_b) + 1])
        where_a = np.arange(len(self.a)) + upto_b[group_a]
        where_b = np.arange(len(self.b)) + upto_a[group_b]
        ids, mark = np.empty(size, np.int64), np.zeros(size, np.int64)
        ids[where_a], ids[where_b] = self.a, self.b
        mark[where_a[self.last_a]], mark[where_b[self.last_b]] = 1, 2
        ends = np.cumsum(self.n_a + self.n_b)
        mark[ends - 1] = 3
        place = ids * 4 + mark
        SPELLED.extend(b"%d%s" % (n >> 2, ENDS[n & 3]) for n in range(len(SPELLED), int(place.max()) + 1))
        starts = (ends - self.n_a - self.n_b).tolist()
        return [b"".join(map(SPELLED.__getitem__, place[x:y].tolist())) for x, y in zip(starts, ends.tolist(), strict=True)]


def _ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... length[0] numbers, then those from begin[1], and so on."""
    before = np.cumsum(length) - length
    return np.repeat(begin - before, length) + np.arange(int(length.sum()))


def aligned_block(texts: list[str], one: PlainBytes, two: PlainPieces) -> tuple[np.ndarray, Block | None]:
    """Which texts have tokens (not empty, all bytes kept by both), and the alignment of these."""
    led = [" " + t if t else "" for t in texts]
    ids_a, ids_b = one.encode(led), two.encode(led)
    fits = np.array(
        [
            bool(t) and t.encode() == b"".join(map(one.bytes.__getitem__, x.tolist())) == b"".join(map(two.bytes.__getitem__, y.tolist()))
            for t, x, y in zip(led, ids_a, ids_b, strict=True)
        ],
        bool,
    )
    kept = np.flatnonzero(fits)
    if not len(kept):
        return fits, None
    sides = []
    for tokenizer, ids in ((one, ids_a), (two, ids_b)):
        flat = np.concatenate([ids[i] for i in kept])
        width = np.array([len(t) for t in tokenizer.bytes], np.int64)
        sides.append((flat, np.array([len(ids[i]) for i in kept], np.int64), np.cumsum(width[flat])))
    (a, n_a, ends_a), (b, n_b, ends_b) = sides
    return fits, Block(a, b, n_a, n_b, ends_a, ends_b)


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """Settle a row for each document (its links as numbers of its block's pairs) and one for each block (its pairs and counts)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _loaded(PlainBytes, bytes_path), _loaded(PlainPieces, pieces_path)
        for batch in slices(batches, size=BLOCK_BYTES):
            fits, found = aligned_block(batch.column("text").to_pylist(), one, two)
            size = batch.num_rows
            numbers = np.zeros((4, size), np.int64)
            digests, links, pairs, times = np.full(size, "", object), np.full(size, None, object), None, None
            if found:
                numbers[:, fits] = found.n_a, found.n_b, found.n_groups, found.n_links
                digests[fits] = [hashlib.sha256(s).hexdigest() for s in found.spelled()]
                keys, code, n = np.unique(found.keys(), return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")  # frequent pairs get small numbers
                rank = np.empty(len(order), np.uint32)
                rank[order] = np.arange(len(order), dtype=np.uint32)
                links[fits] = [planes(own) for own in np.split(rank[code], np.cumsum(found.n_links)[:-1])]
                pairs, times = keys[order].tobytes(), n[order].astype(np.int64).tobytes()
            block = batch.column("row")[0].as_py()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (size + 1), pa.int64()),
                    pa.concat_arrays([batch.column("row"), pa.nulls(1, pa.int64())]),
                    pa.concat_arrays([batch.column("key"), pa.nulls(1, pa.int64())]),
                    *(pa.array([*row.tolist(), None], pa.int64()) for row in numbers),
                    pa.array([*digests, None], pa.string()),
                    pa.array([*links, None], pa.binary()),
                    pa.array([None] * size + [pairs], pa.binary()),
                    pa.array([None] * size + [times], pa.binary()),
                ],
                ["block", "row", "key", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "pairs", "times"],
            )

    return settle(docs.mapInArrow(work, SETTLED), "aligned")


def _pair_rows(blocks: DataFrame) -> DataFrame:
    """``(block, number, a, b, n)`` of the blocks' distinct pairs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("block", "pairs", "times")), strict=True):
                keys = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(keys), block)),
                        pa.array(np.arange(len(keys), dtype=np.int32)),
                        pa.array((keys >> LOW).astype(np.int32)),
                        pa.array((keys & ((1 << LOW) - 1)).astype(np.int32)),
                        pa.array(np.frombuffer(times, np.int64)),
                    ],
                    ["block", "number", "a", "b", "n"],
                )

    held = blocks.where("pairs IS NOT NULL").select("block", "pairs", "times")
    return held.mapInArrow(spread, "block long, number int, a int, b int, n long")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """Settle ``(a, b, count, best)``: links of each id pair in the corpus, and whether no other A id meets this B id more often."""
    counts = _pair_rows(blocks).groupBy("a", "b").agg(F.sum("n").alias("count"))
    counts = settle(counts, "pair-counts")
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return settle(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "pairs")


def _weighed(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """``RESULT`` rows: each block's pair counts meet its documents."""
    pairs = _pair_rows(blocks).drop("n").join(counts, ["a", "b"])
    of_pairs = pairs.select("block", "number", "count", "best", *(F.lit(None).alias(c) for c in DOCUMENT))
    documents = blocks.where("row IS NOT NULL")
    of_documents = documents.select("block", *(F.lit(None).alias(c) for c in ("number", "count", "best")), *DOCUMENT)
    dealt = of_pairs.unionByName(of_documents).repartition("block")
    dealt = dealt.sortWithinPartitions("block", F.col("number").asc_nulls_last())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        counts, bests = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            own = batch.column("block").to_numpy()
            is_pair = batch.column("number").is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(own) != 0) | (np.diff(is_pair.astype(np.int8)) != 0)) + 1), batch.num_rows]
            for start, stop in zip(edges, edges[1:], strict=False):
                if start == stop:
                    continue
                if own[start] != block:
                    block, parts = own[start], []
                    counts = bests = np.zeros(0, np.int64)
                held = batch.slice(start, stop - start)
                if is_pair[start]:
                    best = held.column("best").cast(pa.int8()).to_numpy().astype(np.int64)
                    parts.append((held.column("count").to_numpy(), best))
                    continue
                if parts:
                    counts, bests = (np.concatenate(x) for x in zip(*parts, strict=True))
                    parts = []
                yield _documents(held, counts, bests)

    return dealt.mapInArrow(weigh, RESULT)


def _documents(held: pa.RecordBatch, counts: np.ndarray, bests: np.ndarray) -> pa.RecordBatch:
    n_best, total = [], []
    for data, n in zip(held.column("links").to_pylist(), held.column("n_links").to_pylist(), strict=True):
        own = from_planes(data, n) if n else np.zeros(0, np.uint32)
        n_best.append(int(bests[own].sum()))
        total.append(int(counts[own].sum()))
    named = {name: held.column(name) for name in DOCUMENT if name != "links"}
    named |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(total, pa.int64())}
    order = [part.split()[0] for part in RESULT.split(", ")]
    return pa.RecordBatch.from_arrays([named[c] for c in order], order)


def align(docs: DataFrame, bytes_path: str, pieces_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``RESULT``, one row for each row of ``docs``, from a byte-level vocabulary (A) and a sentencepiece model (B).

    Texts that are null or empty, or whose bytes one of the tokenizers does not keep (a U+2581 in the text, say), have no
    tokens: all numbers are 0 and the digest is ''. Texts of any length are read whole; one beyond ``BLOCK_BYTES`` is a block
    of its own. Repeated rows are documents of their own, null keys stay null, ties among a B id's most frequent pairs are
    all best, and an empty table gives no rows. Other columns are not looked at.
    """
    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(F.monotonically_increasing_id().alias("row"), F.col("key").cast("long"), text_of().alias("text"))
    blocks = aligned(rows, bytes_path, pieces_path)
    return _weighed(blocks, pair_counts(blocks))
