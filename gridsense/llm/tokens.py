"""Texts to token ids with a public vocabulary, fast where words come again."""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What parts pieces that are encoded together, and the letter that stands for it in byte-level vocabularies.
MARK, MARK_LETTER = "\x01", "\u0101"
GROUP = 100

#: What each byte is for the cuts. Of the other bytes, ``LATIN`` opens the UTF-8 of U+00C0 to U+00FF, all letters but two signs.
BLANK, LETTER, SIGN, LATIN = 1, 2, 3, 0xC3
KINDS = np.zeros(256, np.uint8)
KINDS[[ord(c) for c in " \n"]] = BLANK
KINDS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = SIGN
KINDS[[c for c in range(0x21, 0x7F) if chr(c).isalpha()]] = LETTER
LATIN_LETTERS = np.ones(256, bool)
LATIN_LETTERS[[0x97, 0xB7]] = False
_LOADED: dict[str, "PieceTokenizer"] = {}


class Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


class PieceTokenizer:
    """Gives the ids that the tokenizers library gives for whole texts, asking it once for each distinct piece.

    A text is cut before each space and line feed that follows a character other than white space, and
    between a letter (ASCII or Latin-1) and an ASCII sign that is neither letter nor digit. The
    pre-tokenizers of the vocabularies in use never join across such places (white space only opens a
    pre-token, never ends one that began with something else; letters and signs are never in one, but for
    contractions, which begin with their sign), so the ids of the text are those of its
    pieces in a row. Texts with longer runs of white space, and texts that hold the spelling of an added token,
    which becomes that token, are encoded whole. ``most`` bounds the pieces remembered; beyond it they are
    forgotten and asked for again.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        # Where no longer token holds the mark it changes nothing beside it; else a blank keeps it apart.
        alone = [t for t in self.library.get_vocab() if MARK_LETTER in t] == [MARK_LETTER]
        self.parting = MARK if alone else f" {MARK}"
        self.mark = self.library.encode(self.parting, add_special_tokens=False).ids
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.store = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 14, np.int32)
        self.length = np.empty(1 << 14, np.int32)
        self.open = np.empty(1 << 14, bool)
        self.known = 0

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[np.ndarray]:
        if len(self.numbers) > self.most:
            self.forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        pieces, ends = cut(texts)
        # Equal pieces are brought together by Arrow, so Python sees each distinct one of these texts once.
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        keys = distinct.to_numpy(zero_copy_only=False).tolist()  # sooner done than to_pylist, which makes a scalar of each
        own = np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))
        self.learn(distinct.filter(pa.array(own >= self.known)))
        each = coded.indices.to_numpy()
        lengths = self.length[own][each]
        upto = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        # Where each id lies in the store: its piece's place there, less the ids before the piece, plus the ids before itself.
        at = np.repeat((self.start[own][each] - upto[:-1]).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        found = np.split(self.store[at], upto[ends[:-1]]) if len(ends) else []
        odd = set()
        if self.open[own].any():
            unsafe = self.open[own][each]
            unsafe[ends[ends > 0] - 1] = False
            odd = set(np.searchsorted(ends, np.flatnonzero(unsafe), side="right").tolist())
        odd |= set(np.flatnonzero(self.holds_added(texts)).tolist())
        for i in sorted(odd):
            found[i] = self.whole([texts[i].as_py()])[0]
        # Arrow keeps what its arrays held for the next ones; a worker lives on, and other steps want that memory.
        del pieces, coded, distinct, each, keys
        pa.default_memory_pool().release_unused()
        return found

    def holds_added(self, texts: pa.Array) -> np.ndarray:
        held = np.zeros(len(texts), bool)
        for spelling in self.added:
            held |= pc.match_substring(texts, spelling).to_numpy(zero_copy_only=False)
        return held

    def learn(self, pieces: pa.Array) -> None:
        """Encode the pieces that were numbered since the last call, given in the order of their numbers."""
        if not len(pieces):
            return
        texts = pieces.cast(pa.string())
        new = texts.to_numpy(zero_copy_only=False).tolist()
        ended = np.array([p[-1:].isspace() for p in new])
        apart = ended | ~opens(texts) | self.holds_added(texts) | pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False)
        total = self.known + len(new)
        self.start, self.length, self.open = (roomy(x, total) for x in (self.start, self.length, self.open))
        self.open[self.known : total] = ended
        together = np.flatnonzero(~apart)
        alone = np.flatnonzero(apart)
        for first in range(0, len(together), GROUP):
            members = together[first : first + GROUP]
            row = self.whole([self.parting.join([new[i] for i in members])])[0]
            cuts = np.flatnonzero(row == self.mark[-1])
            if len(cuts) + 1 != len(members):
                alone = np.concatenate((alone, members))
                continue
            # The marks stay between the pieces' ids; no piece counts them as its own.
            begins = np.concatenate(([0], cuts + 1))
            self.keep(row, members, begins, np.concatenate((cuts - (len(self.mark) - 1), [len(row)])) - begins)
        for first in range(0, len(alone), GROUP):
            members = alone[first : first + GROUP]
            found = self.whole([new[i] for i in members])
            lengths = np.array([len(x) for x in found], np.int64)
            self.keep(np.concatenate(found), members, np.cumsum(lengths) - lengths, lengths)
        self.known = total

    def keep(self, row: np.ndarray, members: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> None:
        """Store a run of ids and where in it each of the new pieces has its own."""
        self.store = roomy(self.store, self.used + len(row))
        self.store[self.used : self.used + len(row)] = row
        self.start[self.known + members] = self.used + begins
        self.length[self.known + members] = lengths
        self.used += len(row)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pieces of all texts as views of their bytes, and behind which piece each text ends."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    held = texts.buffers()[2] if len(texts) else None
    raw = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0]
    kind = KINDS[raw]
    first = kind == BLANK
    letter = kind == LETTER
    letter[1:] |= (raw[:-1] == LATIN) & LATIN_LETTERS[raw[1:]]
    first[1:] |= letter[:-1] & (kind[1:] == SIGN)
    first[bounds[:-1][bounds[:-1] < bounds[1:]]] = True
    starts = np.flatnonzero(first).astype(np.int32)
    places = pa.py_buffer(np.append(starts, np.int32(len(raw))))
    pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, places, pa.py_buffer(raw)])
    return pieces, np.searchsorted(starts, bounds[1:])


def opens(pieces: pa.Array) -> np.ndarray:
    """Whether each piece, none empty, begins with a blank or ASCII letter, so that a mark before it stays a pre-token's end."""
    offsets = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces)]
    kind = KINDS[np.frombuffer(pieces.buffers()[2], np.uint8)[offsets]]
    return (kind == BLANK) | (kind == LETTER)


def roomy(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.empty(max(size, 2 * len(array)), array.dtype)
    larger[: len(array)] = array
    return larger


def tokenizer(path: str) -> PieceTokenizer:
    """The tokenizer of this worker, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = PieceTokenizer(path)
    return _LOADED[path]


def encoded(path: str, texts: Iterable[str | None] | pa.Array) -> list[np.ndarray]:
    if isinstance(texts, pa.Array):
        return tokenizer(path).encode(texts.cast(pa.string()).fill_null(""))
    return tokenizer(path).encode([text or "" for text in texts])
