"""Cross-tokenizer alignment against plain reckoning, token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from gridsense.llm import alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "héllo <|endoftext|> wörld  a\n\nb\tc <s> </s> <unk> x 日本", "▁x", None, "", "  lead", "tail  ", "\n\nnew\n x", "\0 a\x01 b", " ", "\n",
    "🤗 smile é́   z", "a" * 3000, "x y" * 50, "ﬁ Ａ", "The quick brown fox jumps over the lazy dog, again and again.",
    "The quick brown fox jumps over the lazy dog, again and again.", "den Übergang zwischen Größen und 12345678 Zahlen\r\n",
]


def spans(tokens):
    ends = np.cumsum([len(t) for t in tokens]).tolist()
    return list(zip([0, *ends[:-1]], ends, strict=True))


def plainly(texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
    one.encode_special_tokens = True
    letters = alignment.byte_letters()

    def piece(i):
        name = two.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if two.is_byte(i) else name.replace("▁", " ").encode()

    found, links = [], []
    for text in texts:
        row, own = dict(n_a=0, n_b=0, n_groups=0, n_links=0, groups_sha256=""), []
        if text:
            coded = one.encode(" " + text, add_special_tokens=False)
            a, b = coded.ids, two.encode(text)
            bytes_a, bytes_b = [bytes(letters[c] for c in t) for t in coded.tokens], [piece(i) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                at_a, at_b = spans(bytes_a), spans(bytes_b)
                groups, i, j = [], 0, 0
                for end in sorted({y for _, y in at_a} & {y for _, y in at_b}):
                    i2, j2 = sum(y <= end for _, y in at_a), sum(y <= end for _, y in at_b)
                    groups.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
                    own += [(a[u], b[v]) for u in range(i, i2) for v in range(j, j2) if at_a[u][0] < at_b[v][1] and at_b[v][0] < at_a[u][1]]
                    i, j = i2, j2
                row = dict(n_a=len(a), n_b=len(b), n_groups=len(groups), n_links=len(own),
                           groups_sha256=hashlib.sha256(";".join(groups).encode()).hexdigest())
        found.append(row)
        links.append(own)
    counts = Counter(pair for own in links for pair in own)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    for row, own in zip(found, links, strict=True):
        row["n_best"] = sum(counts[pair] == most[pair[1]] for pair in own)
        row["count_sum"] = sum(counts[pair] for pair in own)
    return found


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    letters = "abcdefgh éß\n  \t<>|_日1"
    return TEXTS + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 120))) for _ in range(60)]


@pytest.mark.parametrize("block", [alignment.BLOCK_BYTES, 200])
def test_rows_equal_plain_reckoning(spark, texts, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block)
    rows = [(i, t, "k", 1, 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row int, block int").repartition(3)
    found = {r["key"]: r.asDict() for r in alignment.align(docs, BYTES, PIECES).collect()}
    want = plainly(texts)
    assert len(found) == len(texts)
    for i, row in enumerate(want):
        assert found[i] == {"key": i, **row}, texts[i]


def test_repeated_null_keyed_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "one text"), (1, "one text"), (None, "one text"), (2, None)], "doc_id long, text string")
    rows = alignment.align(docs, BYTES, PIECES).collect()
    want = plainly(["one text", "one text", "one text", None])
    got = sorted(((r["key"], r["n_links"], r["count_sum"], r["groups_sha256"]) for r in rows), key=repr)
    assert got == sorted(((k, w["n_links"], w["count_sum"], w["groups_sha256"]) for k, w in zip([1, 1, None, 2], want, strict=True)), key=repr)
    assert alignment.align(docs.limit(0), BYTES, PIECES).collect() == []


def test_galloping_finds_the_first_place_not_below():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        ends = np.unique(rnd.integers(0, 400, rnd.integers(1, 80)))
        wanted = np.sort(rnd.integers(0, ends[-1] + 1, rnd.integers(1, 40)))
        first, last = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(ends) - 1)
        guess = rnd.integers(0, len(ends), len(wanted))
        assert alignment.galloping(wanted, ends, first, last, guess).tolist() == np.searchsorted(ends, wanted).tolist()


def test_ids_are_those_of_the_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    found = alignment.PlainBytes(BYTES).encode([" " + t for t in texts if t])
    assert [f.tolist() for f in found] == [library.encode(" " + t, add_special_tokens=False).ids for t in texts if t]


def test_long_runs_are_encoded_whole():
    one, two = alignment.PlainBytes(BYTES), alignment.PlainPieces(PIECES)
    for text in (" " * 200_000, "a" * 200_000, "ab \n" * 50_000, "é" * 50_000):
        fits, block = alignment.aligned_block([text], one, two)
        assert fits[0] and block.n_links[0] >= max(block.n_a[0], block.n_b[0])
