"""Quality rules: statistics of whole documents, two fixed rules, and boosted trees over the statistics.

The trees are fitted on at most about ``SAMPLE`` labelled documents, chosen by hash, with monotonic constraints: more
symbols, repeated lines, repeated words or capitals never raise the score. They are flattened into node arrays and
score whole Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.functions.names import field
from gridsense.llm.base import columns, slices, text_of
from gridsense.llm.boosting import Trees, fit

SAMPLE = 20_000
#: Documents are rejected below this probability of good quality.
KEEP = 0.5
SYMBOLS = re.compile(r"[#*$%&|<>]")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature, and the direction in which it may move the score.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "capital_share": -1, "digit_share": 0, "distinct_share": 1, "line_words": 0, "stop_share": 0,
}
JUDGED = ", ".join(["key long", *(f"{name} long" for name in BASE), "base_failed boolean", "score double", "kept boolean"])


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The fixed counts and the features of one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    number: dict[bytes, int] = {}
    codes = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        windows = np.stack([codes[:-2], codes[1:-1], codes[2:]], axis=1)
        if len(number) < 1 << 21:
            keys = (windows[:, 0] * len(number) + windows[:, 1]) * len(number) + windows[:, 2]
            _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        else:
            _, which, times = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
        again = times[which.reshape(-1)] > 1
        covered = np.zeros(n, bool)
        for shift in range(3):
            covered[shift : shift + n - 2] |= again
        repeated = int(covered.sum())
    lines = [line for line in raw.split(b"\n") if line and not line.isspace()]
    dup_lines = len(lines) - len(set(lines))
    word_chars = len(b"".join(words).decode())
    symbols = len(SYMBOLS.findall(text))
    size = max(1, word_chars)
    capitals = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    short = sum(1 for w in number if len(w) <= 3)
    features = [
        float(np.log1p(n)), word_chars / max(1, n), symbols / size, dup_lines / max(1, len(lines)), repeated / max(1, n),
        capitals / size, digits / size, len(number) / max(1, n), n / max(1, len(lines)), short / max(1, len(number)),
    ]
    return [n, word_chars, symbols, dup_lines, repeated], features


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text",
            target: str = "quality") -> Trees | None:
    """Trees fitted on labelled documents; None if the labels don't show both kinds.

    ``sample`` bounds the labels used (in expectation, by hash of their key), and so what is broadcast to
    find their documents and what is fetched of them. A key that is repeated on either side counts once.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [statistics(text)[1] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("target"), pa.array(found, pa.list_(pa.float64()))], ["key", "target", "features"]
            )

    given = labels.select(field(key).cast("long").alias("key"), field(target).cast("double").alias("target"))
    given = given.where("key is not null and target is not null")
    share = int(1_000_000 * min(1.0, sample / max(1, given.count())))
    chosen = given.where(F.pmod(F.xxhash64(F.lit(8), "key"), F.lit(1_000_000)) < share)
    chosen = chosen.groupBy("key").agg(F.avg("target").alias("target"))
    named = docs.select(field(key).cast("long").alias("key"), field(text).alias("text")).select("key", text_of().alias("text"))
    features = named.join(F.broadcast(chosen), "key").mapInArrow(measure, "key long, target double, features array<double>")
    once = features.groupBy("key").agg(F.min("target").alias("target"), F.min("features").alias("features"))
    rows = once.orderBy("key").toPandas()
    goal = (rows["target"].to_numpy(float) >= 0.5).astype(float)
    if not len(goal) or goal.min() == goal.max():
        return None
    return fit(np.array(rows["features"].tolist(), float), goal, list(FEATURES.values()))


def verdicts(texts: list[str | None], trees: Trees | None, keep: float) -> tuple[list[list[int]], np.ndarray, np.ndarray | None, np.ndarray]:
    """Fixed counts, base_failed, score and kept of a batch of texts."""
    found = [statistics(text or "") for text in texts]
    counts = np.array([c for c, _ in found], np.int64).reshape(-1, len(BASE))
    words, repeated = counts[:, 0], counts[:, 4]
    failed = (words < 50) | (100 * repeated > 50 * words)
    if trees is None:
        return counts, failed, None, ~failed
    score = 1 / (1 + np.exp(-trees.score(np.array([f for _, f in found], float).reshape(-1, len(FEATURES)))))
    return counts, failed, score, ~failed & (score >= keep)


def judged(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, key: str = "doc_id",
           text: str = "text") -> DataFrame:
    """One row per document: key, the fixed counts, base_failed, score and kept; one pass once the trees are fitted.

    Rejected by the fixed rules: fewer than 50 words, or more than half of the words in repeated windows.
    Null texts have no words. Null keys have no labels. Repeated rows are judged each. Without labels of
    both kinds the fixed rules decide alone and the score is null. No rows give no rows. Other columns are
    not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample, key, text))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, failed, score, kept = verdicts(batch.column("text").to_pylist(), shared.value, keep)
            scores = pa.nulls(batch.num_rows, pa.float64()) if score is None else pa.array(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *map(pa.array, counts.T), pa.array(failed), scores, pa.array(kept)],
                ["key", *BASE, "base_failed", "score", "kept"],
            )

    named = docs.select(*columns(docs, key=key, text=text))
    return named.select(F.col("key").cast("long"), text_of().alias("text")).mapInArrow(judge, JUDGED)


def passing(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, keep: float = KEEP, key: str = "doc_id",
            text: str = "text") -> DataFrame:
    """The rows whose text ``judged`` keeps, with all their columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, sample, key, text))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            kept = verdicts(batch.column(text).to_pylist(), shared.value, keep)[3]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(select, docs.schema)
