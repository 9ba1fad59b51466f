"""License scans: an exact set-similarity join between text blocks and license templates.

Words are ordered by how many documents hold them, rarest first. A template of n words matches a block if
the block holds at least ``need`` of them; then one of its n - need + 1 rarest must be there (prefix), the
block must hold ``need`` template words at all (length), and the words from the first common one on must
suffice (position). Only blocks around a prefix word are formed, and only (block, template) pairs that pass
the filters are verified, by intersection. Blocks overlap by half, and templates are at most half a block
long, so every run of words as long as a template lies in some block whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsense.llm.base import columns, slices, text_of

#: Fixed value: A-Z become a-z, other ASCII characters but 0-9 and a-z become blanks, all else stays.
KEEP = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words of a block, by the longest template it serves (half of it).
BLOCKS = (32, 512)
CONTAINMENT = 0.8


@dataclass(frozen=True)
class Template:
    """``phrase``: the words must stand in a row, and every such place counts."""

    label: str
    text: str
    containment: float = CONTAINMENT
    phrase: bool = False

    @property
    def words(self) -> list[bytes]:
        return self.text.encode().translate(KEEP).split()

    @property
    def block(self) -> int:
        return next(size for size in BLOCKS if 2 * len(self.words) <= size)


#: Phrases of the query.
PHRASES = (
    Template("mit", "under the mit license", 1.0, True),
    Template("apache-2", "apache license version 2", 1.0, True),
    Template("cc-by-nc", "cc by nc", 1.0, True),
)
#: Notices and key sentences of public licenses. Short notices must be there whole.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),  # noqa: E501
    Template("mit", "SPDX-License-Identifier: MIT", 1.0),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),  # noqa: E501
    Template("apache-2", "SPDX-License-Identifier: Apache-2.0", 1.0),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),  # noqa: E501
    Template("gpl-3", "GNU General Public License version 3", 1.0),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),  # noqa: E501
    Template("lgpl", "GNU Lesser General Public License", 1.0),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),  # noqa: E501
    Template("cc-by-nc", "Creative Commons Attribution-NonCommercial", 1.0),
    Template("cc-by-sa", "Creative Commons Attribution-ShareAlike", 1.0),
)
FORMED = "row long, key long, n_words long, blocks array<struct<size:int,begin:long,words:array<int>>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(KEEP).split()


def word_ranks(rows: DataFrame, vocabulary: list[bytes]) -> dict[bytes, int]:
    """Template words by rising document count over all documents, ties by spelling; one row per template word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {word: i for i, word in enumerate(vocabulary)}
        wanted, total = set(vocabulary), np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches):
            for text in batch.column("text").to_pylist():
                for word in wanted.intersection(words_of(text)):
                    total[number[word]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["word", "n"])

    counts = rows.select("text").mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    held = {r["word"]: r["n"] for r in counts.collect()}
    order = sorted(range(len(vocabulary)), key=lambda i: (held.get(i, 0), vocabulary[i]))
    return {vocabulary[i]: rank for rank, i in enumerate(order)}


def indexed(templates: Sequence[Template], ranks: dict[bytes, int]) -> list[tuple]:
    """A row for each prefix word of each template."""
    rows = []
    for number, template in enumerate(templates):
        words = [ranks[w] for w in template.words]
        distinct = sorted(set(words))
        need = math.ceil(round(template.containment * len(distinct), 9))
        for place, rank in enumerate(distinct[: len(distinct) - need + 1]):
            rows.append((number, template.block, rank, place, need, distinct, words, template.label, template.phrase))
    return rows


INDEX = "template int, size int, rank int, place int, need int, distinct array<int>, sequence array<int>, label string, phrase boolean"


def blocks_of(rows: DataFrame, ranks: dict[bytes, int], index: list[tuple]) -> DataFrame:
    """Each document's word count, and its blocks that hold a prefix word, as word ranks (-1: no template word)."""
    prefixes = {size: np.zeros(len(ranks) + 1, bool) for size in BLOCKS}
    for _, size, rank, *_ in index:
        prefixes[size][rank] = True

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lengths, blocks = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                codes = np.fromiter(map(ranks.get, words, repeat(-1)), np.int32, len(words))
                own = []
                for size, wanted in prefixes.items():
                    step = size // 2
                    near = np.flatnonzero(wanted[codes]) // step
                    for block in np.unique(np.concatenate((near, near - 1))):
                        if block >= 0:
                            held = codes[block * step : block * step + size]
                            own.append({"size": size, "begin": int(block * step), "words": held})
                lengths.append(len(words))
                blocks.append(own)
            kind = pa.list_(pa.struct([("size", pa.int32()), ("begin", pa.int64()), ("words", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("key"), pa.array(lengths, pa.int64()), pa.array(blocks, kind)],
                ["row", "key", "n_words", "blocks"],
            )

    return rows.mapInArrow(form, FORMED)


def matches(docs: DataFrame, templates: Sequence[Template], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with every match: row, key, n_words, block begin and size, label, phrase, score, places.

    A document without matches has one row, with null label. Places (word numbers) are given for phrases. A
    match whose block overlaps another's is found in both. Null texts are empty; null or shared keys and equal rows
    are documents of their own; no rows give no rows. Other columns are not looked at.
    """
    named = docs.select(*columns(docs, key=key, text=text))
    rows = named.select(F.monotonically_increasing_id().alias("row"), F.col("key").cast("long"), text_of().alias("text"))
    vocabulary = sorted({w for template in templates for w in template.words})
    ranks = word_ranks(rows, vocabulary)
    index = indexed(templates, ranks)
    prefixes = F.broadcast(docs.sparkSession.createDataFrame(index, INDEX))  # bounded by the templates
    blocks = blocks_of(rows, ranks, index).select("row", "key", "n_words", F.explode_outer("blocks").alias("block"))
    held = F.array_sort(F.array_distinct(F.filter("block.words", lambda w: w >= 0)))
    blocks = blocks.select("*", held.alias("held"))
    words = blocks.select("*", F.posexplode_outer("held").alias("at", "held_rank"))
    rest_of_template = F.size("distinct") - F.col("place")
    rest_of_block = F.size("held") - F.col("at")
    passes = (
        (F.col("held_rank") == F.col("rank"))
        & (F.col("block.size") == F.col("size"))
        & (F.size("held") >= F.col("need"))
        & (F.least(rest_of_template, rest_of_block) >= F.col("need"))
    )
    found = words.join(prefixes, passes, "left")
    common = F.array_intersect("held", "distinct")
    # Several prefix words may lead to one pair; the first common word stands for it.
    enough = (F.size(common) >= F.col("need")) & (F.element_at(common, 1) == F.col("rank"))
    places = F.transform(
        F.filter(
            F.sequence(F.lit(0), (F.col("size") / 2 - 1).cast("int")),
            lambda i: F.slice("block.words", i + 1, F.size("sequence")) == F.col("sequence"),
        ),
        lambda i: i.cast("long") + F.col("block.begin"),
    )
    found = found.withColumn("ok", F.coalesce(enough, F.lit(False)))
    when = lambda c: F.when(F.col("ok"), c)
    return found.select(
        "row", "key", "n_words",
        when(F.col("block.begin")).alias("begin"), when(F.col("size")).alias("size"), when(F.col("label")).alias("label"),
        when(F.col("phrase")).alias("phrase"), when(F.size(common) / F.size("distinct")).alias("score"),
        F.when(F.col("ok") & F.col("phrase"), places).alias("places"),
    )


def report(found: DataFrame) -> DataFrame:
    """One row per document: key, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    counts = F.col("label").isNotNull() & (~F.col("phrase") | (F.size("places") > 0))
    return (
        found.withColumn("counts", F.coalesce(counts, F.lit(False)))
        .groupBy("row")
        .agg(
            F.first("key").alias("key"),
            F.first("n_words").alias("n_words"),
            F.coalesce(F.sum(F.when(F.col("places").isNotNull(), F.size("places"))), F.lit(0)).alias("n_base"),
            F.min(F.array_min("places")).alias("first_word"),
            F.max(F.array_max("places")).alias("last_word"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("counts") & F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.collect_set(F.when(F.col("counts"), F.col("label")))), ",").alias("labels"),
            F.coalesce(F.max(F.when(F.col("counts"), F.col("score"))), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
