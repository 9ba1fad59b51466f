"""Mixing sources to target weights: iterative proportional fitting over source, language and topic.

Tokens are summed per cell (source, language, topic). Categories without a target count together as
``other``, so the table of cells is bounded by the targets, however many documents there are. Raking scales
it to one set of marginals after another until all hold. A document's probability is its cell's fitted over its actual tokens,
scaled so that the whole keeps as much as it can, and one where that passes one. Documents are then
sampled by a hash of their key: the same documents on every run.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTHER = "other"
ROUNDS, CLOSE = 500, 1e-9
DUST = 1e-9  # what targets leave below this is a rounding error
SEED = 3


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text: table, markup, shouting or prose; nothing for texts without words."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / size
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "empty")
        .when(share(r"\|") > 0.02, "table")
        .when(share(r"[#*$%&<>]") > 0.05, "markup")
        .when(share("[A-Z]") > 0.3, "shouting")
        .otherwise("prose")
    )


def rake(cells: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Scale a table, axis by axis, to marginal shares; categories without tokens are left out of their target."""
    fitted = cells / max(cells.sum(), 1e-300)
    wanted = []
    for axis, target in enumerate(targets):
        there = fitted.sum(axis=tuple(i for i in range(cells.ndim) if i != axis)) > 0
        share = np.where(there, target, 0.0)
        wanted.append(share / share.sum() if share.sum() else there / max(1, there.sum()))
    for _ in range(rounds):
        worst = 0.0
        for axis, target in enumerate(wanted):
            rest = tuple(i for i in range(cells.ndim) if i != axis)
            have = fitted.sum(axis=rest)
            worst = max(worst, np.abs(have - target).max())
            factor = np.divide(target, have, out=np.zeros_like(target), where=have > 0)
            shape = [-1 if i == axis else 1 for i in range(cells.ndim)]
            fitted = fitted * factor.reshape(shape)
        if worst < close:
            break
    return fitted


def probabilities(cells: np.ndarray, fitted: np.ndarray, keep: float) -> np.ndarray:
    """Each cell's sampling probability, so that about ``keep`` of all tokens stay; certain cells leave room to the rest."""
    weight = np.divide(fitted, cells, out=np.zeros_like(fitted), where=cells > 0)
    scale = keep * cells.sum()
    sure = np.zeros(cells.shape, bool)
    for _ in range(cells.size):
        room = keep * cells.sum() - cells[sure].sum()
        free = (weight * cells)[~sure].sum()
        scale = room / free if free > 0 and room > 0 else 0.0
        more = ~sure & (weight * scale > 1)
        if not more.any():
            break
        sure |= more
    return np.where(sure, 1.0, np.minimum(1.0, weight * scale))


def mixed(docs: DataFrame, targets: Mapping[str, Mapping[str, float]], keep: float = 0.8, seed: int = SEED,
          key: str = "doc_id", tokens: Column | None = None, text: str = "text") -> DataFrame:
    """Every row with n_tokens, weight (fitted over actual tokens), probability, draw and kept beside its own columns.

    ``targets`` gives a column's categories and their shares, for any number of columns; null and unlisted
    categories are ``other``. Unless ``other`` has a target of its own, its share is what the targets leave; if they leave
    nothing, it is its share of the corpus's tokens, and the listed categories share the rest as their targets say. Only a
    target of 0 keeps documents out. Tokens are words unless a column of counts is given. The draw depends on key and
    seed; rows that share a key, a null key included, are drawn by a hash of their text as well, equal rows alike. Empty texts have no tokens and take
    their cell's probability, which is ``keep`` in a cell without any. No rows give no rows. Columns of the input named like those added are replaced.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    counted = docs.withColumn("n_tokens", F.regexp_count(body, F.lit(r"[^\x20\x09-\x0D]+")).cast("long") if tokens is None else tokens)
    names = list(targets)
    listed = [[*dict.fromkeys([*targets[name], OTHER])] for name in names]
    category = [
        F.when(F.col(f"`{name}`").cast("string").isin(list(targets[name])), F.col(f"`{name}`").cast("string")).otherwise(OTHER)
        for name in names
    ]
    cells = counted.groupBy(*(c.alias(f"c{i}") for i, c in enumerate(category))).agg(F.sum("n_tokens").alias("n"))
    table = np.zeros([len(x) for x in listed])
    for row in cells.collect():  # at most one row for each combination of listed categories
        table[tuple(listed[i].index(row[f"c{i}"]) for i in range(len(names)))] = row["n"] or 0
    shares, bare = [], table == 0  # bare: cells without tokens that no target keeps out
    for axis, (name, categories) in enumerate(zip(names, listed, strict=True)):
        given = np.array([targets[name].get(c, 0.0) for c in categories], float)
        wanted = given > 0
        if OTHER not in targets[name]:
            wanted[-1] = True
            given[-1] = 1.0 - given.sum()
            if given[-1] < DUST:
                have = table.sum(axis=tuple(i for i in range(table.ndim) if i != axis))
                given[-1] = have[-1] / max(table.sum(), 1)
                there = given[:-1] * (have[:-1] > 0)  # else the share of absent ones would go to other as well
                given[:-1] = there * (1 - given[-1]) / max(there.sum(), DUST)
        shares.append(given)
        bare &= wanted.reshape([-1 if i == axis else 1 for i in range(table.ndim)])
    fitted = rake(table, shares)
    chance = np.where(bare, keep, probabilities(table, fitted, keep))
    weight = np.divide(fitted * table.sum(), table, out=bare.astype(float), where=table > 0)
    rows = [
        (*(listed[i][k] for i, k in enumerate(at)), float(weight[at]), float(chance[at])) for at in np.ndindex(*table.shape)
    ]
    schema = ", ".join([*(f"c{i} string" for i in range(len(names))), "weight double, probability double"])
    plan = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))  # bounded by the targets
    marked = counted.withColumns({f"c{i}": c for i, c in enumerate(category)}).drop("weight", "probability")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.xxhash64(body)), F.lit(1 << 52)) / float(1 << 52)
    joined = marked.join(plan, [f"c{i}" for i in range(len(names))], "left").drop(*(f"c{i}" for i in range(len(names))))
    joined = joined.withColumn("draw", draw)
    return joined.withColumn("kept", F.col("draw") < F.col("probability"))


def with_topic(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("topic", topic_of(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))

