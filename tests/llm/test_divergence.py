"""The divergence audit against plain reckoning."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridsense.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "lang string, source string, text string, terms int, deal int, n string"


def plainly(rows, least, top):
    held, documents = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        held[lang or "", source or ""].update(terms)
        documents[lang or ""].update(set(terms))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in documents.items()}

    def shares(counts, terms):
        total = sum(counts[t] for t in terms) + len(terms)
        return {t: 1 + 10**9 * (counts[t] + 1) // total for t in terms}

    found = set()
    for (lang, source), counts in held.items():
        terms = kept[lang]
        p = shares(counts, terms)
        others = {o: shares(c, terms) for (k, o), c in held.items() if k == lang and o != source}
        pairs = [(-sum((p[t] - q[t]) ** 2 // q[t] for t in terms), other.encode(), other) for other, q in others.items()]
        whole = Counter()
        for (k, _), c in held.items():
            whole.update(c if k == lang else {})
        q = shares(whole, terms)
        items = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in terms if counts[t] and p[t] > q[t]]
        for part, listed in (("pair", sorted(pairs)), ("term", sorted(items)[:top])):
            found |= {(lang, source, part, item, -value, i + 1) for i, (value, _, item) in enumerate(listed)}
    return found


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 9))) for _ in range(150)] + ["long" * 40, "long" * 40 + "er", "日本語", "ſ", "ÉTÉ"]
    weights = [1 / (i + 1) for i in range(len(words))]
    made = []
    for i in range(160):
        text = " ".join(rnd.choices(words, weights, k=rnd.choice([0, 1, 5, 60])))
        made.append((rnd.choice(["en", "de", "", None]), rnd.choice(["s1", "s2", "s3", None]), rnd.choice([text, text.upper(), text.replace(" ", "-7_")])))
    made += [("en", "s1", "once ONCE twice")] * 3 + [("xx", "alone", "a a b"), ("yy", "p", None), ("yy", "q", ""), ("zz", "only", "q w e")]
    made += [("en", "s9", "rare words nowhere else"), ("en", "long", " ".join(words) * 30)]
    return made


@pytest.mark.parametrize("least, top", [(3, 200), (1, 5)])
def test_rows_equal_plain_reckoning(spark, rows, least, top):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(3)
    found = [tuple(r) for r in divergence.audit(df, least, top).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plainly(rows, least, top)


def test_a_full_filter_and_small_blocks_change_nothing(spark, rows, monkeypatch):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "FIRST_WIDTH", 1)
    monkeypatch.setattr(divergence.kept_terms, "__defaults__", (64,))
    monkeypatch.setattr(divergence.kept_counts, "__defaults__", (64,))
    assert {tuple(r) for r in divergence.audit(df).collect()} == plainly(rows, 3, 200)


def test_rows_of_a_term_that_come_in_many_batches_are_added_up(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert {tuple(r) for r in divergence.audit(df).collect()} == plainly(rows, 3, 200)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_for_large_counts():
    n, total = np.array([10**13 + 7, 0]), np.array([3 * 10**13])
    assert divergence.shares(n, total).tolist() == [1 + 10**9 * (10**13 + 8) // (3 * 10**13), 1]


def test_partial_results_follow_the_terms_not_the_partitions(spark):
    """Two sources with few terms are one part, whatever the number of partitions; many cells are dealt to all."""
    groups = "lang string, source string, kept long"
    small = spark.createDataFrame([("en", "a", 50), ("en", "b", 50)], groups)
    large = spark.createDataFrame([("en", "a", 10**6), ("en", "b", 10**6)], groups)
    assert divergence.parts_for(small, 211) == 1 and divergence.parts_for(small.where("false"), 211) == 1
    assert divergence.parts_for(large, 211) == 8 and divergence.parts_for(large, 4) == 4
