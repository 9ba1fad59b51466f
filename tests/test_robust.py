"""Cells, sheets and requests that do not fit: nothing is lost or wrong without being told."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsense import QueryIssue, run
from gridsense.functions import coerce
from gridsense.operators import cleaning, vectors
from gridsense.sources import sheets

DAY = dt.datetime(2023, 1, 5)
SPELLINGS = {
    "2023-01-05": DAY, "2023/1/5": DAY, "2023.01.05": DAY, "20230105": DAY, "05/01/2023": DAY, "5.1.2023": DAY, "5-1-23": DAY, "05.01.23": DAY,
    "5th Jan 2023": DAY, "Mon 5 Jan 2023": DAY, "Thursday, 5 January 2023": DAY, "January 5th, 2023": DAY, "5-Jan-2023": DAY, "Jan. 5, 2023": DAY,
    "05 Jan 2023 10:30": dt.datetime(2023, 1, 5, 10, 30), "2023-01-05T10:30:15.25": dt.datetime(2023, 1, 5, 10, 30, 15, 250000),
    "2023-01-05 10:00Z": dt.datetime(2023, 1, 5, 10), "2023-01-05 10:00+02:00": dt.datetime(2023, 1, 5, 10),
    "2023-01-05 3:00 PM": dt.datetime(2023, 1, 5, 15), "5 January 2023 12:15 am": dt.datetime(2023, 1, 5, 0, 15), "5/1/2023 3 pm": dt.datetime(2023, 1, 5, 15),
    "Sept 2023": dt.datetime(2023, 9, 1), "january 2023": dt.datetime(2023, 1, 1), "12/25/2023": dt.datetime(2023, 12, 25), "22nd of May 2021": dt.datetime(2021, 5, 22),
    "1-2-99": dt.datetime(1999, 2, 1), "2023": None, "soon": None, "": None, "32/13/2023": None, "99999999": None, "1.5": None, "Janitor 5 2023": None,
    "20231301": None, "may 40 2023": None, "1.2.23": None, "5 apples 2023": None,
}


def test_spellings_of_dates(frame):
    df = frame("c string", list(SPELLINGS))
    found = {r["c"]: r["t"] for r in df.select("c", coerce.time_from_text(F.col("c")).alias("t")).collect()}
    assert found == SPELLINGS


def test_sums_of_whole_numbers_do_not_overflow(ask):
    rows = [2**63 - 1, 2**63 - 1, -5]
    assert ask("v bigint", rows, {"operation": "sum", "columns": ["v"]}) == [{"sum_v": 2 * (2**63 - 1) - 5}]
    grouped = {"operation": "sum", "columns": ["v"], "group_by": ["k"]}
    assert ask("k int, v bigint", [(1, r) for r in rows], grouped) == [{"k": 1, "sum_v": 2 * (2**63 - 1) - 5}]


def test_histograms_count_infinities_apart(frame):
    inf = float("inf")
    df = frame("v double", [1.0, 2.0, 3.0, inf, -inf, inf, float("nan"), None])
    rows = run(df, {"operation": "histogram", "columns": ["v"], "bins": 2}).rows()
    assert [(r["bin"], r["bin_lo"], r["bin_hi"], r["count"]) for r in rows] == [(0, -inf, -inf, 1), (1, 1.0, 2.0, 2), (2, 2.0, 3.0, 1), (3, inf, inf, 2)]
    only = run(frame("v double", [inf, inf]), {"operation": "histogram", "columns": ["v"], "bins": 2}).rows()
    assert [(r["bin"], r["count"]) for r in only] == [(3, 2)]


def test_specified_pairs_stay_pairs(ask):
    data = ("x int, y double", [(1, 4.0), (2, 8.0)])
    assert ask(*data, {"aggregations": [{"function": "sum", "column": "x"}, {"function": "avg", "column": "y"}]}) == [{"sum_x": 3, "avg_y": 6.0}]
    assert ask(*data, {"aggregations": [{"function": "max", "column": "x"}, {"function": "max", "column": "y"}]}) == [{"max_x": 2, "max_y": 8.0}]


def test_unknown_columns_are_told(frame):
    df = frame("k string, v int", [("a", 1)])
    chosen = run(df, {"columns": ["v", "nowhere"]})
    assert chosen.rows() == [{"v": 1}] and any("nowhere" in issue for issue in chosen.issues)
    specs = [{"function": "sum", "column": "v"}, {"function": "sum", "column": "elsewhere"}]
    grouped = run(df, {"group_by": ["k"], "aggregations": specs})
    assert grouped.rows() == [{"k": "a", "sum_v": 1}] and any("elsewhere" in issue for issue in grouped.issues)


def test_shown_rows_that_were_cut_are_told(spark):
    result = run(spark.range(20), {})
    assert len(result.rows(limit=7)) == 7 and any("first 7 rows" in issue for issue in result.issues)
    assert not run(spark.range(7), {}).issues


def test_a_bad_pattern_is_refused_before_any_job(frame):
    with pytest.raises(QueryIssue, match="regular expression"):
        run(frame("t string", ["a"]), {"filters": [{"column": "t", "operator": "contains", "value": "(a"}], "regex": True})
    good = {"filters": [{"column": "t", "operator": "contains", "value": "^a+$"}], "regex": True}
    assert run(frame("t string", ["aa", "ab"]), good).rows() == [{"t": "aa"}]


@pytest.mark.parametrize("kind", ["int", "double"])
def test_day_numbers_with_an_outlier(frame, kind):
    df = frame("d double", [20230105.0, 20230207.0, 20221231.0, 0.0, None]).select(F.col("d").cast(kind).alias("d"))
    assert [int(r["d"]) for r in run(df, {"filters": [{"column": "d", "operator": "=", "value": "2023"}]}).rows()] == [20230105, 20230207]
    by_year = {"operation": "count", "group_by": [{"column": "d", "time_grain": "year"}]}
    assert run(df, by_year).rows() == [{"d_year": "2022", "count": 1}, {"d_year": "2023", "count": 2}]
    prices = frame("d double", [2023.0, 5.0, 20230105.0])
    assert run(prices, {"filters": [{"column": "d", "operator": "=", "value": "2023"}]}).rows() == [{"d": 2023.0}]


BOOK = {
    "One": ("code string, n int, Sheet string", [("x7", 1, "own"), ("8", 2, "own")]),
    "Two": ("Code int, n double, sheet string", [(7, 1.5, "mine")]),
}


def test_sheets_of_different_kinds_are_united(frame, tmp_path):
    book = {name: frame(*data).drop("sheet") for name, data in BOOK.items()}
    rows = sheets.flatten(book).select("sheet", "code", "n").collect()
    assert sorted(map(tuple, rows)) == [("One", "8", 2.0), ("One", "x7", 1.0), ("Two", "7", 1.5)]
    asked = run(book, {"operation": "count", "group_by": ["code"]})
    assert sorted((r["sheet"], r["code"], r["count"]) for r in asked.rows()) == [("One", "8", 1), ("One", "x7", 1), ("Two", "7", 1)]
    stored = sheets.store_sheets(book, str(tmp_path / "book"))
    one = run(stored, {"filters": [{"column": "sheet", "operator": "=", "value": "Two"}], "columns": ["code"]}).df
    assert [tuple(r) for r in one.collect()] == [("7",)]
    assert "PartitionFilters: [" in one._jdf.queryExecution().executedPlan().toString()


def test_sheets_with_a_sheet_column_of_their_own(frame):
    found = run({name: frame(*data) for name, data in BOOK.items()}, {"columns": ["code", "sheet"]})
    assert sorted(tuple(r.values()) for r in found.rows()) == [("7", "mine"), ("8", "own"), ("x7", "own")]


def test_row_numbers_do_not_depend_on_the_partitioning(spark, tmp_path):
    for name, start in (("b.csv", 500), ("a.csv", 0)):
        (tmp_path / name).write_text("v\n" + "".join(f"{start + i}\n" for i in range(500)))
    found = []
    for size in ("64m", "300b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "16b")
        try:
            df = spark.read.csv(str(tmp_path), header=True).where("v % 3 = 0")
            found.append(sorted((int(r["id"]), int(r["v"])) for r in cleaning.flat_rows(df).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [v for v in range(1000) if v % 3 == 0]
    assert found[0] == found[1] == list(enumerate(want))


@pytest.mark.parametrize("block", [2_000, 3])
def test_neighbours_of_a_table_of_queries(frame, monkeypatch, block):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
    rng = np.random.default_rng(1)
    held = [(i, rng.normal(size=6).round(1).tolist()) for i in range(300)] + [(300 + i, [0.5] * 6) for i in range(8)]
    odd = [(900, None), (901, [1.0]), (902, [float("nan")] * 6), (903, [None] * 6), (None, [0.5] * 6)]
    df = frame("key bigint, v array<double>", held + odd).repartition(4)
    asked = frame("q bigint, v array<double>", [(i, held[i][1]) for i in range(9)] + [(50, [0.5] * 6), (51, None), (52, [float("nan")] * 6)])
    found = {}
    for row in vectors.nearest_batch(df, asked, "v", "key", "q", 4).orderBy("place").collect():
        found.setdefault(row["query"], []).append((row["key"], row["vector_score"]))
    assert sorted(found) == [*range(9), 50]
    for query, v in [*((i, held[i][1]) for i in range(9)), (50, [0.5] * 6)]:
        scores = sorted((sum((a - b) ** 2 for a, b in zip(w, v, strict=True)), key) for key, w in held)[:4]
        assert [k for k, _ in found[query]] == [k for _, k in scores]
        assert [s for _, s in found[query]] == pytest.approx([s for s, _ in scores])
