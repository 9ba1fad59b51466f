import math
import random

import pytest

from gridsense import QueryIssue, run
from gridsense.operators import ranked
from pyspark.sql import functions as F

VALUES = ("v double, t string", [(1.0, "a"), (2.0, "b"), (2.0, None), (4.0, "a"), (None, "c"), (float("nan"), "c")])


def one(ask, operation, columns=("v",), **extra):
    rows = ask(*VALUES, {"operation": operation, "columns": list(columns), **extra})
    assert len(rows) == 1
    return list(rows[0].values())[0]


@pytest.mark.parametrize(
    "operation, value",
    [("count", 6), ("sum", 9.0), ("avg", 2.25), ("mean", 2.25), ("max", 4.0), ("min", 1.0), ("median", 2.0), ("mode", 2.0),
     ("distinct_count", 3), ("null_count", 2), ("null_pct", 33.3333), ("missing", 2)],
)
def test_scalars(ask, operation, value):
    assert one(ask, operation) == value


def test_spread_is_that_of_a_sample(ask):
    assert one(ask, "variance") == pytest.approx(1.5833333)
    assert one(ask, "stdev") == pytest.approx(math.sqrt(1.5833333))


@pytest.mark.parametrize("percentile, value", [(0.25, 1.75), (25, 1.75), (75, 2.5), (1, 4.0), ("90", 3.4), (0, 1.0)])
def test_quantiles(ask, percentile, value):
    assert one(ask, "quantile", percentile=percentile) == pytest.approx(value)


@pytest.mark.parametrize("percentile", ["many", 101, -0.1])
def test_bad_quantiles(frame, percentile):
    with pytest.raises(QueryIssue):
        run(frame(*VALUES), {"operation": "quantile", "columns": ["v"], "percentile": percentile})


def test_smallest_mode_wins(ask):
    assert ask("v int", [3, 1, 3, 1, 2], {"operation": "mode", "columns": ["v"]}) == [{"mode_v": 1}]


def test_text_numbers_are_read(ask):
    rows = ["12", "3f", "7.5", "N/A", "40"]
    assert ask("s string", rows, {"operation": "avg", "columns": ["s"]})[0]["avg_s"] == pytest.approx(59.5 / 3)


@pytest.mark.parametrize(
    "request_",
    [{"operation": "sum", "columns": ["t"]}, {"operation": "sum", "columns": ["nowhere"]}, {"operation": "sum"},
     {"operation": "correlation", "columns": ["v"]}, {"operation": "histogram", "columns": ["t"]},
     {"operation": "value_counts"}],
)
def test_nothing_to_compute(frame, request_):
    with pytest.raises(QueryIssue):
        run(frame(*VALUES), request_)


def test_partial_success(frame):
    result = run(frame(*VALUES), {"operation": "avg|correlation", "columns": ["v"]})
    assert result.rows() == [{"avg_v": 2.25}]
    said = [row["_summary"] for row in result.summary_rows().collect()]
    assert said[0] == "Average of v: 2.25" and said[1].startswith("Partial result.") and "correlation" in said[1]


def test_several_operations_and_kinds(frame):
    result = run(frame(*VALUES), {"operation": "avg|sum|histogram", "columns": ["v"], "bins": 2})
    assert result.rows() == [{"avg_v": 2.25, "sum_v": 9.0}]
    assert [r["count"] for r in result.parts["histogram"].orderBy("bin").collect()] == [3, 1]
    assert result.sentences().where("operation = 'sum'").first()["_summary"] == "Sum of v: 9.0"


def test_aggregation_list_without_columns(ask):
    rows = ask(*VALUES, {"aggregations": [{"function": "max", "column": "v"}, {"function": "average", "column": "v"}]})
    assert rows == [{"max_v": 4.0, "avg_v": 2.25}]


def test_empty_table(ask):
    assert ask("v double", [], {"operation": "count|sum|null_pct", "columns": ["v"]}) == [
        {"count": 0, "sum_v": None, "null_pct_v": 0.0}
    ]


def test_correlation_pairs_and_constants(frame):
    rows = [(-1.5, 7.0, 0.25, None), (0.5, 3.0, 0.25, 6.0), (2.0, 0.0, 0.25, -2.0), (3.5, -3.0, 0.25, 1.0)]
    df = frame("x double, y double, flat double, gaps double", rows)
    found = run(df, {"operation": "corr", "columns": ["x", "y", "flat", "gaps"]}).df.collect()
    by_pair = {(r["col_x"], r["col_y"]): r["corr"] for r in found}
    assert len(by_pair) == 16
    assert by_pair["x", "y"] == pytest.approx(-1.0) and by_pair["x", "x"] == 1.0
    assert by_pair["x", "flat"] is None and by_pair["flat", "flat"] is None
    assert by_pair["x", "gaps"] == pytest.approx(-0.6185896) == by_pair["gaps", "x"]


def test_value_counts(frame):
    df = frame("c string, n double", [("A", 1.0), ("B", 1.0), ("A", None), (None, 2.5), ("B", 1.0), ("A", float("nan"))])
    result = run(df, {"operation": "frequency", "columns": ["c"]})
    assert [(r["value"], r["count"]) for r in result.rows()] == [("A", 3), ("B", 2), ("null", 1)]
    assert result.summary_rows().orderBy(F.desc("count")).first()["_summary"] == "Frequency of A in c: 3"
    both = run(df, {"operation": "value_counts", "columns": ["c", "n"], "top_k": 1}).rows()
    assert {(r["column"], r["value"], r["count"]) for r in both} == {("c", "A", 3), ("n", "1.0", 3)}


def histogram(ask, rows, bins):
    found = ask("v double", rows, {"operation": "histogram", "columns": ["v"], "bins": bins})
    return [r["count"] for r in found]


def test_histogram(ask):
    assert histogram(ask, [float(i) for i in range(100)], 5) == [20, 20, 20, 20, 20]
    assert histogram(ask, [0.0, 10.0], 4) == [1, 0, 0, 1]
    assert histogram(ask, [0.0, 1.0, 2.0, 2.5, 10.0], 5) == [3, 1, 0, 0, 1]
    assert sum(histogram(ask, [7.0, 7.0, 7.0], 3)) == 3
    assert len(histogram(ask, [1.0, 2.0], "many")) == 10
    assert len(histogram(ask, [1.0, 2.0], 0)) == 1


def test_profile(frame):
    df = frame("name string, pay int, day string, mixed string",
               [("Al", 50, "2023-01-05", "x"), ("Bo", 71, "2023-03-01", "7"), ("Al", None, None, None)])
    rows = {r["column"]: r for r in run(df, {"operation": "describe"}).rows()}
    assert rows["name"]["stats"] == "Count: 3 | Unique: 2"
    assert rows["pay"]["stats"] == "Count: 3 | Unique: 2 | Min: 50 | Max: 71 | Avg: 60.5"
    assert rows["day"]["stats"].endswith("Min Date: 2023-01-05 | Max Date: 2023-03-01")
    assert rows["mixed"]["max"] == 7.0
    wide = frame(", ".join(f"c{i} int" for i in range(30)), [tuple(range(30))])
    assert len(run(wide, {"operation": "profile"}).rows()) == 30


def test_extremes_bring_their_rows(ask):
    rows = [("a", 5.0, 1), ("b", 9.0, 2), ("c", 9.0, 3), ("d", 1.0, 4)]
    schema = "name string, v double, id int"
    top = ask(schema, rows, {"operation": "max", "columns": ["v", "name"]})
    assert top == [{"name": "b", "v": 9.0}, {"name": "c", "v": 9.0}]
    assert ask(schema, rows, {"operation": "max", "columns": ["v", "name"], "limit": 1}) == top[:1]
    assert ask(schema, rows, {"operation": "min", "columns": ["name", "v"]}) == [{"name": "d", "v": 1.0}]
    assert ask(schema, rows, {"operation": "min", "columns": ["v"]}) == [{"min_v": 1.0}]


def test_extreme_sentence(frame):
    result = run(frame("name string, v double", [("a", 5.0), ("b", 9.0)]), {"operation": "max", "columns": ["v", "name"]})
    assert result.summary_rows().first()["_summary"] == "Maximum of v: 9.0"


def test_sentences_describe_the_filters(frame):
    df = frame("region string, order_date string, sales double", [("N", "2024-01-01", 1.0e8), ("S", "2024-01-02", 2.0)])
    request = {"operation": "sum", "columns": ["sales"], "filters": [
        {"column": "region", "operator": "=", "value": "N"}, {"column": "order_date", "operator": ">=", "value": "2024"}]}
    row = run(df, request).summary_rows().first()
    assert row["value"] == 1.0e8
    assert row["_summary"] == "Sum of sales where region is N and order_date after or on 2024: 100000000.0"


def test_no_rows_matched(frame):
    df = frame(*VALUES)
    assert run(df, {"operation": "count", "filters": {"t": "zzz"}}).no_rows_matched()
    assert not run(df, {"operation": "count"}).no_rows_matched()


HOT = "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id % 50) END"
CELLS = [
    "id * 37 % 1009", "id % 4", "CASE WHEN id % 5 = 0 THEN NULL ELSE pow(id % 97, 3) END", "1 + (id * 7919 % 20011) * 1e-12",
    "CASE WHEN id % 2 = 0 THEN -1 ELSE 1 END * pow(10, id % 600 - 300)", "CASE WHEN k = 'hot' THEN NULL ELSE id END",
]


def by_sorting(values, share):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    place = (len(values) - 1) * share
    low, high = values[math.floor(place)], values[math.ceil(place)]
    return low if low == high else low + (high - low) * (place - math.floor(place))


@pytest.mark.parametrize("most, below", [(ranked.MOST_BROADCAST_KEYS, ranked.FEW_BELOW), (ranked.MOST_BROADCAST_KEYS, 5), (1, 5)])
@pytest.mark.parametrize("value", CELLS)
def test_quantiles_equal_sorting(spark, monkeypatch, value, most, below):
    monkeypatch.setattr(ranked, "MOST_BROADCAST_KEYS", most)
    monkeypatch.setattr(ranked, "FEW_BELOW", below)
    df = spark.range(6000).selectExpr("id", f"{HOT} AS k").selectExpr("k", f"CAST({value} AS DOUBLE) AS v")
    held = {}
    for k, v in df.collect():
        held.setdefault(k, []).append(v)
    for share in (0.0, 0.37):
        got = {r["k"]: r["q"] for r in ranked.quantile(df, ["k"], F.col("v"), share, "q").collect()}
        assert got == {k: by_sorting(vs, share) for k, vs in held.items()}
    whole = ranked.quantile(df, [], F.col("v"), 0.83, "q").first()["q"]
    assert whole == by_sorting([v for vs in held.values() for v in vs], 0.83)


def test_digits_ascend_with_values(spark):
    rnd = random.Random(3)
    edges = [0.0, 5e-324, 2.2250738585072014e-308, 3.4028235e38, 3.5e38, 1.7976931348623157e308, float("inf"), 1.0, 1.0000000000000002]
    values = edges + [math.ldexp(rnd.random(), rnd.randint(-1080, 1023)) for _ in range(500)] + [math.nextafter(2.0**k, 0) for k in range(-300, 300)]
    values = sorted(values + [-v for v in values])
    rows = ranked.with_digits(spark.createDataFrame([(v,) for v in values], "__value double")).collect()
    found = sorted(tuple(r[d] for d in ranked.DIGITS) for r in rows)
    assert [f[-1] for f in found] == values


def test_no_group_is_sorted_or_gathered_for_a_quantile(spark):
    df = spark.range(100).selectExpr("id % 2 AS k", "CAST(id AS DOUBLE) AS v")
    text = ranked.quantile(df, ["k"], F.col("v"), 0.5, "q")._jdf.queryExecution().toString()
    assert "percentile" not in text and "collect_list" not in text


def test_all_missing_groups_stay_in_the_result(frame):
    df = frame("k string, v double", [("a", 1.0), ("b", None)])
    assert run(df, {"operation": "median", "columns": ["v"], "group_by": ["k"]}).rows() == [
        {"k": "a", "median_v": 1.0}, {"k": "b", "median_v": None}
    ]
    assert run(df.where("k = 'b'"), {"operation": "median|mode", "columns": ["v"]}).rows() == [
        {"median_v": None, "mode_v": None}
    ]


def test_estimated_distinct_counts_are_opt_in(spark):
    df = spark.range(50000).selectExpr("id % 1000 AS v")
    estimate = run(df, {"operation": "distinct_count", "columns": ["v"], "approximate": True}).rows()[0]["distinct_count_v"]
    assert estimate == pytest.approx(1000, rel=0.15)


def test_all_columns_are_described(frame):
    from gridsense.operators.statistics import describe

    wide = frame(", ".join(f"c{i} int" for i in range(12)), [tuple(range(12))])
    assert describe(wide, []).count() == 12


def test_quantiles_with_infinities_and_copies(frame, spark):
    rows = [float("-inf"), 3.0, 3.0, 3.0, 8.0, float("inf"), float("inf")]
    df = frame("v double", rows)
    assert ranked.quantile(df, [], F.col("v"), 0.5, "q").first()["q"] == 3.0
    assert ranked.quantile(df, [], F.col("v"), 1.0, "q").first()["q"] == float("inf")


def test_mode_of_large_ids_keeps_every_digit(ask):
    ids = [9007199254740993, 9007199254740992, 9007199254740995, 9007199254740995]
    assert ask("v bigint", ids, {"operation": "mode", "columns": ["v"]}) == [{"mode_v": 9007199254740995}]
