import pytest

from gridsense import QueryIssue, run
from gridsense.functions import literals, names


def values(ask, schema, rows, **request):
    return [row["v"] for row in ask(schema, rows, request)]


def test_numbers_nulls_last_both_ways(ask):
    rows = [3, None, 1, 2]
    assert values(ask, "v int", rows, sort=["v"]) == [1, 2, 3, None]
    for word in ("desc", "DESCENDING", -1, False, "false"):
        assert values(ask, "v int", rows, sort=[{"column": "V", "direction": word}]) == [3, 2, 1, None]


def test_text_by_content(ask):
    assert values(ask, "v string", ["100", "9", "75", "1000", None], sort=[{"column": "v", "direction": "desc"}]) == [
        "1000", "100", "75", "9", None
    ]
    assert values(ask, "v string", ["31/12/2022", "01/01/2023", "15/06/2021"], sort=["v"]) == [
        "15/06/2021", "31/12/2022", "01/01/2023"
    ]
    assert values(ask, "v string", ["beta", "Alpha", "gamma"], sort=["v"]) == ["Alpha", "beta", "gamma"]


def test_seventy_percent_decide(ask):
    seven = ["5", "40", "300", "7", "8", "9", "1000", "x", "y", "z"]
    assert values(ask, "v string", seven, sort=["v"])[:3] == ["5", "7", "8"]
    six = seven[:6] + ["w", "x", "y", "z"]
    assert values(ask, "v string", six, sort=["v"])[:3] == ["300", "40", "5"]


def test_several_keys(ask):
    rows = [("N", 200), ("S", 100), ("N", 100), ("S", 300)]
    got = ask("r string, v int", rows, {"sort": ["r", {"column": "v", "direction": "desc"}]})
    assert [(r["r"], r["v"]) for r in got] == [("N", 200), ("N", 100), ("S", 300), ("S", 100)]


def test_sort_by_a_column_that_is_not_shown(ask):
    assert ask("a int, v int", [(1, 9), (2, 3)], {"columns": ["a"], "sort": ["v"]}) == [{"a": 2}, {"a": 1}]


def test_unknown_sort_column_is_reported(frame):
    result = run(frame("v int", [2, 1]), {"sort": ["w"]})
    assert "w" in result.issues[0] and len(result.rows()) == 2


def test_limits(ask, frame):
    assert values(ask, "v int", list(range(100)), limit=5) == [0, 1, 2, 3, 4]
    assert values(ask, "id int, v string", [(2, "a"), (1, "b"), (3, "c")], limit=2) == ["b", "a"]
    assert run(frame("v int", list(range(1500))), {}).df.count() == 1500
    assert len(run(frame("v int", list(range(1500))), {}).rows()) == 1000
    for bad in ("many", -1):
        with pytest.raises(QueryIssue):
            run(frame("v int", [1]), {"limit": bad})


def test_projection(ask, frame):
    assert ask("a int, b int, c int", [(1, 2, 3)], {"columns": ["C", "a", "zzz", "c"]}) == [{"c": 3, "a": 1}]
    assert ask("a int, b int", [(1, 2)], {"operation": "unknown_op"}) == [{"a": 1, "b": 2}]
    with pytest.raises(QueryIssue):
        run(frame("a int", [1]), {"columns": ["zzz"]})


def test_names():
    columns = ["Total Sales ($)", "total sales", "Société", "é"]
    assert names.resolve(columns, "total sales") == "total sales"
    assert names.resolve(columns, "TOTAL SALES ($)") == "Total Sales ($)"
    assert names.resolve(columns, "totalsales") == "Total Sales ($)"
    assert names.resolve(columns, "à") is None and names.resolve(columns, "") is None and names.resolve(columns, None) is None
    assert names.resolve_all(columns, ["total_sales", "TotalSales", "none"]) == ["Total Sales ($)"]


@pytest.mark.parametrize(
    "texts, operations",
    [(("average",), ["avg"]), (("avg|sum|avg",), ["avg", "sum"]), (("summarise column salary",), ["profile"]),
     (("value counts",), ["value_counts"]), (("percentile",), ["quantile"]), ((None,), ["none"]),
     (("bogus",), ["none"]), (("filter", "max"), ["filter", "max"]), (("unique count",), ["count"])],
)
def test_operation_names(texts, operations):
    assert names.operations_in(*texts) == operations


@pytest.mark.parametrize(
    "text, start, end",
    [("2023", "2023-01-01", "2024-01-01"), ("2023Q4", "2023-10-01", "2024-01-01"), ("2023-q1", "2023-01-01", "2023-04-01"),
     ("Q2 2023", "2023-04-01", "2023-07-01"), ("2023-12", "2023-12-01", "2024-01-01"), ("3/2023", "2023-03-01", "2023-04-01"),
     ("March 2023", "2023-03-01", "2023-04-01")],
)
def test_periods(text, start, end):
    span = literals.period_of(text)
    assert (span.start.date().isoformat(), span.end.date().isoformat()) == (start, end)


@pytest.mark.parametrize("text", ["2023-13", "12345", "2023-01-05", "", "north", None])
def test_not_periods(text):
    assert literals.period_of(text) is None


@pytest.mark.parametrize(
    "text, day_first, moment",
    [("2023-01-05", True, "2023-01-05"), ("05/01/2023", True, "2023-01-05"), ("05/01/2023", False, "2023-05-01"),
     ("25/01/2023", False, "2023-01-25"), ("5 Jan 2023", False, "2023-01-05"), ("January 5, 2023", False, "2023-01-05"),
     ("20230105", False, "2023-01-05"), ("12", False, None), ("AB-12", False, None), (None, False, None)],
)
def test_moments(text, day_first, moment):
    found = literals.moment_of(text, day_first)
    assert (found and found.date().isoformat()) == moment
