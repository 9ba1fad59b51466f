import datetime as dt

import pytest

from gridsense import QueryIssue, run

CATCH = (
    "harbour string, cargo string, tonnes double, crew int",
    [("Bergen", "fish", 42.0, 7), ("Bergen", "timber", 90.0, 11), ("Turku", "fish", 75.5, None), ("Turku", "timber", 261.0, 5),
     ("Gdynia", "fish", 132.0, 3), (None, "fish", 9.0, 2)],
)
DATES = (
    "shipped string, crates int",
    [("2021-03-04", 12), ("2021-03-28", 31), ("2021-08-19", 7), ("2022-10-01", 44), ("2022-11-11", 26), ("soon", 9)],
)


def grouped(ask, data, **request):
    rows = ask(*data, request)
    return {tuple(v for k, v in row.items() if not k.startswith(("sum", "avg", "count", "min", "max", "median", "mode",
                                                                     "std", "var", "quant", "dist", "null"))): row
            for row in rows}


@pytest.mark.parametrize(
    "operation, alias, value",
    [("sum", "sum_tonnes", 132.0), ("avg", "avg_tonnes", 66.0), ("max", "max_tonnes", 90.0), ("min", "min_tonnes", 42.0),
     ("median", "median_tonnes", 66.0), ("mode", "mode_tonnes", 42.0), ("variance", "variance_tonnes", 1152.0),
     ("quantile", "quantile_tonnes", 66.0), ("distinct_count", "distinct_count_tonnes", 2),
     ("null_count", "null_count_tonnes", 0), ("null_pct", "null_pct_tonnes", 0.0)],
)
def test_each_function(ask, operation, alias, value):
    rows = grouped(ask, CATCH, operation=operation, columns=["tonnes"], group_by=["Harbour"])
    assert list(rows) == [("Bergen",), ("Gdynia",), ("Turku",)]
    assert rows["Bergen",][alias] == pytest.approx(value)


def test_count_and_default(ask):
    for operation in ("count", "none", "filter"):
        rows = grouped(ask, CATCH, operation=operation, group_by="cargo")
        assert {k[0]: r["count"] for k, r in rows.items()} == {"fish": 4, "timber": 2}


def test_several_keys_and_missing_keys(ask):
    rows = grouped(ask, CATCH, operation="sum", columns=["tonnes"], group_by=["harbour", "cargo"])
    assert len(rows) == 5 and rows["Turku", "timber"]["sum_tonnes"] == 261.0


def test_sum_without_values_is_zero(ask):
    rows = ask("k string, v double", [("a", None), ("b", 2.0)], {"operation": "sum", "columns": ["v"], "group_by": ["k"]})
    assert rows == [{"k": "a", "sum_v": 0.0}, {"k": "b", "sum_v": 2.0}]


def test_text_numbers_are_read_in_groups(ask):
    rows = ask("k string, v string", [("a", "1"), ("a", "x"), ("b", "2.5")],
               {"operation": "sum", "columns": ["v"], "group_by": ["k"]})
    assert rows == [{"k": "a", "sum_v": 1.0}, {"k": "b", "sum_v": 2.5}]


def test_multi_aggregation_names(ask):
    rows = grouped(
        ask, CATCH, operation="sum", columns=["tonnes"], group_by=["harbour"],
        aggregations=[{"function": "sum", "column": "tonnes"}, {"function": "average", "column": "crew"},
                      {"function": "count", "column": "crew"}, {"function": "sum", "column": "Tonnes"}],
    )
    assert rows["Turku",] == {"harbour": "Turku", "sum_tonnes": 336.5, "avg_crew": 5.0, "count_crew": 1, "sum_tonnes_2": 336.5}


def test_single_aggregation_counts_as_the_operation(ask):
    rows = grouped(ask, CATCH, group_by=["harbour"], aggregations=[{"function": "max", "column": "crew"}])
    assert rows["Bergen",]["max_crew"] == 11


def test_count_of_rows_beside_other_aggregates(ask):
    rows = grouped(ask, CATCH, group_by=["harbour"],
                   aggregations=[{"function": "count"}, {"function": "sum", "column": "crew"}])
    assert rows["Turku",] == {"harbour": "Turku", "count": 2, "sum_crew": 5}
    assert grouped(ask, CATCH, group_by=["harbour"], aggregations=["count"])["Gdynia",] == {"harbour": "Gdynia", "count": 1}


def test_several_operations_are_all_computed(ask):
    rows = grouped(ask, CATCH, operation="count|max|min", columns=["tonnes", "harbour"], group_by=["harbour"])
    assert rows["Bergen",] == {"harbour": "Bergen", "count": 2, "max_tonnes": 90.0, "min_tonnes": 42.0}


@pytest.mark.parametrize(
    "request_",
    [{"operation": "histogram", "columns": ["tonnes"], "group_by": ["harbour"]},
     {"operation": "sum", "columns": ["cargo"], "group_by": ["harbour"]},
     {"operation": "sum", "group_by": ["harbour"]}, {"operation": "count", "group_by": ["nowhere"]},
     {"operation": "count", "group_by": [{"column": "cargo", "time_grain": "year"}]},
     {"operation": "count", "group_by": ["harbour"], "having": [{"column": "nowhere", "operator": ">", "value": 1}]},
     {"operation": "quantile", "columns": ["tonnes"], "group_by": ["harbour"], "percentile": "x"}],
)
def test_refusals(frame, request_):
    with pytest.raises(QueryIssue):
        run(frame(*CATCH), request_)


@pytest.mark.parametrize(
    "grain, labels",
    [("year", ["2021", "2022"]), ("quarter", ["2021Q1", "2021Q3", "2022Q4"]),
     ("month", ["2021-03", "2021-08", "2022-10", "2022-11"]),
     ("month_name", ["August", "March", "November", "October"]),
     ("day", ["2021-03-04", "2021-03-28", "2021-08-19", "2022-10-01", "2022-11-11"]),
     ("day_name", ["Friday", "Saturday", "Sunday", "Thursday"]),
     ("week", ["2021-03-01/2021-03-07", "2021-03-22/2021-03-28", "2021-08-16/2021-08-22", "2022-09-26/2022-10-02",
               "2022-11-07/2022-11-13"]),
     ("fortnight", ["2021-03-04", "2021-03-28", "2021-08-19", "2022-10-01", "2022-11-11"])],
)
def test_grains(ask, grain, labels):
    rows = ask(*DATES, {"operation": "sum", "columns": ["crates"], "group_by": [{"column": "Shipped", "time_grain": grain}]})
    assert [r[f"shipped_{grain}"] for r in rows] == labels
    assert sum(r["sum_crates"] for r in rows) == 120


def test_grains_of_typed_columns_and_day_numbers(ask):
    stamps = [(dt.datetime(2023, 12, 31, 23, 59), 1), (dt.datetime(2024, 1, 1), 2), (None, 4)]
    request = {"operation": "sum", "columns": ["n"], "group_by": [{"column": "t", "time_grain": "year"}]}
    assert ask("t timestamp_ntz, n int", stamps, request) == [{"t_year": "2023", "sum_n": 1}, {"t_year": "2024", "sum_n": 2}]
    assert ask("t int, n int", [(20231231, 1), (20240101, 2)], request)[1] == {"t_year": "2024", "sum_n": 2}


def test_having(ask):
    request = {"operation": "sum", "columns": ["tonnes"], "group_by": ["harbour"]}
    over = [{"column": "tonnes", "operator": ">", "value": "200"}]
    assert [r["harbour"] for r in ask(*CATCH, {**request, "having": over})] == ["Turku"]
    named = [{"column": "SUM_TONNES", "operator": "<=", "value": 140}, {"column": "harbour", "operator": "like", "value": "b%"}]
    assert [r["harbour"] for r in ask(*CATCH, {**request, "having": named})] == ["Bergen"]
    by_year = {"operation": "count", "group_by": [{"column": "shipped", "time_grain": "year"}],
               "having": [{"column": "shipped_year", "operator": ">", "value": 2021}]}
    assert ask(*DATES, by_year) == [{"shipped_year": "2022", "count": 2}]


def test_having_on_plain_rows(ask):
    assert len(ask(*CATCH, {"having": [{"column": "tonnes", "operator": ">=", "value": 100}]})) == 2


def test_sort_after_grouping_knows_the_prefix(ask):
    request = {"operation": "sum", "columns": ["tonnes"], "group_by": ["harbour"], "sort": [{"column": "tonnes", "direction": "desc"}]}
    assert [r["harbour"] for r in ask(*CATCH, request)] == ["Turku", "Bergen", "Gdynia"]
    assert [r["harbour"] for r in ask(*CATCH, {**request, "limit": 2})] == ["Turku", "Bergen"]


WORKBOOK = {
    "Hangar": ("berth string, boats int", [("Elm", 5), ("Oak", 17)]),
    "Harbour": ("berth string, boats int, planes int", [("Ash", 8, 3), ("Fir", 21, 4)]),
    "Notes": ("remark string", ["hello"]),
}


@pytest.fixture
def workbook(frame):
    return {name: frame(*data) for name, data in WORKBOOK.items()}


def test_every_sheet_answers(workbook):
    result = run(workbook, {"operation": "sum", "columns": ["boats", "planes"]})
    assert result.rows() == [
        {"sheet": "Hangar", "sum_boats": 22, "sum_planes": None},
        {"sheet": "Harbour", "sum_boats": 29, "sum_planes": 7},
        {"sheet": "Notes", "sum_boats": None, "sum_planes": None},
    ]
    assert any("Notes" in issue for issue in result.issues)
    assert [r["count"] for r in run(workbook, {"operation": "count"}).rows()] == [2, 2, 1]


@pytest.mark.parametrize("operator, value, kept", [("=", "hangar", {"Hangar"}), ("contains", "ha", {"Hangar", "Harbour"}), ("!=", "Notes", {"Hangar", "Harbour"}),
     ("like", "h%r", {"Hangar", "Harbour"}), ("like", "h", set()), ("not like", "%o%", {"Hangar"}), ("in", ["HANGAR", "attic"], {"Hangar"}),
     ("not in", "Notes,Harbour", {"Hangar"}), ("not contains", "o", {"Hangar"}), ("!=", None, {"Hangar", "Harbour", "Notes"})])
def test_sheet_scope(workbook, operator, value, kept):
    if not kept:
        with pytest.raises(QueryIssue):
            run(workbook, {"filters": [{"column": "Sheet", "operator": operator, "value": value}]})
        return
    rows = run(workbook, {"filters": [{"column": "Sheet", "operator": operator, "value": value}]}).rows()
    assert {r["sheet"] for r in rows} == kept


def test_sheets_without_the_group_column_are_left_out(workbook):
    result = run(workbook, {"operation": "sum", "columns": ["boats"], "group_by": ["berth"]})
    assert [(r["sheet"], r["berth"]) for r in result.rows()] == [("Hangar", "Elm"), ("Hangar", "Oak"), ("Harbour", "Ash"), ("Harbour", "Fir")]
    with pytest.raises(QueryIssue):
        run(workbook, {"operation": "sum", "columns": ["boats"], "group_by": ["nowhere"]})


def test_limit_is_per_sheet(workbook):
    rows = run(workbook, {"columns": ["boats"], "limit": 1, "filters": [{"column": "sheet", "operator": "contains", "value": "ha"}]}).rows()
    assert [(r["sheet"], r["boats"]) for r in rows] == [("Hangar", 5), ("Harbour", 8)]


def test_no_sheet_in_scope(workbook):
    with pytest.raises(QueryIssue):
        run(workbook, {"filters": {"sheet": "Attic"}})


def test_real_sheet_column(ask):
    rows = [("loft", 4), ("cellar", 11), ("loft", 9)]
    request = {"operation": "sum", "columns": ["jars"], "filters": {"sheet": "loft"}}
    assert ask("sheet string, jars int", rows, request) == [{"sum_jars": 13}]
