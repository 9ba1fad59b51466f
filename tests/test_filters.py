import datetime as dt

import pytest

from gridsense import QueryIssue, run
from gridsense.plans.classes import day_numbers
from pyspark.sql import types as T


def keep(ask, schema, rows, column, operator, value, **extra):
    found = ask(schema, rows, {"filters": [{"column": column, "operator": operator, "value": value}], **extra})
    return [row[column] for row in found]


NUMBERS = ("x double", [1.0, 2.0, 3.0, None, float("nan")])
WORDS = ("w string", ["North", " north ", "South", None, "", "   ", "N_rth"])
ISO = ("d string", ["2022-12-31", "2023-01-01", "2023-04-15 10:00:00", "2024/02/29", "soon", None])


@pytest.mark.parametrize(
    "operator, value, kept",
    [("=", 2, [2.0]), ("==", "2", [2.0]), (">", 1, [2.0, 3.0]), (">=", "2", [2.0, 3.0]), ("<", 2, [1.0]),
     ("<=", 2, [1.0, 2.0]), ("between", [2, 3], [2.0, 3.0]), ("between", "1,2", [1.0, 2.0]), ("in", [1, "3.0"], [1.0, 3.0]),
     ("in", "2, 9", [2.0])],
)
def test_numbers(ask, operator, value, kept):
    assert keep(ask, *NUMBERS, "x", operator, value) == kept


@pytest.mark.parametrize("operator, value", [("!=", 2), ("neq", "2"), ("<>", 2.0), ("not in", [2]), ("not_in", "2")])
def test_negations_keep_missing_numbers(ask, operator, value):
    assert len(keep(ask, *NUMBERS, "x", operator, value)) == 4


def test_missing_numbers(ask):
    assert len(keep(ask, *NUMBERS, "x", "=", "null")) == 2
    assert keep(ask, *NUMBERS, "x", "is not", None) == [1.0, 2.0, 3.0]


@pytest.mark.parametrize(
    "operator, value, count",
    [("=", "NORTH", 2), ("!=", "north", 5), ("contains", "ORT", 2), ("not contains", "ort", 5), ("like", "n%", 3),
     ("like", "_orth", 2), ("like", "%TH", 4), ("not like", "n%", 4), ("in", ["north", "SOUTH"], 3), ("in", "South,x", 1),
     ("not in", ["North"], 5), ("is", "null", 3), ("=", "", 3), ("!=", "none", 4), ("is not", "nan", 4)],
)
def test_words(ask, operator, value, count):
    assert len(keep(ask, *WORDS, "w", operator, value)) == count


def test_like_treats_other_signs_literally(ask):
    rows = ["a.c", "abc", "a\\c", "50%"]
    assert keep(ask, "w string", rows, "w", "like", "a.c") == ["a.c"]
    assert keep(ask, "w string", rows, "w", "like", "a\\c") == ["a\\c"]


def test_contains_is_literal_unless_a_regex_is_asked_for(ask):
    prices = ["$100.00", "$200.50", "$50.00"]
    assert keep(ask, "p string", prices, "p", "contains", "$1") == ["$100.00"]
    assert keep(ask, "p string", prices, "p", "contains", r"^\$[12]", regex=True) == prices[:2]


@pytest.mark.parametrize(
    "operator, value, kept",
    [("=", "2023", ISO[1][1:3]), ("=", 2023, ISO[1][1:3]), ("=", "2023Q2", ISO[1][2:3]), ("=", "2023-01", ISO[1][1:2]),
     ("=", "2023-01-01", ISO[1][1:2]), (">=", "2023", ISO[1][1:4]), (">", 2023, ISO[1][3:4]), ("<", "2023", ISO[1][:1]),
     ("<=", "2023", ISO[1][:3]), (">", "2023-04-15", ISO[1][2:4]), ("<", "2023-01-02", ISO[1][:2]),
     ("between", ["2023-01-05", "2024-12-31"], ISO[1][2:4]), ("contains", "2024", ISO[1][3:4]), ("like", "2023%", ISO[1][1:3]),
     ("contains", "2023-04", ISO[1][2:3]), (">=", "2023Q2", ISO[1][2:4]), ("<", "2023-04", ISO[1][:2]),
     ("<=", "2023Q1", ISO[1][:2])],
)
def test_text_dates(ask, operator, value, kept):
    assert keep(ask, *ISO, "d", operator, value) == kept


def test_negated_dates_keep_what_is_no_date(ask):
    assert keep(ask, *ISO, "d", "!=", "2023") == ["2022-12-31", "2024/02/29", "soon", None]
    assert keep(ask, *ISO, "d", "not contains", "2023Q1") == ["2022-12-31", "2023-04-15 10:00:00", "2024/02/29", "soon", None]


def test_day_first_dates(ask):
    rows = ["01/03/2023", "15-03-2023", "01.04.2023", "12/25/2023", "3 March 2024"]
    assert keep(ask, "d string", rows, "d", "=", "2023-03") == rows[:2]
    assert keep(ask, "d string", rows, "d", ">=", "2023-12-25") == rows[3:]


def test_typed_dates(ask):
    rows = [dt.datetime(2023, 5, 1), dt.datetime(2023, 5, 1, 12), dt.datetime(2024, 1, 1), None]
    assert keep(ask, "t timestamp_ntz", rows, "t", "=", "2023") == rows[:2]
    assert keep(ask, "t timestamp_ntz", rows, "t", "=", "2023-05-01") == rows[:1]
    assert keep(ask, "t timestamp_ntz", rows, "t", "in", ["2024-01-01"]) == rows[2:3]
    assert len(keep(ask, "t timestamp_ntz", rows, "t", "!=", "2023-05-01")) == 3
    days = [dt.date(2023, 5, 1), dt.date(2023, 5, 2)]
    assert keep(ask, "t date", days, "t", ">", "2023-05-01") == days[1:]
    assert keep(ask, "t date", days, "t", ">", "2023-05-01 08:00:00") == days[1:]


def test_day_numbers(ask):
    rows = [20230101, 20230601, 20240101, 20230231]
    assert keep(ask, "n int", rows, "n", "=", "2023") == rows[:2]
    assert keep(ask, "n bigint", rows, "n", ">", "2023-06-01") == rows[2:3]
    assert keep(ask, "n int", rows, "n", "between", "2023-05-01,2023-12-31") == rows[1:2]
    assert keep(ask, "n int", rows, "n", "=", 20230601) == rows[1:2]
    assert keep(ask, "n int", [2019, 2020, 2021], "n", ">=", 2020) == [2020, 2021]


def test_known_classes_save_the_look(frame):
    df = frame("n int", [20230101, 20240101])
    hinted = run(df, {"filters": {"n": "2023"}}, classes={"n": day_numbers(T.IntegerType())})
    assert hinted.rows() == [{"n": 20230101}]


def test_text_numbers(ask):
    rows = ["100", " 9 ", "7.5", "1e3", "12d", "NaN", "n/a", None]
    assert keep(ask, "s string", rows, "s", ">", 8) == ["100", " 9 ", "1e3"]
    assert keep(ask, "s string", rows, "s", "=", "9.0") == [" 9 "]
    assert len(keep(ask, "s string", rows, "s", "!=", 9)) == 7


def test_truth_values(ask):
    rows = [True, False, None]
    assert keep(ask, "b boolean", rows, "b", "=", "true") == [True]
    assert keep(ask, "b boolean", rows, "b", "=", True) == [True]
    assert len(keep(ask, "b boolean", rows, "b", "!=", "TRUE")) == 2


def test_chain_and_dict_form(ask):
    rows = [("Eng", 1), ("Eng", 5), ("HR", 5)]
    both = {"filters": [{"column": "dept", "value": "eng"}, {"column": "n", "operator": ">", "value": 2}]}
    assert ask("dept string, n int", rows, both) == [{"dept": "Eng", "n": 5}]
    assert len(ask("dept string, n int", rows, {"filters": {"dept": "Eng", "n": 1}})) == 1


@pytest.mark.parametrize(
    "condition, words",
    [({"column": "zip", "value": 1}, "no column 'zip'"), ({"column": "w", "operator": ">", "value": "abc"}, "cannot be compared"),
     ({"column": "w", "operator": "between", "value": "1"}, "cannot be compared"),
     ({"column": "w", "operator": "is", "value": "North"}, "no operator"),
     ({"column": "w", "operator": "~", "value": "North"}, "no operator")],
)
def test_refusals_come_before_any_result(frame, condition, words):
    with pytest.raises(QueryIssue, match=words) as caught:
        run(frame(*WORDS), {"filters": [condition]})
    row = caught.value.as_row()
    assert row["should_ask_user"] and "w" in row["_summary"]


def test_every_issue_is_listed_and_four_are_asked(frame):
    conditions = [{"column": f"c{i}", "value": 1} for i in range(6)]
    with pytest.raises(QueryIssue) as caught:
        run(frame(*WORDS), {"filters": conditions})
    assert len(caught.value.issues) == 6 and caught.value.questions == caught.value.issues


def test_unicode(ask):
    assert keep(ask, "Ville string", ["München", "Zürich"], "Ville", "=", "MÜNCHEN") == ["München"]
    assert ask("`Chiffre d'affaires` int", [1000, 2000], {"operation": "sum", "columns": ["chiffre d'affaires"]}) == [
        {"sum_Chiffre d'affaires": 3000}
    ]


def test_last_year_of_the_calendar(ask):
    rows = [("9999-12-31 10:00:00",), ("2024-05-05 00:00:00",)]
    for operator, expected in (("<=", 2), (">", 0), (">=", 1), ("<", 1)):
        request = {"filters": [{"column": "d", "operator": operator, "value": "9999"}], "columns": ["d"]}
        assert len(ask("d string", rows, request)) == expected
