"""Random filters over messy text against a plain row-by-row model."""

import datetime as dt
import operator
import random
import re

import pytest

from gridsense import QueryIssue, run

NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*")
SIGNS = {"=": operator.eq, ">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le}


def number(cell):
    return float(cell) if cell is not None and NUMBER.fullmatch(cell) else None


def moment(cell):
    for layout in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d %H:%M", "%m/%d/%Y", "%d %B %Y"):
        try:
            return dt.datetime.strptime((cell or "").strip(), layout)
        except ValueError:
            continue
    return None


def cells(rng, kind):
    day = dt.datetime(2022, 1, 1) + dt.timedelta(days=rng.randrange(1000))
    numbers = [str(rng.randint(-5, 30)), f" {rng.uniform(0, 30):.2f}", "1e1", ".5", "7."]
    dates = [day.strftime(f) for f in ("%Y-%m-%d", "%Y/%m/%d", "%d/%m/%Y", "%d.%m.%Y", "%Y-%m-%d 10:30", "%d %B %Y")]
    words = ["North", " south ", "n/a", "12d", "NaN", "", "  ", None, "a%b", "Inf", "2023-13-45", "31/02/2023"]
    return rng.choice({"numbers": numbers + words, "dates": dates + words, "words": words}[kind])


def model(rows, sign, value):
    """Number if the literal is one and some cell is; else date; else text for equality."""
    literal = number(value)
    if literal is not None and any(number(c) is not None for c in rows):
        return [c for c in rows if number(c) is not None and SIGNS[sign](number(c), literal)]
    if any(moment(c) for c in rows):
        year = re.fullmatch(r"\d{4}", value)
        wanted = moment(value)
        if year:
            return [c for c in rows if moment(c) and SIGNS[sign](moment(c).year, int(value))]
        if wanted:
            return [c for c in rows if moment(c) and SIGNS[sign](moment(c), wanted)]
    if sign != "=":
        return None
    return [c for c in rows if c is not None and c.strip().lower() == value.strip().lower()]


@pytest.mark.parametrize("seed", range(40))
def test_random_filters(frame, seed):
    rng = random.Random(seed)
    kind = rng.choice(["numbers", "dates", "words"])
    rows = [cells(rng, kind) for _ in range(60)]
    df = frame("c string", rows)
    for _ in range(3):
        sign = rng.choice(list(SIGNS))
        value = rng.choice([str(rng.randint(0, 30)), "2023", "2023-05-01", "2022-12-31", "NORTH", "12d", "abc"])
        want = model(rows, sign, value)
        request = {"filters": [{"column": "C", "operator": sign, "value": value}]}
        if want is None:
            with pytest.raises(QueryIssue):
                run(df, request)
            continue
        got = [r["c"] for r in run(df, request).df.collect()]
        assert sorted(got) == sorted(want), (kind, sign, value)
        if sign == "=":
            others = run(df, {"filters": [{"column": "c", "operator": "!=", "value": value}]}).df.count()
            assert others == len(rows) - len(want)


def test_other_time_zones_do_not_move_dates(spark, frame):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        # Clocks there skipped the midnight of 15 October 2017.
        df = frame("d string", ["2017-10-15", "15/10/2017", "15 October 2017", "15 Oct 2017"])
        request = {"filters": [{"column": "d", "value": "2017-10-15"}]}
        assert run(df, request).df.count() == 4
        by_day = {"operation": "count", "group_by": [{"column": "d", "time_grain": "day"}]}
        assert run(df, by_day).rows() == [{"d_day": "2017-10-15", "count": 4}]
        by_month = {"operation": "count", "group_by": [{"column": "d", "time_grain": "month"}]}
        assert run(df, by_month).rows() == [{"d_month": "2017-10", "count": 4}]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_names_with_any_sign(ask):
    rows = [("x", 1.0, "2024-01-01"), ("x", 3.0, "2024-02-01"), ("y", 5.0, None)]
    schema = "`a.b` string, `v``w` double, `d (%)` string"
    request = {"operation": "sum|median|mode|null_pct", "columns": ["v`w"], "group_by": ["a.b"],
               "sort": [{"column": "v`w", "direction": "desc"}]}
    assert [r["sum_v`w"] for r in ask(schema, rows, request)] == [5.0, 4.0]
    assert ask(schema, rows, {"operation": "count", "group_by": [{"column": "d", "time_grain": "year"}]}) == [
        {"d (%)_year": "2024", "count": 2}
    ]
    found = ask(schema, rows, {"operation": "value_counts", "columns": ["a.b"], "filters": {"a.b": "X"}})
    assert found == [{"column": "a.b", "value": "x", "count": 2}]


def test_dates_with_short_years_half_days_dots_and_months_alone(frame):
    from gridsense.functions.coerce import time_from_text

    wanted = {
        "1/2/23": "2023-02-01 00:00:00", "12/25/23": "2023-12-25 00:00:00", "1-2-99": "1999-02-01 00:00:00", "01.02.23": "2023-02-01 00:00:00",
        "01/02/2023 3:00 PM": "2023-02-01 15:00:00", "1/2/23 12:05:09 am": "2023-02-01 00:05:09", "2023-01-05 12 p.m.": "2023-01-05 12:00:00",
        "2023.01.05": "2023-01-05 00:00:00", "2023.1.5 10:30:00": "2023-01-05 10:30:00", "January 2023": "2023-01-01 00:00:00", "feb 2023": "2023-02-01 00:00:00",
        "2023-01-05 10:30:00": "2023-01-05 10:30:00", "05/01/2023": "2023-01-05 00:00:00", "5 Jan 2023": "2023-01-05 00:00:00",
        "01/02/2023 13:00 PM": None, "45/45/23": None, "1.2.33": None, "2023.5": None, "room 2023 B": None, "April": None,
    }
    df = frame("t string", list(wanted))
    got = {r["t"]: r["at"] for r in df.select("t", time_from_text(df["t"]).cast("string").alias("at")).collect()}
    assert got == wanted


def test_multi_line_cells_are_written_by_as_many_tasks_as_the_table_has_parts(spark, tmp_path, monkeypatch):
    from workload import messy

    rows = [(i, None if i % 7 == 0 else f'a "b", {i}\n\nc', "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(messy, "scratch_path", lambda spark, name: str(tmp_path / name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        got = messy._multiline(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(tuple, got)) == [(i, None if text is None else '5" \n' + text, lang) for i, text, lang in rows]
    assert len(list((tmp_path / "csv").glob("part-*"))) > 1
