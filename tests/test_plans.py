"""What the physical plans look like: pushed filters, pruned columns, few shuffles."""

import re

import pytest

from gridsense import run
from gridsense.operators import conversations, text_search, vectors
from gridsense.sources.sheets import flatten

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def table(spark):
    return lambda name: spark.read.parquet(f"{FOLDER}/{name}.parquet")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pushed(df):
    return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan(df)).group(1)


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition", plan(df)))


@pytest.mark.parametrize(
    "condition, marks",
    [(("o_orderdate", "=", "1997"), ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"]),
     (("o_orderdate", "=", "1998Q2"), ["GreaterThanOrEqual(o_orderdate", "LessThan(o_orderdate"]),
     (("o_orderdate", ">", "1999-01-05"), ["GreaterThan(o_orderdate"]),
     (("o_totalprice", ">", 5000), ["GreaterThan(o_totalprice,5000.0"]),
     (("o_totalprice", "between", "1,2"), ["GreaterThanOrEqual(o_totalprice,1.0", "LessThanOrEqual(o_totalprice,2.0"]),
     (("o_orderkey", "in", "1,2,3"), ["In(o_orderkey"])],
)
def test_filters_reach_the_scan(table, condition, marks):
    column, operator, value = condition
    df = run(table("orders"), {"columns": ["o_custkey"], "filters": [{"column": column, "operator": operator, "value": value}]}).df
    assert all(mark in pushed(df) for mark in marks)
    assert re.search(r"ReadSchema: struct<[^>]*>", plan(df)).group(0).count(":") <= 3


def test_day_number_filters_reach_the_scan(spark, table, tmp_path):
    path = str(tmp_path / "days")
    table("orders").selectExpr("o_orderkey", "CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) AS day").write.parquet(path)
    df = run(spark.read.parquet(path), {"filters": {"day": "1997"}}).df
    assert "GreaterThanOrEqual(day,19970101)" in pushed(df) and "LessThan(day,19980101)" in pushed(df)


def test_other_sheets_are_not_read(table):
    book = {"A": table("customer").selectExpr("c_custkey AS id", "c_acctbal AS balance"),
            "B": table("supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance")}
    df = run(flatten(book), {"filters": {"sheet": "b"}, "operation": "sum", "columns": ["balance"]}).df
    assert plan(df).count("FileScan parquet") == 1 and "supplier.parquet" in plan(df)


def test_only_needed_columns_are_read(table):
    df = run(table("lineitem"), {"operation": "avg", "columns": ["l_tax"], "group_by": ["l_returnflag"]}).df
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan(df)


def test_no_sort_unless_asked_for(table):
    rows = table("orders").withColumnRenamed("o_orderkey", "id")
    assert shuffles(run(rows, {"filters": {"o_orderstatus": "p"}}).df) == 0
    assert shuffles(run(rows, {"sort": ["o_totalprice"]}).df) == 1


def test_grouping_is_one_shuffle_of_partial_results(table):
    request = {"group_by": [{"column": "o_orderdate", "time_grain": "month"}, "o_orderpriority"],
               "aggregations": [{"function": f, "column": "o_totalprice"} for f in ("sum", "avg", "max", "std")]}
    df = run(table("orders"), request).df
    assert shuffles(df) == 1 and "partial_sum" in plan(df)


def test_limited_sorts_are_top_k(table):
    request = {"columns": ["o_orderkey"], "sort": [{"column": "o_totalprice", "direction": "desc"}], "limit": 10}
    df = run(table("orders"), request).df
    assert "TakeOrderedAndProject" in plan(df) and shuffles(df) == 0
    found = vectors.nearest(table("embeddings"), [0.0] * 64, "embedding", "vec_id")
    assert "TakeOrderedAndProject" in plan(found) and shuffles(found) == 0


def test_search_reads_its_text_once(table):
    request = {"query_text": "that tion", "row_key": "doc_id", "target_text_columns": ["text"]}
    whole, best = (text_search.search(table("documents"), r) for r in (request, {**request, "top_k": 5}))
    assert plan(whole).count("FileScan parquet") == 1 and "TakeOrderedAndProject" not in plan(whole)
    assert plan(best).count("FileScan parquet") == 1 and "TakeOrderedAndProject" in plan(best)


def test_long_conversations_are_cut_before_the_shuffle(table):
    text = plan(conversations.last_turns(table("conversations")))
    assert text.count("WindowGroupLimit") == 2 and text.count("Exchange hashpartitioning") == 1
    assert text.rindex("WindowGroupLimit") > text.rindex("Exchange hashpartitioning")


@pytest.mark.parametrize("operation", ["sum|avg|std", "value_counts", "histogram", "correlation", "mode", "quantile", "profile"])
def test_no_python_in_the_hot_path(table, operation):
    result = run(table("lineitem"), {"operation": operation, "columns": ["l_quantity", "l_tax"]})
    for df in result.parts.values():
        assert "Python" not in plan(df) and "InPandas" not in plan(df) and "CartesianProduct" not in plan(df)
