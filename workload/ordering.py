"""Sorting, limits, projection and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense import run
from gridsense.functions import coerce
from workload.base import Case, ask, derive, table, where


def _desc(column: str) -> dict:
    return {"column": column, "direction": "desc"}


def _numeric_text(spark: SparkSession, folder: str) -> DataFrame:
    """Prices as text; a fifth of the rows has none, too few to stop the sort by number."""
    orders = derive(
        price="CASE WHEN o_orderpriority = '1-URGENT' THEN 'n/a' ELSE CAST(o_totalprice AS STRING) END"
    )(table(spark, folder, "orders"))
    sort = [_desc("price")]
    return run(orders, {"columns": ["o_orderkey", "price"], "sort": sort, "limit": 40, "row_key": "o_orderkey"}).df


def _renamed(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").withColumnsRenamed(
        {"o_orderkey": "Order Key", "o_totalprice": "Total Price ($)"}
    )
    request = {"columns": ["ORDER KEY", "total_price", "no such column"], "filters": [where("TotalPrice", ">", 250000)]}
    return run(orders, request).df


def _casts(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.expr(
        "CASE o_orderpriority WHEN '1-URGENT' THEN 'n/a' WHEN '2-HIGH' THEN concat(CAST(o_totalprice AS STRING), 'd') "
        "WHEN '3-MEDIUM' THEN 'NaN' ELSE concat(' ', CAST(o_totalprice AS STRING)) END"
    )
    return table(spark, folder, "orders").select("o_orderkey", coerce.number_from_text(cell).alias("price"))


def _dates(form: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        cell = F.expr(form)
        return table(spark, folder, "orders").select("o_orderkey", coerce.time_from_text(cell).alias("day"))

    return query


def _day_numbers(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.expr(
        "CASE WHEN o_orderstatus = 'P' THEN 20230231 ELSE CAST(date_format(o_orderdate, 'yyyyMMdd') AS INT) END"
    )
    return table(spark, folder, "orders").select("o_orderkey", coerce.time_from_day_number(cell).alias("day"))


CASES = {
    "o_multi": Case(
        ask(
            "part",
            {
                "columns": ["p_partkey", "p_size", "p_retailprice"],
                "sort": [_desc("p_size"), {"column": "p_retailprice", "direction": "asc"}],
                "limit": 60, "row_key": "p_partkey",
            },
        ),
        "SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size DESC, p_retailprice, p_partkey LIMIT 60",
    ),
    "o_numeric_text": Case(
        _numeric_text,
        "SELECT o_orderkey, CAST(o_totalprice AS VARCHAR) AS price FROM orders WHERE o_orderpriority <> '1-URGENT' "
        "ORDER BY o_totalprice DESC, o_orderkey LIMIT 40",
    ),
    "o_date": Case(
        ask(
            "orders",
            {"columns": ["o_orderkey", "o_orderdate"], "sort": [_desc("day")], "limit": 50, "row_key": "o_orderkey"},
            derive(day="date_format(o_orderdate, 'dd/MM/yyyy')"),
        ),
        "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50",
    ),
    "o_text": Case(
        ask(
            "part",
            {"columns": ["p_partkey", "name"], "sort": ["name"], "limit": 70, "row_key": "p_partkey"},
            derive(name="CASE WHEN p_size < 20 THEN upper(p_name) ELSE p_name END"),
        ),
        "SELECT p_partkey, CASE WHEN p_size < 20 THEN upper(p_name) ELSE p_name END AS name FROM part "
        "ORDER BY lower(p_name), p_partkey LIMIT 70",
    ),
    "o_limit": Case(
        ask("orders", {"columns": ["ID", "o_totalprice"], "limit": 25}, lambda df: df.withColumnRenamed("o_orderkey", "id")),
        "SELECT o_orderkey AS id, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25",
    ),
    "o_topk": Case(
        ask(
            "lineitem",
            {
                "columns": ["l_orderkey", "l_linenumber", "l_extendedprice"],
                "sort": [_desc("l_extendedprice"), "l_orderkey", "l_linenumber"], "limit": 15,
            },
        ),
        "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem "
        "ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15",
    ),
    "select_cols": Case(
        ask("customer", {"columns": ["c_name", "c_mktsegment"]}), "SELECT c_name, c_mktsegment FROM customer"
    ),
    "select_all": Case(
        ask("supplier", {"operation": "filter", "filters": {"s_nationkey": 7}}),
        "SELECT * FROM supplier WHERE s_nationkey = 7",
    ),
    "col_resolve": Case(
        _renamed,
        'SELECT o_orderkey AS "Order Key", o_totalprice AS "Total Price ($)" FROM orders WHERE o_totalprice > 250000',
    ),
    "op_alias": Case(
        ask(
            "part", {"operation": "mean and stdev and unique_count", "columns": ["p_size"]}, avg_p_size=4, std_p_size=4
        ),
        "SELECT round(avg(p_size), 4) AS avg_p_size, round(stddev_samp(p_size), 4) AS std_p_size, "
        "count(DISTINCT p_size) AS distinct_count_p_size FROM part",
    ),
    "cast_numeric": Case(
        _casts,
        "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN NULL "
        "ELSE o_totalprice END AS price FROM orders",
    ),
    "cast_yyyymmdd": Case(
        _day_numbers,
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS day "
        "FROM orders",
    ),
    "cast_date_iso": Case(
        _dates(
            "CASE o_orderstatus WHEN 'P' THEN 'soon' WHEN 'F' THEN date_format(o_orderdate, 'yyyy/MM/dd') "
            "ELSE date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss') END"
        ),
        "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END AS day FROM orders",
    ),
    "cast_date_dayfirst": Case(
        _dates(
            "CASE o_orderstatus WHEN 'P' THEN date_format(o_orderdate, 'd.M.yyyy') "
            "WHEN 'F' THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'd MMMM yyyy') END"
        ),
        "SELECT o_orderkey, o_orderdate AS day FROM orders",
    ),
}
