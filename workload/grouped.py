"""Grouped aggregates, time grains, conditions on groups, and per-sheet results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense import run
from gridsense.sources.sheets import flatten
from workload.base import Case, ask, derive, table, where

KEYED = derive(
    flag="CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END",
    tax="CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END",
)
KEYED_SQL = (
    "WITH t AS (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag, "
    "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS tax FROM lineitem) "
)


def _by_flag(operation: str, column: str = "tax", extra: dict | None = None, **rounded: int):
    request = {"operation": operation, "columns": [column], "group_by": ["flag"], **(extra or {})}
    return ask("lineitem", request, KEYED, **rounded)


def _by_flag_sql(expression: str, name: str) -> str:
    return f"{KEYED_SQL} SELECT flag, {expression} AS {name} FROM t WHERE flag IS NOT NULL GROUP BY flag"


def _grain(name: str, label: str, table_name: str = "orders", column: str = "o_orderdate", measure: str = "o_totalprice"):
    request = {
        "operation": "sum",
        "columns": [measure],
        "group_by": [{"column": column, "time_grain": name}],
    }
    alias = f"sum_{measure}"
    return Case(
        ask(table_name, request, **{alias: 2}),
        f"SELECT {label.format(column)} AS {column}_{name}, round(sum({measure}), 2) AS {alias} "
        f"FROM {table_name} GROUP BY 1",
    )


def _sheets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    customers, suppliers = table(spark, folder, "customer"), table(spark, folder, "supplier")
    return {
        "Customers": customers.select(
            F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"),
            F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"),
            (F.col("c_acctbal") * 2).alias("credit"),
        ),
        "Suppliers": suppliers.select(
            F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")
        ),
    }


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    return flatten(_sheets(spark, folder))


def _federated_sum(spark: SparkSession, folder: str) -> DataFrame:
    request = {"operation": "sum", "columns": ["Balance", "credit"]}
    answer = run(_sheets(spark, folder), request).df
    return answer.select(
        "sheet", F.round("sum_balance", 2).alias("sum_balance"), F.round("sum_credit", 2).alias("sum_credit")
    )


def _federated_count(spark: SparkSession, folder: str) -> DataFrame:
    request = {"operation": "count", "group_by": ["nation"], "filters": [where("balance", ">=", 0)]}
    return run(_sheets(spark, folder), request).df


_MODE_SQL = f"""{KEYED_SQL}, counted AS (
  SELECT flag, tax, count(*) AS n FROM t WHERE flag IS NOT NULL AND tax IS NOT NULL GROUP BY 1, 2)
SELECT flag, tax AS mode_tax FROM counted
QUALIFY row_number() OVER (PARTITION BY flag ORDER BY n DESC, tax) = 1"""

CASES = {
    "g_sum": Case(_by_flag("sum", sum_tax=2), _by_flag_sql("round(coalesce(sum(tax), 0), 2)", "sum_tax")),
    "g_avg": Case(_by_flag("mean", avg_tax=6), _by_flag_sql("round(avg(tax), 6)", "avg_tax")),
    "g_max": Case(_by_flag("max"), _by_flag_sql("max(tax)", "max_tax")),
    "g_min": Case(_by_flag("min"), _by_flag_sql("min(tax)", "min_tax")),
    "g_median": Case(
        _by_flag("median", "l_extendedprice", median_l_extendedprice=4),
        _by_flag_sql("round(quantile_cont(l_extendedprice, 0.5), 4)", "median_l_extendedprice"),
    ),
    "g_std": Case(_by_flag("std", std_tax=6), _by_flag_sql("round(stddev_samp(tax), 6)", "std_tax")),
    "g_variance": Case(
        _by_flag("variance", "l_quantity", variance_l_quantity=4),
        _by_flag_sql("round(var_samp(l_quantity), 4)", "variance_l_quantity"),
    ),
    "g_quantile": Case(
        _by_flag("quantile", "l_extendedprice", {"quantile": 0.25}, quantile_l_extendedprice=4),
        _by_flag_sql("round(quantile_cont(l_extendedprice, 0.25), 4)", "quantile_l_extendedprice"),
    ),
    "g_distinct": Case(
        _by_flag("unique_count", "l_shipdate"), _by_flag_sql("count(DISTINCT l_shipdate)", "distinct_count_l_shipdate")
    ),
    "g_null_count": Case(_by_flag("nulls"), _by_flag_sql("count(*) FILTER (tax IS NULL)", "null_count_tax")),
    "g_null_pct": Case(
        _by_flag("null_pct"),
        _by_flag_sql("round(100.0 * (count(*) FILTER (tax IS NULL))::DOUBLE / count(*), 4)", "null_pct_tax"),
    ),
    "g_mode": Case(_by_flag("mode"), _MODE_SQL),
    "g_count": Case(_by_flag("count"), _by_flag_sql("count(*)", "count")),
    "g_multi_key": Case(
        ask(
            "lineitem",
            {"operation": "sum", "columns": ["l_quantity"], "group_by": ["Return Flag".replace(" ", ""), "l_linestatus"]},
            lambda df: df.withColumnRenamed("l_returnflag", "return_flag"),
        ),
        "SELECT l_returnflag AS return_flag, l_linestatus, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1, 2",
    ),
    "g_multi_agg": Case(
        ask(
            "orders",
            {
                "group_by": ["o_orderpriority", {"column": "o_orderdate", "time_grain": "year"}],
                "aggregations": [
                    {"function": "sum", "column": "o_totalprice"},
                    {"function": "average", "column": "o_totalprice"},
                    {"function": "count", "column": "o_orderkey"},
                    {"function": "distinct_count", "column": "o_custkey"},
                    {"function": "sum", "column": "o_totalprice"},
                ],
            },
            sum_o_totalprice=2, avg_o_totalprice=4, sum_o_totalprice_2=2,
        ),
        "SELECT o_orderpriority, strftime(o_orderdate, '%Y') AS o_orderdate_year, "
        "round(sum(o_totalprice), 2) AS sum_o_totalprice, round(avg(o_totalprice), 4) AS avg_o_totalprice, "
        "count(o_orderkey) AS count_o_orderkey, count(DISTINCT o_custkey) AS distinct_count_o_custkey, "
        "round(sum(o_totalprice), 2) AS sum_o_totalprice_2 FROM orders GROUP BY 1, 2",
    ),
    "g_having": Case(
        ask(
            "lineitem",
            {
                "operation": "sum", "columns": ["l_quantity"], "group_by": ["l_suppkey"],
                "having": [where("l_quantity", ">", 15000), where("l_suppkey", "between", [10, 80])],
            },
        ),
        "SELECT l_suppkey, sum(l_quantity) AS sum_l_quantity FROM lineitem GROUP BY 1 "
        "HAVING sum(l_quantity) > 15000 AND l_suppkey BETWEEN 10 AND 80",
    ),
    "g_having_count": Case(
        ask("events", {"operation": "count", "group_by": ["user_id"], "having": [where("count", ">=", 70)]}),
        "SELECT user_id, count(*) AS count FROM events GROUP BY 1 HAVING count(*) >= 70",
    ),
    "g_having_topk": Case(
        ask(
            "orders",
            {
                "operation": "count", "group_by": ["o_custkey"], "having": [where("count", ">", 8)],
                "sort": [{"column": "count", "direction": "desc"}], "limit": 20,
            },
        ),
        "SELECT o_custkey, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) > 8 "
        "ORDER BY count DESC, o_custkey LIMIT 20",
    ),
    "g_year": _grain("year", "strftime({}, '%Y')"),
    "g_quarter": _grain("quarter", "concat(year({0}), 'Q', quarter({0}))"),
    "g_month": _grain("month", "strftime({}, '%Y-%m')"),
    "g_month_name": _grain("month_name", "monthname({})"),
    "g_week": _grain(
        "week",
        "concat(strftime(date_trunc('week', {0}), '%Y-%m-%d'), '/', "
        "strftime(date_trunc('week', {0}) + INTERVAL 6 DAY, '%Y-%m-%d'))",
    ),
    "g_day": _grain("day", "strftime({}, '%Y-%m-%d')", "events", "ts", "value"),
    "g_day_name": _grain("day_name", "dayname({})", "events", "ts", "value"),
    "m_flatten": Case(
        _flat,
        "SELECT 'Customers' AS sheet, CAST(c_custkey AS VARCHAR) AS id, c_nationkey AS nation, c_acctbal AS balance, "
        "c_mktsegment AS segment, c_acctbal * 2 AS credit FROM customer UNION ALL "
        "SELECT 'Suppliers', CAST(s_suppkey AS VARCHAR), s_nationkey, s_acctbal, NULL, NULL FROM supplier",
    ),
    "m_federated_sum": Case(
        _federated_sum,
        "SELECT 'Customers' AS sheet, round(sum(c_acctbal), 2) AS sum_balance, round(sum(c_acctbal * 2), 2) AS sum_credit "
        "FROM customer UNION ALL SELECT 'Suppliers', round(sum(s_acctbal), 2), NULL FROM supplier",
    ),
    "m_federated_count": Case(
        _federated_count,
        "SELECT 'Customers' AS sheet, c_nationkey AS nation, count(*) AS count FROM customer WHERE c_acctbal >= 0 GROUP BY 2 "
        "UNION ALL SELECT 'Suppliers', s_nationkey, count(*) FROM supplier WHERE s_acctbal >= 0 GROUP BY 2",
    ),
}
