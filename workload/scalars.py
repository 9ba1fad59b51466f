"""Ungrouped aggregates and whole-column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense import run
from workload.base import Case, ask, derive, table, where

GAPS = derive(tax="CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END")
TAX = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END"


def _one(operation: str, columns: list[str], name: str = "lineitem", prepare=None, extra: dict | None = None, **rounded):
    return ask(name, {"operation": operation, "columns": columns, **(extra or {})}, prepare, **rounded)


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    names = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    return run(table(spark, folder, "orders"), {"operation": "describe", "columns": names}).df


def _multi(spark: SparkSession, folder: str) -> DataFrame:
    answer = run(
        table(spark, folder, "orders"), {"operation": "avg|sum", "columns": ["o_totalprice", "o_custkey"]}
    ).df
    return answer.select(*(F.round(c, 2).alias(c) for c in answer.columns))


def _corr(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_quantity", "l_extendedprice", "tax", "flat"]
    prepared = derive(tax=TAX, flat="CAST(3 AS DOUBLE)")(table(spark, folder, "lineitem"))
    answer = run(prepared, {"operation": "correlation", "columns": columns}).df
    return answer.select("col_x", "col_y", F.round("corr", 6).alias("corr"))


def _corr_sql() -> str:
    columns = ["l_quantity", "l_extendedprice", "tax", "flat"]
    pairs = " UNION ALL ".join(
        f"SELECT '{a}' AS col_x, '{b}' AS col_y, "
        + (
            "CAST(NULL AS DOUBLE)"
            if "flat" in (a, b)
            else "CAST(1.0 AS DOUBLE)" if a == b else f"round(corr({a}, {b}), 6)"
        )
        + " AS corr FROM t"
        for a in columns
        for b in columns
    )
    groups = pairs.replace("CAST(NULL AS DOUBLE) AS corr FROM t", "CAST(NULL AS DOUBLE) AS corr")
    groups = groups.replace("CAST(1.0 AS DOUBLE) AS corr FROM t", "CAST(1.0 AS DOUBLE) AS corr")
    return f"WITH t AS (SELECT *, {TAX} AS tax FROM lineitem) {groups}"


def _histogram(spark: SparkSession, folder: str) -> DataFrame:
    answer = run(
        table(spark, folder, "lineitem"), {"operation": "histogram", "columns": ["l_extendedprice"], "bins": 12}
    ).df
    return answer.select("column", "bin", F.round("bin_lo", 4).alias("bin_lo"), F.round("bin_hi", 4).alias("bin_hi"), "count")


_HISTOGRAM_SQL = """
WITH ends AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
edges AS (SELECT i AS bin, lo + (i - 1) * ((hi - lo) / 12) AS a,
                 CASE WHEN i = 12 THEN hi ELSE lo + i * ((hi - lo) / 12) END AS b FROM ends, range(1, 13) r(i))
SELECT 'l_extendedprice' AS "column", CAST(bin AS INTEGER) AS bin, round(a, 4) AS bin_lo, round(b, 4) AS bin_hi,
       (SELECT count(*) FROM lineitem
        WHERE l_extendedprice <= b AND (l_extendedprice > a OR (bin = 1 AND l_extendedprice = a))) AS count
FROM edges
"""

_PROFILE_SQL = """
SELECT 'o_orderkey' AS "column", count(*) AS rows, count(DISTINCT o_orderkey) AS "unique",
       CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max, round(avg(o_orderkey), 2) AS avg,
       CAST(NULL AS DATE) AS min_date, CAST(NULL AS DATE) AS max_date,
       concat('Count: ', count(*), ' | Unique: ', count(DISTINCT o_orderkey), ' | Min: ', min(o_orderkey),
              ' | Max: ', max(o_orderkey), ' | Avg: ', round(avg(o_orderkey), 2)) AS stats FROM orders
UNION ALL
SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), NULL, NULL, NULL, NULL, NULL,
       concat('Count: ', count(*), ' | Unique: ', count(DISTINCT o_orderstatus)) FROM orders
UNION ALL
SELECT 'o_totalprice', count(*), count(DISTINCT o_totalprice), round(min(o_totalprice), 2), round(max(o_totalprice), 2),
       round(avg(o_totalprice), 2), NULL, NULL,
       concat('Count: ', count(*), ' | Unique: ', count(DISTINCT o_totalprice), ' | Min: ', round(min(o_totalprice), 2),
              ' | Max: ', round(max(o_totalprice), 2), ' | Avg: ', round(avg(o_totalprice), 2)) FROM orders
UNION ALL
SELECT 'o_orderdate', count(*), count(DISTINCT o_orderdate), NULL, NULL, NULL,
       CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE),
       concat('Count: ', count(*), ' | Unique: ', count(DISTINCT o_orderdate), ' | Min Date: ',
              CAST(min(o_orderdate) AS DATE), ' | Max Date: ', CAST(max(o_orderdate) AS DATE)) FROM orders
"""


def _mode_sql(column: str) -> str:
    return (
        f"SELECT {column} AS mode_{column} FROM lineitem GROUP BY {column} "
        f"ORDER BY count(*) DESC, {column} LIMIT 1"
    )


def _counts_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", coalesce({column}, 'null') AS value, count(*) AS count "
        f"FROM t GROUP BY 2"
    )


FLAGS = derive(flag="CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END")
FLAGS_SQL = "WITH t AS (SELECT *, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_returnflag END AS flag FROM lineitem) "

CASES = {
    "a_count": Case(
        _one("count", [], extra={"filters": [where("l_quantity", ">", 25)]}),
        "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25",
    ),
    "a_sum": Case(
        _one("total of sum", ["l_extendedprice", "l_quantity"], sum_l_extendedprice=2, sum_l_quantity=2),
        "SELECT round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(sum(l_quantity), 2) AS sum_l_quantity "
        "FROM lineitem",
    ),
    "a_avg": Case(
        _one("average", ["tax"], prepare=GAPS, avg_tax=6),
        f"SELECT round(avg({TAX}), 6) AS avg_tax FROM lineitem",
    ),
    "a_max": Case(_one("max", ["l_extendedprice"]), "SELECT max(l_extendedprice) AS max_l_extendedprice FROM lineitem"),
    "a_min": Case(_one("min", ["l_extendedprice"]), "SELECT min(l_extendedprice) AS min_l_extendedprice FROM lineitem"),
    "a_median": Case(
        _one("median", ["l_extendedprice"], median_l_extendedprice=4),
        "SELECT round(quantile_cont(l_extendedprice, 0.5), 4) AS median_l_extendedprice FROM lineitem",
    ),
    "a_mode": Case(_one("mode", ["l_quantity"]), _mode_sql("l_quantity")),
    "a_std": Case(
        _one("stddev", ["l_extendedprice"], std_l_extendedprice=4),
        "SELECT round(stddev_samp(l_extendedprice), 4) AS std_l_extendedprice FROM lineitem",
    ),
    "a_variance": Case(
        _one("var", ["l_quantity"], variance_l_quantity=4),
        "SELECT round(var_samp(l_quantity), 4) AS variance_l_quantity FROM lineitem",
    ),
    "a_quantile": Case(
        _one("percentile", ["l_extendedprice"], extra={"percentile": 90}, quantile_l_extendedprice=4),
        "SELECT round(quantile_cont(l_extendedprice, 0.9), 4) AS quantile_l_extendedprice FROM lineitem",
    ),
    "a_distinct": Case(
        _one("distinct", ["l_suppkey", "l_shipdate"]),
        "SELECT count(DISTINCT l_suppkey) AS distinct_count_l_suppkey, "
        "count(DISTINCT l_shipdate) AS distinct_count_l_shipdate FROM lineitem",
    ),
    "a_null_count": Case(
        _one("missing", ["tax", "l_quantity"], prepare=GAPS),
        f"SELECT count(*) FILTER (({TAX}) IS NULL) AS null_count_tax, "
        "count(*) FILTER (l_quantity IS NULL) AS null_count_l_quantity FROM lineitem",
    ),
    "a_null_pct": Case(
        _one("missing_pct", ["tax"], prepare=GAPS),
        f"SELECT round(100.0 * (count(*) FILTER (({TAX}) IS NULL))::DOUBLE / count(*), 4) AS null_pct_tax FROM lineitem",
    ),
    "a_corr_matrix": Case(_corr, _corr_sql()),
    "a_value_counts": Case(
        _one("value_counts", ["flag", "l_linestatus"], prepare=FLAGS),
        f"{FLAGS_SQL} {_counts_sql('flag')} UNION ALL {_counts_sql('l_linestatus')}",
    ),
    "a_value_counts_topk": Case(
        _one("frequency", ["p_name"], "part", extra={"top_k": 7}),
        "SELECT 'p_name' AS \"column\", p_name AS value, count(*) AS count FROM part GROUP BY 2 "
        "ORDER BY 3 DESC, 2 LIMIT 7",
    ),
    "a_histogram": Case(_histogram, _HISTOGRAM_SQL),
    "a_profile": Case(_profile, _PROFILE_SQL),
    "a_multi_op": Case(
        _multi,
        "SELECT round(avg(o_totalprice), 2) AS avg_o_totalprice, round(avg(o_custkey), 2) AS avg_o_custkey, "
        "round(sum(o_totalprice), 2) AS sum_o_totalprice, CAST(sum(o_custkey) AS BIGINT) AS sum_o_custkey FROM orders",
    ),
    "a_argmax": Case(
        _one("max", ["o_totalprice", "o_orderkey", "o_orderdate"], "orders"),
        "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
        "WHERE abs(o_totalprice - (SELECT max(o_totalprice) FROM orders)) "
        "<= greatest(1e-9, abs((SELECT max(o_totalprice) FROM orders)) * 1e-9)",
    ),
    "a_argmin": Case(
        _one("min", ["p_size", "p_partkey", "p_name"], "part"),
        "SELECT p_partkey, p_name, p_size FROM part WHERE p_size = (SELECT min(p_size) FROM part)",
    ),
}
