"""Filters on typed and derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense import run
from gridsense.sources.sheets import flatten
from workload.base import Case, ask, derive, table, where

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
LINE_SQL = ", ".join(LINE)
PART = ["p_partkey", "p_name", "p_type", "p_size"]
PART_SQL = ", ".join(PART)
ORDER = ["o_orderkey", "o_totalprice", "o_orderdate"]
ORDER_SQL = ", ".join(ORDER)

GAPS = derive(tax="CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END")
GAPS_SQL = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END"
NOTES = derive(
    note="CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN '  ' ELSE l_returnflag END"
)
NOTES_SQL = "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN '  ' ELSE l_returnflag END"
NAMES = derive(name="CASE WHEN p_size = 7 THEN NULL ELSE concat(' ', upper(p_name), ' ') END")
NAMES_SQL = "CASE WHEN p_size = 7 THEN NULL ELSE concat(' ', upper(p_name), ' ') END"
DATES = derive(day="CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END")
DATES_SQL = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate END"
DAY_NUMBER = derive(ship_day="year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)")
DAY_NUMBER_SQL = "CAST(strftime(l_shipdate, '%Y%m%d') AS INTEGER)"


def _lines(*filters: dict, columns: list[str] = LINE, prepare=None):
    return ask("lineitem", {"columns": columns, "filters": list(filters)}, prepare)


def _parts(*filters: dict, columns: list[str] = PART, prepare=None):
    return ask("part", {"columns": columns, "filters": list(filters)}, prepare)


def _orders(*filters: dict, columns: list[str] = ORDER, prepare=None):
    return ask("orders", {"columns": columns, "filters": list(filters)}, prepare)


def _line_sql(test: str) -> str:
    return f"SELECT {LINE_SQL} FROM lineitem WHERE {test}"


def _part_sql(test: str) -> str:
    return f"SELECT {PART_SQL} FROM part WHERE {test}"


def _order_sql(test: str) -> str:
    return f"SELECT {ORDER_SQL} FROM orders WHERE {test}"


def _sheet_filter(spark: SparkSession, folder: str) -> DataFrame:
    sheets = {
        "Customers": table(spark, folder, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
        ),
        "Suppliers": table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        ),
    }
    request = {"filters": [where("sheet", "contains", "supp"), where("balance", ">", 0)]}
    return run(flatten(sheets), request).df


CASES = {
    "f_eq_num": Case(_lines(where("l_quantity", "=", 17)), _line_sql("l_quantity = 17")),
    "f_neq_num": Case(
        _lines(where("tax", "!=", 0.05), columns=["l_orderkey", "l_linenumber", "tax"], prepare=GAPS),
        f"SELECT l_orderkey, l_linenumber, {GAPS_SQL} AS tax FROM lineitem "
        f"WHERE ({GAPS_SQL}) IS DISTINCT FROM 0.05",
    ),
    "f_gt": Case(_lines(where("l_extendedprice", ">", 90000)), _line_sql("l_extendedprice > 90000")),
    "f_lt": Case(_lines(where("l_extendedprice", "<", "5000.5")), _line_sql("l_extendedprice < 5000.5")),
    "f_gte": Case(_lines(where("L Quantity", ">=", 49)), _line_sql("l_quantity >= 49")),
    "f_lte": Case(_lines(where("l_quantity", "<=", 2)), _line_sql("l_quantity <= 2")),
    "f_between_num": Case(
        _lines(where("l_quantity", "between", [10, 12])), _line_sql("l_quantity BETWEEN 10 AND 12")
    ),
    "f_in": Case(_parts(where("p_size", "in", "3, 7,11")), _part_sql("p_size IN (3, 7, 11)")),
    "f_not_in": Case(
        _parts(where("name", "not in", ["Red Bolt", "hot rod"]), columns=["p_partkey", "name"], prepare=NAMES),
        f"SELECT p_partkey, {NAMES_SQL} AS name FROM part "
        f"WHERE COALESCE(lower(trim({NAMES_SQL})) NOT IN ('red bolt', 'hot rod'), true)",
    ),
    "f_chain_and": Case(
        _lines(
            where("l_returnflag", "=", "r"), where("l_quantity", ">", 40), where("l_shipdate", "=", "1997"),
        ),
        _line_sql(
            "lower(l_returnflag) = 'r' AND l_quantity > 40 AND l_shipdate >= TIMESTAMP '1997-01-01' "
            "AND l_shipdate < TIMESTAMP '1998-01-01'"
        ),
    ),
    "f_eq_text": Case(
        _parts(where("name", "=", "red bolt "), columns=["p_partkey", "name"], prepare=NAMES),
        f"SELECT p_partkey, {NAMES_SQL} AS name FROM part WHERE lower(trim({NAMES_SQL})) = 'red bolt'",
    ),
    "f_neq_text": Case(
        _parts(where("name", "<>", "red bolt"), columns=["p_partkey", "name"], prepare=NAMES),
        f"SELECT p_partkey, {NAMES_SQL} AS name FROM part "
        f"WHERE lower(trim({NAMES_SQL})) IS DISTINCT FROM 'red bolt'",
    ),
    "f_contains": Case(
        ask("documents", {"columns": ["doc_id", "lang"], "filters": [where("text", "contains", "MIT License.")]}),
        "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'mit license.')",
    ),
    "f_not_contains": Case(
        _parts(where("name", "not_contains", "gizmo"), columns=["p_partkey", "name"], prepare=NAMES),
        f"SELECT p_partkey, {NAMES_SQL} AS name FROM part "
        f"WHERE NOT COALESCE(contains(lower({NAMES_SQL}), 'gizmo'), false)",
    ),
    "f_like_prefix": Case(_parts(where("p_name", "like", "Red%")), _part_sql("p_name ILIKE 'red%'")),
    "f_like_suffix": Case(_parts(where("p_name", "like", "%_late")), _part_sql("p_name ILIKE '%_late'")),
    "f_not_like": Case(
        _parts(where("name", "not like", "hot%"), columns=["p_partkey", "name"], prepare=NAMES),
        f"SELECT p_partkey, {NAMES_SQL} AS name FROM part "
        f"WHERE NOT COALESCE(trim({NAMES_SQL}) ILIKE 'hot%', false)",
    ),
    "f_eq_bool": Case(
        _lines(where("returned", "=", "TRUE"), prepare=derive(returned="l_returnflag = 'R'")),
        _line_sql("l_returnflag = 'R'"),
    ),
    "f_eq_year": Case(
        _orders(where("o_orderdate", "=", 1997)),
        _order_sql("year(o_orderdate) = 1997"),
    ),
    "f_neq_year": Case(
        _orders(where("day", "!=", "1997"), columns=["o_orderkey", "day"], prepare=DATES),
        f"SELECT o_orderkey, {DATES_SQL} AS day FROM orders WHERE year({DATES_SQL}) IS DISTINCT FROM 1997",
    ),
    "f_eq_quarter": Case(
        _orders(where("o_orderdate", "=", "1998Q2")),
        _order_sql("year(o_orderdate) = 1998 AND quarter(o_orderdate) = 2"),
    ),
    "f_eq_month": Case(
        _orders(where("o_orderdate", "=", "1998-12")),
        _order_sql("year(o_orderdate) = 1998 AND month(o_orderdate) = 12"),
    ),
    "f_eq_date": Case(
        _orders(where("o_orderdate", "=", "1998-10-03")),
        _order_sql("o_orderdate = TIMESTAMP '1998-10-03'"),
    ),
    "f_neq_date": Case(
        _orders(where("day", "!=", "1998-10-03"), columns=["o_orderkey", "day"], prepare=DATES),
        f"SELECT o_orderkey, {DATES_SQL} AS day FROM orders "
        f"WHERE {DATES_SQL} IS DISTINCT FROM TIMESTAMP '1998-10-03'",
    ),
    "f_gte_year": Case(
        _orders(where("o_orderdate", ">=", "2000")), _order_sql("year(o_orderdate) >= 2000")
    ),
    "f_gt_year": Case(_orders(where("o_orderdate", ">", 1999)), _order_sql("year(o_orderdate) > 1999")),
    "f_date_range": Case(
        _orders(where("o_orderdate", ">", "1996-03-01"), where("o_orderdate", "<=", "1996-09-30")),
        _order_sql("o_orderdate > TIMESTAMP '1996-03-01' AND o_orderdate <= TIMESTAMP '1996-09-30'"),
    ),
    "f_between_date": Case(
        _orders(where("o_orderdate", "between", "1997-01-05, 1997-02-04")),
        _order_sql("o_orderdate BETWEEN TIMESTAMP '1997-01-05' AND TIMESTAMP '1997-02-04'"),
    ),
    "f_contains_year": Case(
        _orders(where("o_orderdate", "contains", "1999")), _order_sql("year(o_orderdate) = 1999")
    ),
    "f_yyyymmdd_year": Case(
        _lines(where("ship_day", "=", "1997"), columns=["l_orderkey", "l_linenumber", "ship_day"], prepare=DAY_NUMBER),
        f"SELECT l_orderkey, l_linenumber, {DAY_NUMBER_SQL} AS ship_day FROM lineitem WHERE year(l_shipdate) = 1997",
    ),
    "f_is_null": Case(
        _lines(where("note", "is", "null"), columns=["l_orderkey", "l_linenumber", "note"], prepare=NOTES),
        f"SELECT l_orderkey, l_linenumber, {NOTES_SQL} AS note FROM lineitem WHERE l_linenumber IN (6, 7)",
    ),
    "f_not_null": Case(
        _lines(where("tax", "!=", "null"), columns=["l_orderkey", "l_linenumber", "tax"], prepare=GAPS),
        f"SELECT l_orderkey, l_linenumber, {GAPS_SQL} AS tax FROM lineitem WHERE ({GAPS_SQL}) IS NOT NULL",
    ),
    "f_sheet": Case(
        _sheet_filter,
        "SELECT 'Suppliers' AS sheet, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS balance "
        "FROM supplier WHERE s_acctbal > 0",
    ),
}
