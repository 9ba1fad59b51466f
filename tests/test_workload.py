"""Every registered query against its SQL, and random requests against theirs."""

import random
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from gridsense import run

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        if Path(f"{FOLDER}/{table}.parquet").exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


def same(df, connection, sql):
    answer = connection.execute(sql)
    columns = [c[0] for c in answer.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, answer.fetchall())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
    else:
        same(df, duck, sql)


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 12 and rows[0]["sum_o_totalprice"] >= rows[-1]["sum_o_totalprice"]


NUMERIC = {"l_quantity": (1, 50), "l_discount": (0, 0.1), "l_extendedprice": (900, 100000), "l_partkey": (0, 199)}


def random_condition(rng):
    kind = rng.choice(["number", "between", "year", "flag", "missing"])
    if kind == "flag":
        value = rng.choice("ANRX")
        negated = rng.random() < 0.5
        return ({"column": "l_returnflag", "operator": "!=" if negated else "=", "value": value.lower()},
                f"lower(l_returnflag) {'<>' if negated else '='} '{value.lower()}'")
    if kind == "year":
        sign, year = rng.choice(["=", ">", "<", ">=", "<="]), rng.randint(1995, 2001)
        return {"column": "l_shipdate", "operator": sign, "value": str(year)}, f"year(l_shipdate) {sign} {year}"
    column = rng.choice(list(NUMERIC))
    low, high = NUMERIC[column]
    a, b = sorted(round(rng.uniform(low, high), 2) for _ in range(2))
    if kind == "between":
        return {"column": column, "operator": "between", "value": [a, b]}, f"{column} BETWEEN {a} AND {b}"
    if kind == "missing":
        return ({"column": "tax", "operator": "!=", "value": 0.02}, "tax IS DISTINCT FROM 0.02")
    sign = rng.choice([">", "<", ">=", "<="])
    return {"column": column, "operator": sign, "value": str(a)}, f"{column} {sign} {a}"


FUNCTIONS = {
    "sum": "round(coalesce(sum({0}), 0), 4)", "avg": "round(avg({0}), 6)", "max": "max({0})", "min": "min({0})",
    "median": "round(quantile_cont({0}, 0.5), 6)", "count": "count({0})", "distinct_count": "count(DISTINCT {0})",
    "std": "round(stddev_samp({0}), 6)", "null_count": "count(*) FILTER ({0} IS NULL)",
}
DIGITS = {"sum": 4, "avg": 6, "median": 6, "std": 6}


@pytest.mark.parametrize("seed", range(25))
def test_random_requests(spark, duck, seed):
    from pyspark.sql import functions as F

    rng = random.Random(seed)
    tests = [random_condition(rng) for _ in range(rng.randint(0, 3))]
    keys = rng.sample(["l_returnflag", "l_linestatus", "l_suppkey"], rng.randint(1, 2))
    pairs = list(dict.fromkeys(
        (rng.choice(list(FUNCTIONS)), rng.choice(["l_quantity", "l_extendedprice", "tax"])) for _ in range(rng.randint(2, 4))))
    if len(pairs) < 2:
        pairs = [("sum", "tax"), ("max", "l_quantity")]
    data = spark.read.parquet(f"{FOLDER}/lineitem.parquet").selectExpr(
        "*", "CASE WHEN l_linenumber > 5 THEN NULL ELSE l_tax END AS tax")
    answer = run(data, {
        "filters": [t for t, _ in tests], "group_by": keys,
        "aggregations": [{"function": f, "column": c} for f, c in pairs],
    }).df
    answer = answer.select(*keys, *(
        F.round(f"{f}_{c}", DIGITS[f]).alias(f"{f}_{c}") if f in DIGITS else F.col(f"{f}_{c}") for f, c in pairs))
    where = " AND ".join(sql for _, sql in tests) or "true"
    measures = ", ".join(f"{FUNCTIONS[f].format(c)} AS {f}_{c}" for f, c in pairs)
    same(answer, duck, (
        "WITH t AS (SELECT *, CASE WHEN l_linenumber > 5 THEN NULL ELSE l_tax END AS tax FROM lineitem) "
        f"SELECT {', '.join(keys)}, {measures} FROM t WHERE {where} GROUP BY ALL"))
