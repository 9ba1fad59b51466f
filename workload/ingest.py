"""Reading, storing, cleaning and profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense.operators import chunking, cleaning, profiling
from gridsense.sources.csv import read_csv
from gridsense.sources.sheets import flatten, read_sheets
from gridsense.sources.storage import scratch_path, store
from workload.base import Case, table


def _as_csv(df: DataFrame, sep: str = ",") -> str:
    path = scratch_path(df.sparkSession, "csv")
    df.write.csv(
        path, header=True, sep=sep, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return path


def _src_csv(spark: SparkSession, folder: str) -> DataFrame:
    return read_csv(spark, _as_csv(table(spark, folder, "documents")))


def _src_delimiters(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select(
        "c_custkey", F.concat("c_mktsegment", F.lit(", "), "c_name").alias("label"), "c_acctbal"
    )
    semicolons = read_csv(spark, _as_csv(customers, ";")).withColumn("form", F.lit("semicolon"))
    tabs = read_csv(spark, _as_csv(customers, "\t")).withColumn("form", F.lit("tab"))
    return semicolons.unionByName(tabs)


def _src_tokens(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr("CASE o_orderstatus WHEN 'P' THEN 'N/A' ELSE o_orderstatus END").alias("status"),
        F.expr("CASE o_orderpriority WHEN '5-LOW' THEN 'NULL' WHEN '2-HIGH' THEN 'nan' ELSE CAST(o_totalprice AS STRING) END")
        .alias("price"),
    )
    return read_csv(spark, _as_csv(orders))


def _sheets(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {
        "Customers": table(spark, folder, "customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
        ),
        "Suppliers": table(spark, folder, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
        ),
    }


def _src_sheets(spark: SparkSession, folder: str) -> DataFrame:
    paths = {name: _as_csv(df) for name, df in _sheets(spark, folder).items()}
    return flatten(read_sheets(spark, paths))


def _roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    return store(table(spark, folder, "orders"), scratch_path(spark, "orders"), partition_by=["o_orderstatus"])


def _gaps(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        *(
            F.when(F.col("o_orderstatus") != "P", F.col(c)).alias(c)
            for c in ("o_custkey", "o_totalprice", "o_orderpriority")
        )
    )


def _dropall(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_empty_rows(_gaps(spark, folder))


def _headers(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.clean_headers(
        table(spark, folder, "customer").toDF(" Cust. Key ", "Name!", "Name?", "Balance ($)", "% Segment")
    )


def _fill(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.fill_missing(_gaps(spark, folder))


def _flat(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("ID"), "o_custkey", "o_totalprice")
    return cleaning.flat_rows(orders, sheet="Orders")


def _text_heavy(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.text_shape(table(spark, folder, "documents")).select("column", "is_heavy")


def _text_columns(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.text_shape(table(spark, folder, "pages")).select(
        "column", F.round("avg_length", 4).alias("avg_length"), F.round("long_share", 6).alias("long_share"), "is_text"
    )


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.chunk_text(table(spark, folder, "documents"), ["text", "source"], "doc_id", sheet="My|Docs")


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.column_profile(table(spark, folder, "part")).withColumn("samples", F.array_join("samples", ", "))


def _profile_text(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.profile_text(table(spark, folder, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment"), "Main")


def _sample(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.sample_rows(table(spark, folder, "orders"), "o_orderkey")


def _catalog(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.catalog_profile(_sheets(spark, folder))


_LETTERS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_CHUNK_SQL = f"""
WITH cells AS (
  SELECT doc_id, 'text' AS col, trim(text, {_LETTERS}) AS v FROM documents
  UNION ALL SELECT doc_id, 'source', trim(source, {_LETTERS}) FROM documents),
cut AS (
  SELECT doc_id, col, v, unnest(range(0, (length(v) + 499) // 500)) AS i FROM cells
  WHERE v IS NOT NULL AND v <> '' AND lower(v) <> 'n/a'),
named AS (
  SELECT *, concat('sheet:My_Docs|row:', doc_id, '|col:', col, '|chunk:', i) AS chunk_id,
         substring(v, CAST(i * 500 + 1 AS BIGINT), 500) AS piece FROM cut)
SELECT chunk_id, 'My|Docs' AS sheet, CAST(doc_id AS VARCHAR) AS "row", col AS "column", CAST(i AS INTEGER) AS chunk_index,
       piece AS text, concat('Sheet My|Docs | Chunk ', chunk_id, ' | Row ', doc_id, ' | ', col, ': ', piece) AS label
FROM named
"""


def _samples_sql(column: str) -> str:
    return f"(SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT {column} AS v FROM part ORDER BY 1 LIMIT 5))"


_PROFILE_SQL = " UNION ALL ".join(
    f"SELECT {at} AS position, '{name}' AS \"column\", '{kind}' AS type, count(*) AS rows, "
    f"count(*) FILTER ({name} IS NULL) AS missing, "
    + (
        f"CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, {_samples_sql(name)} AS samples"
        if kind == "string"
        else f"CAST(min({name}) AS DOUBLE) AS min, CAST(max({name}) AS DOUBLE) AS max, CAST(NULL AS VARCHAR) AS samples"
    )
    + " FROM part"
    for at, (name, kind) in enumerate(
        [
            ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
            ("p_size", "int"), ("p_retailprice", "double"),
        ]
    )
)

_PROFILE_TEXT_SQL = """
SELECT concat('Dataset (Sheet: Main): ', count(*), ' rows, 3 cols', chr(10),
  '- c_nationkey (int): Range [', CAST(min(c_nationkey) AS DOUBLE), ' to ', CAST(max(c_nationkey) AS DOUBLE), ']', chr(10),
  '- c_acctbal (double): Range [', min(c_acctbal), ' to ', max(c_acctbal), ']', chr(10),
  '- c_mktsegment (string): Samples: ',
  (SELECT string_agg(v, ', ' ORDER BY v) FROM (SELECT DISTINCT c_mktsegment AS v FROM customer ORDER BY 1 LIMIT 5)))
  AS profile FROM customer
"""

_GAPS_SQL = (
    "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, "
    "{} AS o_orderpriority FROM orders"
)

CASES = {
    "src_csv": Case(_src_csv, "SELECT * FROM documents"),
    "src_csv_delim": Case(
        _src_delimiters,
        "SELECT c_custkey, concat(c_mktsegment, ', ', c_name) AS label, c_acctbal, form "
        "FROM customer, (VALUES ('semicolon'), ('tab')) f(form)",
    ),
    "src_na_tokens": Case(
        _src_tokens,
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderstatus END AS status, "
        "CASE WHEN o_orderpriority IN ('5-LOW', '2-HIGH') THEN NULL ELSE o_totalprice END AS price FROM orders",
    ),
    "src_sheets": Case(
        _src_sheets,
        "SELECT 'Customers' AS sheet, CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_mktsegment AS segment, "
        "CAST(NULL AS DOUBLE) AS balance FROM customer UNION ALL "
        "SELECT 'Suppliers', CAST(s_suppkey AS VARCHAR), s_name, NULL, s_acctbal FROM supplier",
    ),
    "sink_roundtrip": Case(_roundtrip, "SELECT * FROM orders"),
    "clean_dropall": Case(
        _dropall,
        "SELECT o_custkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus <> 'P'",
    ),
    "clean_headers": Case(
        _headers,
        'SELECT c_custkey AS "Cust Key", c_name AS "Name", c_nationkey AS "Name_2", c_acctbal AS "Balance ", '
        'c_mktsegment AS " Segment" FROM customer',
    ),
    "clean_fill": Case(
        _fill, _GAPS_SQL.format("CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority ELSE 'N/A' END")
    ),
    "flat_rows": Case(
        _flat, "SELECT 'Orders' AS sheet, CAST(o_orderkey AS VARCHAR) AS id, o_custkey, o_totalprice FROM orders"
    ),
    "text_heavy": Case(
        _text_heavy,
        "SELECT 'text' AS \"column\", avg(length(text)) > 100 AS is_heavy FROM documents UNION ALL "
        "SELECT 'lang', avg(length(lang)) > 100 FROM documents UNION ALL "
        "SELECT 'source', avg(length(source)) > 100 FROM documents",
    ),
    "text_columns": Case(
        _text_columns,
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", round(avg(length({c})), 4) AS avg_length, "
            f"round(avg(CAST(length({c}) > 60 AS DOUBLE)), 6) AS long_share, "
            f"avg(length({c})) >= 80 OR avg(CAST(length({c}) > 60 AS DOUBLE)) >= 0.3 AS is_text FROM pages"
            for c in ("url", "html")
        ),
    ),
    "chunk_text": Case(_chunks, _CHUNK_SQL),
    "col_profile": Case(_profile, _PROFILE_SQL),
    "col_profile_text": Case(_profile_text, _PROFILE_TEXT_SQL),
    "sample_rows": Case(_sample, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5"),
    "catalog_profile": Case(
        _catalog,
        "WITH s AS (SELECT 0 AS position, 'Customers' AS sheet, count(*) AS rows, 3 AS cols, 'id,name,segment' AS columns "
        "FROM customer UNION ALL SELECT 1, 'Suppliers', count(*), 3, 'id,name,balance' FROM supplier) "
        "SELECT *, CAST(sum(rows) OVER () AS BIGINT) AS total_rows, max(cols) OVER () AS max_cols, "
        "'id,name,segment,balance' AS union_columns FROM s",
    ),
}
