"""Keyword search, nearest neighbours and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsense import run
from gridsense.functions.coerce import normalise_text
from gridsense.operators import conversations, vectors
from gridsense.operators.text_search import STOP_WORDS, keyword_column, search
from workload.base import Case, table, where

DIMENSIONS = 64


def _search(plan: dict, keep: list[str], name: str = "documents"):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return search(table(spark, folder, name), plan).select(*keep)

    return query


def _normalised(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", normalise_text(F.col("text")).alias("normal"))


def _keywords(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "conversations").where("role = 'user'")
    return questions.select("conv_id", "turn", F.array_join(keyword_column(F.col("text")), " ").alias("keywords"))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    request = {
        "operation": "count|sum|min|max|distinct_count",
        "columns": ["l_quantity"],
        "filters": [where("l_shipdate", ">=", "1997"), where("l_returnflag", "=", "N")],
    }
    return run(table(spark, folder, "lineitem"), request).summary_rows()


def _nearest(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "embeddings")
    centre = vectors.mean_vector(index, "embedding", DIMENSIONS)
    found = vectors.nearest(index, centre, "embedding", "vec_id", k=10)
    return found.select("vec_id", "label", F.round("vector_score", 6).alias("vector_score"))


def _deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    index = table(spark, folder, "embeddings")
    centre = vectors.mean_vector(index, "embedding", DIMENSIONS)
    found = vectors.nearest(index, centre, "embedding", "vec_id", k=40)
    kinds = table(spark, folder, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    # The k matches are few by definition; their content is looked up after the search.
    content = kinds.join(F.broadcast(found), "vec_id").withColumn("content", F.concat_ws("/", "lang", "source"))
    unique = vectors.unique_matches(content, "content", "vec_id")
    return unique.select("vec_id", "content", F.round("vector_score", 6).alias("vector_score"), "_summary")


def _last_turns(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.last_turns(table(spark, folder, "conversations"), turns=2)


_QUESTION = (
    "CASE turn WHEN 0 THEN concat('Show the TOTAL and average of ', text) WHEN 2 THEN concat('How many ', text) "
    "WHEN 4 THEN concat(text, ' highest? Compare the columns') ELSE text END"
)


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "conversations").where("role = 'user'")
    tags = conversations.intent_tags(F.expr(_QUESTION))
    return questions.select("conv_id", "turn", F.array_join(tags, ",").alias("tags"))


_LETTERS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_TEXT = "lower(text)"
_NORMAL = f"trim(regexp_replace({_TEXT}, '\\s+', ' ', 'g'))"
_STOP_SQL = ", ".join(f"'{word}'" for word in STOP_WORDS)

_CENTRE_SQL = """
centre AS (SELECT list(m ORDER BY i) AS c FROM (
  SELECT i, avg(e::DOUBLE) AS m FROM (SELECT unnest(embedding) AS e, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY i)),
scored AS (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, c),
  lambda x: (x[1]::DOUBLE - x[2]) * (x[1]::DOUBLE - x[2]))) AS score FROM embeddings, centre)
"""

_LAST_TURNS_SQL = f"""
WITH m AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations
           WHERE role IN ('user', 'assistant')),
e AS (SELECT *, sum(CASE WHEN role = 'assistant' AND coalesce(before, '') = 'user' THEN 0 ELSE 1 END)
        OVER (PARTITION BY conv_id ORDER BY turn) AS exchange FROM m),
k AS (SELECT *, trim(text, {_LETTERS}) AS t, max(exchange) OVER (PARTITION BY conv_id) AS final FROM e)
SELECT conv_id, coalesce(string_agg(
  CASE WHEN role = 'user' THEN concat('User: ', t)
       WHEN length(t) > 200 THEN concat('Assistant: ', rtrim(substring(t, 1, 197), {_LETTERS}), '...')
       ELSE concat('Assistant: ', t) END, chr(10) ORDER BY turn) FILTER (t <> ''), '') AS history
FROM k WHERE exchange > final - 2 GROUP BY conv_id
"""

_TAG_TESTS = {
    "sum": r"\b(sum|total)\b", "avg": r"\b(average|avg|mean)\b", "count": r"\b(count|how many)\b",
    "max": r"\b(max|highest|largest)\b", "min": r"\b(min|lowest|smallest)\b",
    "correlation": r"\b(correlation|corr|relationship|compare)\b",
    "profile": r"\b(schema|columns|fields|profile|overview|summary)\b",
}
_TAGS_SQL = (
    "SELECT conv_id, turn, concat_ws(',', "
    + ", ".join(
        f"CASE WHEN regexp_matches(lower({_QUESTION}), '{pattern}') THEN '{tag}' END" for tag, pattern in _TAG_TESTS.items()
    )
    + ") AS tags FROM conversations WHERE role = 'user'"
)

_SUMMARY_SQL = """
WITH t AS (SELECT * FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND lower(l_returnflag) = 'n')
SELECT 'count' AS operation, 'rows' AS "column", count(*)::DOUBLE AS value,
  concat('Count of rows where l_shipdate after or on 1997 and l_returnflag is N: ', count(*)) AS _summary FROM t
UNION ALL SELECT 'sum', 'l_quantity', sum(l_quantity),
  concat('Sum of l_quantity where l_shipdate after or on 1997 and l_returnflag is N: ', sum(l_quantity)) FROM t
UNION ALL SELECT 'min', 'l_quantity', min(l_quantity),
  concat('Minimum of l_quantity where l_shipdate after or on 1997 and l_returnflag is N: ', min(l_quantity)) FROM t
UNION ALL SELECT 'max', 'l_quantity', max(l_quantity),
  concat('Maximum of l_quantity where l_shipdate after or on 1997 and l_returnflag is N: ', max(l_quantity)) FROM t
UNION ALL SELECT 'distinct_count', 'l_quantity', count(DISTINCT l_quantity)::DOUBLE,
  concat('Distinct Count of l_quantity where l_shipdate after or on 1997 and l_returnflag is N: ',
         count(DISTINCT l_quantity)) FROM t
"""

_IDS = "SELECT doc_id, lang FROM documents WHERE "

CASES = {
    "text_normalize": Case(_normalised, f"SELECT doc_id, {_NORMAL} AS normal FROM documents"),
    "ts_keywords": Case(
        _keywords,
        # Letters beyond ASCII become capitals, which are word characters but never part of a keyword.
        "SELECT conv_id, turn, array_to_string(list_filter(regexp_extract_all("
        "regexp_replace(lower(text), '[^\\P{L}\\x00-\\x7f]', 'X', 'g'), '\\b[a-z0-9_-]{3,}\\b'), "
        f"lambda x: x NOT IN ({_STOP_SQL})), ' ') AS keywords "
        "FROM conversations WHERE role = 'user'",
    ),
    "ts_and": Case(
        _search(
            {"query_text": "Find the License with that tion", "target_text_columns": ["text"], "top_k": "all",
             "row_key": "doc_id"},
            ["doc_id", "lang"],
        ),
        _IDS + f"contains({_TEXT}, 'license') AND contains({_TEXT}, 'tion')",
    ),
    "ts_or_fallback": Case(
        _search(
            {"query_text": "x", "keywords": ["zyzzyva", "MIT license", "apache license"], "top_k": "all",
             "target_text_columns": ["text", "source"], "row_key": "doc_id"},
            ["doc_id", "lang"],
        ),
        "WITH t AS (SELECT *, trim(regexp_replace(lower(concat_ws(' ', text, source)), '\\s+', ' ', 'g')) AS n FROM documents), "
        "h AS (SELECT *, contains(n, 'zyzzyva')::INT + contains(n, 'mit license')::INT + contains(n, 'apache license')::INT AS hits "
        "FROM t) SELECT doc_id, lang FROM h WHERE hits = 3 OR (hits > 0 AND (SELECT max(hits) FROM h) < 3)",
    ),
    "ts_id_filter": Case(
        _search(
            {"id_filters": [{"column": "Source", "value": " SRC7 "}], "query_text": "License", "top_k": "all",
             "target_text_columns": ["text"], "row_key": "doc_id"},
            ["doc_id", "lang"],
        ),
        _IDS + f"lower(source) = 'src7' AND contains({_TEXT}, 'license')",
    ),
    "ts_post_filter": Case(
        _search(
            {"query_text": "tion zyzzyva", "target_text_columns": ["text"], "top_k": "all", "row_key": "doc_id",
             "post_filters": [where("n_chars", ">", 2500), where("lang", "!=", "EN")]},
            ["doc_id", "lang"],
        ),
        _IDS + f"contains({_TEXT}, 'tion') AND n_chars > 2500 AND lower(lang) <> 'en'",
    ),
    "ts_topk": Case(
        _search(
            {"query_text": "that was this", "keywords": ["that", "was", "tion"], "target_text_columns": ["text"],
             "row_key": "doc_id", "top_k": 8},
            ["doc_id", "lang"],
        ),
        _IDS + f"contains({_TEXT}, 'that') AND contains({_TEXT}, 'was') AND contains({_TEXT}, 'tion') ORDER BY doc_id LIMIT 8",
    ),
    "ts_all_default": Case(
        _search(
            {"query_text": "that was this", "keywords": ["that", "was", "tion"], "target_text_columns": ["text"]},
            ["doc_id", "lang"],
        ),
        _IDS + f"contains({_TEXT}, 'that') AND contains({_TEXT}, 'was') AND contains({_TEXT}, 'tion')",
    ),
    "ts_annotated": Case(
        lambda spark, folder: search(
            table(spark, folder, "benchmark"),
            {"query_text": "that tion", "keywords": ["that", "tion"], "top_k": 20, "row_key": "item_id"},
        ).select(
            "item_id", "text", "_summary", F.array_join("_matched_columns", ",").alias("_matched_columns"),
            F.array_join("_keywords", ",").alias("_keywords"),
        ),
        "WITH h AS (SELECT *, contains(lower(text), 'that')::INT + contains(lower(text), 'tion')::INT AS hits FROM benchmark) "
        f"SELECT item_id, text, concat('[default] Matched ''that, tion'' — text: ', trim(text, {_LETTERS})) AS _summary, "
        "'text' AS _matched_columns, 'that,tion' AS _keywords FROM h "
        "WHERE hits = 2 OR (hits > 0 AND (SELECT max(hits) FROM h) < 2) ORDER BY item_id LIMIT 20",
    ),
    "summary_rows": Case(_summary, _SUMMARY_SQL),
    "v_topk": Case(
        _nearest,
        f"WITH {_CENTRE_SQL} SELECT vec_id, label, round(score, 6) AS vector_score FROM scored "
        "ORDER BY score, vec_id LIMIT 10",
    ),
    "v_dedupe": Case(
        _deduplicated,
        f"WITH {_CENTRE_SQL}, top AS (SELECT * FROM scored ORDER BY score, vec_id LIMIT 40), "
        "c AS (SELECT vec_id, score, concat_ws('/', lang, source) AS content FROM top JOIN documents ON doc_id = vec_id) "
        "SELECT vec_id, content, round(score, 6) AS vector_score, "
        "concat('Semantic Match (Score: ', printf('%.4f', score), '): ', substring(content, 1, 100), '...') AS _summary "
        "FROM c QUALIFY row_number() OVER (PARTITION BY content ORDER BY score, vec_id) = 1",
    ),
    "conv_last_turns": Case(_last_turns, _LAST_TURNS_SQL),
    "conv_intent_tags": Case(_tags, _TAGS_SQL),
}
