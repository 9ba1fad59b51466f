import pytest

from gridsense import QueryIssue
from gridsense.operators import conversations, vectors
from gridsense.operators.text_search import keyword_column, keywords_in, search
from gridsense.functions.coerce import normalise_text
from gridsense.sources.storage import store_vectors
from pyspark.sql import functions as F

NOTES = (
    "id int, title string, notes string, score int",
    [(1, "Platform", "Senior Engineer in the\n platform team", 5), (2, "Finance", "analyst in finance team", 7),
     (3, None, "engineer in sales ops", 9), (4, "Misc", None, 11)],
)


def ids(df, plan):
    return [r["id"] for r in search(df, plan).collect()]


@pytest.fixture
def notes(frame):
    return frame(*NOTES)


def test_keywords():
    question = "Show me the Employees WITH e-mail in Q3_2023, please; é déjà-vu"
    assert keywords_in(question) == ["employees", "e-mail", "q3_2023", "-vu"]


def test_keyword_column_agrees(frame):
    texts = ["Find the très long-winded naïve answer", "x yz abc_9 -dash- été", "", None]
    got = [r["k"] for r in frame("t string", texts).select(keyword_column(F.col("t")).alias("k")).collect()]
    assert got == [keywords_in(t) for t in texts[:3]] + [None]


def test_all_words_then_any(notes):
    assert ids(notes, {"query_text": "engineer team"}) == [1]
    assert ids(notes, {"query_text": "finance ops"}) == [2, 3]
    assert ids(notes, {"query_text": "engineer"}) == [1, 3]
    assert ids(notes, {"keywords": ["zzz", "qqq"], "query_text": "x"}) == []


def test_phrases_cross_white_space_and_columns(notes):
    assert ids(notes, {"keywords": ["the platform"], "query_text": "x"}) == [1]
    assert ids(notes, {"keywords": ["platform senior"], "query_text": "x"}) == [1]
    assert ids(notes, {"keywords": ["platform"], "query_text": "x", "target_text_columns": ["Notes"]}) == [1]
    assert ids(notes, {"keywords": ["finance"], "query_text": "x", "target_text_columns": ["nowhere"]}) == [2]


def test_words_are_literal(frame):
    df = frame("id int, t string", [(1, "cost 5.0%"), (2, "cost 510%")])
    assert ids(df, {"keywords": ["5.0%"], "query_text": "x"}) == [1]


def test_id_filters(notes):
    assert ids(notes, {"id_filters": [{"column": "ID", "value": "3"}]}) == [3]
    assert ids(notes, {"query_text": "engineer", "id_filters": [{"column": "title", "value": " PLATFORM "}]}) == [1]
    assert ids(notes, {"query_text": "engineer", "id_filters": [{"column": "id", "value": None}]}) == [1, 3]


def test_post_filters_come_after_the_choice_of_any_or_all(notes):
    later = [{"column": "score", "operator": ">", "value": 6}]
    assert ids(notes, {"query_text": "engineer team", "post_filters": later}) == []
    assert ids(notes, {"query_text": "finance ops", "post_filters": later}) == [2, 3]
    assert ids(notes, {"query_text": "finance ops", "post_filters": [{"column": "score", "operator": "!=", "value": 7}]}) == [3]


def test_top_k(notes):
    assert ids(notes, {"query_text": "engineer", "top_k": 1}) == [1]
    assert ids(notes, {"query_text": "finance ops", "top_k": 1}) == [2]
    assert ids(notes, {"query_text": "engineer ops", "top_k": 1}) == [3]


def test_annotation(notes):
    row = search(notes, {"query_text": "find the finance"}).first()
    assert row["_summary"] == "[default] Matched 'finance' — title: Finance | notes: analyst in finance team"
    assert row["_matched_columns"] == ["title", "notes"] and row["_keywords"] == ["finance"]


def test_no_words_returns_the_scope(notes):
    assert ids(notes, {"query_text": "is it", "id_filters": [{"column": "id", "value": 2}]}) == [2]
    row = search(notes, {"query_text": "is it"}).first()
    assert "Matched 'is it'" in row["_summary"] and row["_keywords"] == []


def test_sheets(frame, notes):
    other = frame("id int, remark string", [(9, "engineer wanted")])
    book = {"Staff": notes, "Jobs": other, "Numbers": frame("n int", [1])}
    rows = search(book, {"query_text": "engineer", "top_k": 1}).collect()
    assert {(r["sheet"], r["id"]) for r in rows} == {("Staff", 1), ("Jobs", 9)}
    scoped = search(book, {"query_text": "engineer", "post_filters": [{"column": "sheet", "value": "jobs"}]}).collect()
    assert [(r["sheet"], r["id"]) for r in scoped] == [("Jobs", 9)]


def test_real_sheet_column(frame):
    df = frame("sheet string, id string, notes string", [("Sheet1", "123", "engineer"), ("Sheet2", "201", "engineer")])
    assert ids(df, {"query_text": "engineer", "target_text_columns": ["notes"],
                    "post_filters": [{"column": "sheet", "operator": "=", "value": "Sheet1"}]}) == ["123"]


@pytest.mark.parametrize(
    "plan",
    [{}, {"query_text": "  "}, {"query_text": "x1y", "id_filters": [{"column": "nowhere", "value": 1}]},
     {"query_text": "engineer", "post_filters": [{"column": "nowhere", "value": 1}]},
     {"query_text": "engineer", "post_filters": [{"column": "title", "operator": ">", "value": "b"}]}],
)
def test_refusals(notes, plan):
    with pytest.raises(QueryIssue):
        search(notes, plan)


def test_no_text_column(frame):
    with pytest.raises(QueryIssue):
        search(frame("n int", [1]), {"query_text": "engineer"})


def test_normalise(frame):
    rows = frame("t string", ["  A\t\n b  C ", None, "\n"]).select(normalise_text(F.col("t"))).collect()
    assert [r[0] for r in rows] == ["a b c", "", ""]


VECTORS = ("id int, text string, v array<float>",
           [(1, "same", [0.0, 0.0]), (2, "same", [0.0, 1.0]), (3, "far", [9.0, 9.0]), (4, "near", [1.0, 0.0]), (5, "none", None)])


def test_nearest(frame, tmp_path):
    df = frame(*VECTORS)
    found = vectors.nearest(df, [0.0, 0.0], "v", "id", k=3).collect()
    assert [(r["id"], r["vector_score"]) for r in found] == [(1, 0.0), (2, 1.0), (4, 1.0)]
    assert len(vectors.nearest(df, [0.0, 0.0], "v", "id").collect()) == 4
    index = store_vectors(df, str(tmp_path / "index"), "id", "text", "v")
    assert vectors.nearest(index, [9, 9], "embedding", "id", k=1).first()["text"] == "far"
    assert vectors.mean_vector(df, "v", 2) == pytest.approx([2.5, 2.5])


def test_equal_texts_count_once_after_the_search(frame):
    found = vectors.nearest(frame(*VECTORS), [0.0, 0.0], "v", "id", k=3)
    unique = vectors.unique_matches(found, "text", "id").orderBy("vector_score").collect()
    assert [r["id"] for r in unique] == [1, 4]
    assert unique[1]["_summary"] == "Semantic Match (Score: 1.0000): near..."


def talk(frame, *messages):
    return frame("conv_id int, turn int, role string, text string", [(1, n, r, t) for n, (r, t) in enumerate(messages)])


def history(df, **options):
    return conversations.last_turns(df, **options).first()["history"]


def test_history_keeps_the_last_exchanges(frame):
    pairs = [m for n in range(1, 8) for m in (("user", f"Query {n}"), ("assistant", f"Response {n}"))]
    lines = [f"{who}: {what} {n}" for n in range(3, 8) for who, what in (("User", "Query"), ("Assistant", "Response"))]
    assert history(talk(frame, *pairs)) == "\n".join(lines)
    assert history(talk(frame, *pairs), turns=2) == "\n".join(lines[-4:])
    assert history(talk(frame, *pairs), turns=50).count("\n") == 13


def test_history_with_gaps(frame):
    df = talk(frame, ("system", "be kind"), ("user", "one"), ("assistant", "1"), ("assistant", "2"), ("user", " "), ("assistant", "3"),
              ("user", "four"))
    assert history(df) == "User: one\nAssistant: 1\nAssistant: 2\nAssistant: 3\nUser: four"
    assert history(df, turns=3) == "Assistant: 2\nAssistant: 3\nUser: four"
    assert history(df, turns=1) == "User: four"
    assert history(talk(frame, ("user", None), ("assistant", "  "))) == ""


def test_history_shortens_answers_only(frame):
    df = talk(frame, ("user", "u" * 300), ("assistant", "A" * 195 + "  " + "B" * 50), ("user", "x"), ("assistant", "C" * 200))
    lines = history(df).split("\n")
    assert lines[0] == "User: " + "u" * 300 and lines[1] == "Assistant: " + "A" * 195 + "..."
    assert lines[3] == "Assistant: " + "C" * 200


def test_long_conversation_beside_short_ones(spark):
    df = spark.range(20000).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 0 ELSE id % 500 END AS conv_id", "id AS turn",
        "CASE WHEN pmod(hash(id), 2) = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('m', id) AS text")
    got = {r["conv_id"]: r["history"] for r in conversations.last_turns(df, turns=3).collect()}
    by_conv = {}
    for r in df.orderBy("turn").collect():
        by_conv.setdefault(r["conv_id"], []).append(r)
    for conv, messages in by_conv.items():
        exchanges = []
        for m in messages:
            if m["role"] == "assistant" and exchanges and len(exchanges[-1]) == 1 and exchanges[-1][0]["role"] == "user":
                exchanges[-1].append(m)
            else:
                exchanges.append([m])
        want = [f"{m['role'].capitalize()}: {m['text']}" for e in exchanges[-3:] for m in e]
        assert got[conv] == "\n".join(want)


def test_turns_are_stored_and_read(spark, frame, tmp_path):
    path = str(tmp_path / "talks")
    conversations.append_turns(talk(frame, ("user", "a")), path)
    conversations.append_turns(frame("conv_id int, turn int, role string, text string", [(1, 1, "assistant", "b"), (2, 0, "user", "c")]), path)
    assert [r["text"] for r in conversations.turns_of(spark.read.parquet(path), 1).collect()] == ["a", "b"]


def test_intent_tags(frame):
    texts = ["What is the TOTAL and mean?", "How many columns", "summit", "compare highest with lowest", None]
    got = [r[0] for r in frame("t string", texts).select(conversations.intent_tags(F.col("t"))).collect()]
    assert got == [["sum", "avg"], ["count", "profile"], [], ["max", "min", "correlation"], []]


def test_intent_words_end_at_any_sign_but_ascii_word_characters(frame):
    texts = ["\u00e9sum", "compare\u0144", "sum\u0301 total_", "M\u0130N", "avg2 \u4e00max\u4e00"]
    got = [r[0] for r in frame("t string", texts).select(conversations.intent_tags(F.col("t"))).collect()]
    assert got == [["sum"], ["correlation"], ["sum"], ["min"], ["max"]]


def test_search_keeps_all_matches_unless_asked(frame):
    notes = frame("id int, note string", [(i, "engineer on duty") for i in range(20)])
    assert len(search(notes, {"query_text": "engineer"}).collect()) == 20
    assert len(search(notes, {"query_text": "engineer", "top_k": None}).collect()) == 20
    assert search(notes, {"query_text": "engineer", "top_k": 0}).collect() == []


def test_vectors_without_a_distance_never_rank(frame):
    rows = [(1, [1.0, None]), (2, [1.0]), (3, [float("nan"), 0.0]), (4, None), (5, [3.0, 4.0]), (6, [0.0, 1.0])]
    found = vectors.nearest(frame("id int, v array<double>", rows), [0.0, 0.0], "v", "id", k=4).collect()
    assert [(r["id"], r["vector_score"]) for r in found] == [(6, 1.0), (5, 25.0)]
