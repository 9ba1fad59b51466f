import csv as python_csv
import datetime as dt
import random

import pytest

from gridsense import QueryIssue, run
from gridsense.operators import chunking, cleaning, profiling
from gridsense.sources import csv, records, sheets, storage


@pytest.fixture
def written(tmp_path, spark):
    def write(text, encoding="utf-8", **options):
        path = tmp_path / "table.csv"
        path.write_bytes(text.encode(encoding))
        if encoding not in ("utf-8", "utf-8-sig"):
            options["encoding"] = encoding
        return csv.read_csv(spark, str(path), **options)

    return write


def plain(df):
    return [tuple(row) for row in df.collect()]


@pytest.mark.parametrize("mark", [",", ";", "\t", "|"])
def test_delimiters(written, mark):
    df = written(f'name{mark}pay\n"A{mark} b"{mark}1\nC{mark}2\n')
    assert df.columns == ["name", "pay"] and plain(df) == [(f"A{mark} b", 1), ("C", 2)]


def test_semicolons_with_decimal_commas(written):
    assert plain(written("name;label\nX;1,5\nY;2,25\n")) == [("X", "1,5"), ("Y", "2,25")]


def test_encodings(written):
    assert plain(written("city,n\nMünchen,1\n", "latin-1")) == [("München", 1)]
    marked = written("id,city\n1,Paris\n", "utf-8-sig")
    assert marked.columns == ["id", "city"] and plain(marked) == [(1, "Paris")]


def test_wide_encodings(written):
    assert plain(written("city;n\nMünchen;1\n", "utf-16")) == [("München", 1)]


def test_line_ends_and_blank_lines(written):
    assert plain(written("a,b\r\n1,x\r\n2,y\r\n")) == [(1, "x"), (2, "y")]
    assert plain(written("a,b,c\n1,2,3\n\n4,5,6\n\n\n\n")) == [(1, 2, 3), (4, 5, 6)]


def test_quotes_and_cells_over_several_lines(written):
    df = written('id,text\n1,"one\ntwo ""quoted"" three"\n2,plain\n')
    assert plain(df) == [(1, 'one\ntwo "quoted" three'), (2, "plain")]


def test_only_needed_files_are_unsplittable(tmp_path, spark):
    (tmp_path / "a.csv").write_text('id,t\n1,"x ""y"" z"\n')
    (tmp_path / "b.csv").write_text('id,t\n1,"x\ny"\n')
    assert not csv.has_multiline_cells(spark, str(tmp_path / "a.csv"))
    assert csv.has_multiline_cells(spark, str(tmp_path / "b.csv"))


def test_repeated_and_empty_names(written):
    df = written("a,b,a,A,,a.1\n1,2,3,4,5,6\n")
    assert df.columns == ["a", "b", "a.1", "A.2", "_c4", "a.1.1"] and plain(df) == [(1, 2, 3, 4, 5, 6)]


def test_records_that_are_too_long_or_too_short(written):
    with pytest.raises(QueryIssue, match="1 of 3 records"):
        written("a,b\n1,2\n3,4,5\n6\n")
    assert plain(written("a,b\n1,2\n3,4,5\n6\n", overlong="cut")) == [(1, 2), (3, 4), (6, None)]
    assert plain(written("a,b\n1,2,\n3,4,\n")) == [(1, 2), (3, 4)]
    with pytest.raises(Exception, match="more cells"):
        written("a,b\n1,2,3\n", types={"a": "int"}).collect()


def test_quotes_inside_cells_are_plain(written):
    assert plain(written('n,size\n1,12" disc\n2,7"\n')) == [(1, '12" disc'), (2, '7"')]
    df = written('n,size,t\n1,12" disc,"a\nb"\n2,7",x\n3,"c, ""d"\n\n"",y\n')
    assert plain(df.where("n IS NOT NULL").orderBy("n"))[:2] == [(1, '12" disc', "a\nb"), (2, '7"', "x")]


def test_the_delimiter_is_that_of_most_lines(tmp_path, spark):
    (tmp_path / "a.csv").write_text("name;place, country;n\n" + "x;y;1\n" * 30)
    assert csv.sniff_delimiter(spark, str(tmp_path / "a.csv")) == ";"


def cells_of(rnd):
    kinds = ["plain", "12\" x", "", "comma, here", "two\nlines", "a \"quote\"", "\n\n", "end\"", "\"", ",\n,", "x" * 40]
    return rnd.choice(kinds)


@pytest.mark.parametrize("seed", range(4))
def test_split_files_give_the_records_of_whole_ones(tmp_path, spark, seed):
    rnd = random.Random(seed)
    want = []
    for name in ("a.csv", "b.csv"):
        rows = [[f"{name}{i}", cells_of(rnd), cells_of(rnd)] for i in range(120)]
        with open(tmp_path / name, "w", newline="") as file:
            writer = python_csv.writer(file, lineterminator="\n")
            writer.writerows([["id", "one", "two"], *rows])
        want += [(r[0], *(c if c else None for c in r[1:])) for r in rows]
    for size in ("64m", "700b", "90b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "16b")
        try:
            df = csv.read_csv(spark, str(tmp_path), sep=",", multi_line=True, tokens=("",))
            tasks = records.lines(spark, str(tmp_path), "UTF-8").rdd.getNumPartitions()
            got = sorted(plain(df))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert got == sorted(want)
    assert tasks > 8


def test_types(written):
    df = written("i,f,s,b,z,m,e\n1,1.5e-3,x,True,007,1,\n-2,2,1,False,010,,\n")
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "s": "string", "b": "boolean", "z": "bigint", "m": "bigint",
                               "e": "double"}
    assert plain(df)[1] == (-2, 2.0, "1", False, 10, None, None)


def test_missing_value_tokens(written):
    df = written("id,name,score\n1,N/A,1\n2,NULL,nan\n3,ok,NA\n4,#N/A,2.5\n")
    assert plain(df) == [(1, None, 1.0), (2, None, None), (3, "ok", None), (4, None, 2.5)]
    kept = written("id,name\n1,N/A\n", tokens=("-",))
    assert plain(kept) == [(1, "N/A")]


def test_given_types(written):
    df = written("id,n,d\n1, 5 ,2024-01-02\n2,x,soon\n", types={"n": "int", "d": "date"})
    assert plain(df) == [("1", 5, dt.date(2024, 1, 2)), ("2", None, None)]


def test_header_only_single_column_and_number_names(written):
    empty = written("id,name\n")
    assert empty.columns == ["id", "name"] and empty.count() == 0
    assert run(empty, {"operation": "count"}).rows() == [{"count": 0}]
    assert plain(written("value\n10\n20\n")) == [(10,), (20,)]
    assert written("2020,2021\n1,2\n").columns == ["2020", "2021"]
    wide = written(",".join(f"c{i}" for i in range(100)) + "\n" + ",".join(map(str, range(100))) + "\n")
    assert run(wide, {"operation": "count"}).rows() == [{"count": 1}]


def test_folder_of_files(tmp_path, spark):
    for n in range(3):
        (tmp_path / f"part{n}.csv").write_text(f"id,v\n{n},{n * 10}\n")
    assert sorted(plain(csv.read_csv(spark, str(tmp_path)))) == [(0, 0), (1, 10), (2, 20)]


def test_headers():
    assert cleaning.clean_names(["Employee Name", "Dept. Code", "Salary ($)", "% Bonus", " x ", "X!", "x?"]) == [
        "Employee Name", "Dept Code", "Salary ", " Bonus", "x", "X_2", "x_3"
    ]


def test_clean(frame):
    df = frame("`a!` string, n int", [("x", 1), (None, None), (None, 2)])
    assert plain(cleaning.clean(df)) == [("x", 1), (None, 2)]
    assert plain(cleaning.clean(df, fill=True)) == [("x", 1), ("N/A", 2)]
    assert plain(cleaning.fill_missing(df, every_column=True))[1] == ("N/A", "N/A")


def test_flat_rows(frame):
    own = cleaning.flat_rows(frame("ID int, v string", [(123, "a")]), sheet="S1")
    assert own.columns == ["sheet", "id", "v"] and plain(own) == [("S1", "123", "a")]
    numbered = cleaning.flat_rows(frame("v string", ["a", "b"]))
    assert len({row["id"] for row in numbered.collect()}) == 2


def test_dense_row_numbers(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("id AS v")
    rows = cleaning.flat_rows(df, dense=True).collect()
    assert sorted((r["v"], int(r["id"])) for r in rows) == [(i, i) for i in range(1000)]


def test_sheets_from_files(tmp_path, spark):
    (tmp_path / "one.csv").write_text("id,Gender\n123,Male\n")
    (tmp_path / "two.csv").write_text("id;Age\n124;45\n")
    book = sheets.read_sheets(spark, {"Sheet1": str(tmp_path / "one.csv"), "Sheet2": str(tmp_path / "two.csv")})
    flat = sheets.flatten(book)
    assert [r.asDict() for r in flat.orderBy("id").collect()] == [
        {"sheet": "Sheet1", "id": "123", "Gender": "Male", "Age": None},
        {"sheet": "Sheet2", "id": "124", "Gender": None, "Age": 45},
    ]
    assert run(flat, {"filters": {"sheet": "Sheet2", "id": 124}}).df.count() == 1


def test_store_and_register(spark, frame, tmp_path):
    df = storage.store(frame("k string, v int", [("a", 1), ("b", 2)]), str(tmp_path / "t"), partition_by=["k"])
    storage.store(df.where("v = 1"), str(tmp_path / "u"))
    assert plain(spark.read.parquet(str(tmp_path / "u"))) == [(1, "a")]
    storage.register("stored", df)
    assert spark.sql("SELECT sum(v) AS s FROM stored").first()["s"] == 3


def test_scratch_stays_in_the_shared_folder(spark):
    assert storage.scratch_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_text_shape(frame):
    long, short = "w" * 120, "w"
    df = frame("a string, b string, c string, n int", [(long, short, "y" * 61, 1), (long, None, short, 2), (None, "z", short, 3)])
    shape = {r["column"]: r for r in profiling.text_shape(df).collect()}
    assert shape["a"]["is_heavy"] and shape["a"]["is_text"] and shape["a"]["avg_length"] == 120
    assert not shape["b"]["is_text"] and shape["c"]["is_text"] and not shape["c"]["is_heavy"]
    assert profiling.text_columns(df) == ["a", "c"] and profiling.is_text_heavy(df)
    assert not profiling.is_text_heavy(df.select("b", "n")) and profiling.text_columns(df.select("n")) == []


def test_column_profile(spark, frame):
    df = frame("name string, n double, e string, d date, b boolean",
               [(f"n{i % 9}", float(i), None, dt.date(2024, 1, 1 + i % 3), None if i else True) for i in range(40)]
               + [(None, float("nan"), None, None, None)])
    rows = {r["column"]: r for r in profiling.column_profile(df.repartition(5)).collect()}
    assert rows["name"]["samples"] == ["n0", "n1", "n2", "n3", "n4"] and rows["name"]["missing"] == 1
    assert (rows["n"]["min"], rows["n"]["max"], rows["n"]["missing"], rows["n"]["samples"]) == (0.0, 39.0, 1, None)
    assert rows["e"]["samples"] == [] and rows["e"]["missing"] == 41
    assert rows["d"]["samples"] == ["2024-01-01", "2024-01-02", "2024-01-03"] and rows["b"]["samples"] == ["true"]


def test_samples_match_a_plain_distinct(spark):
    df = spark.range(30000).selectExpr("concat('é', pmod(hash(id), 700)) AS a", "CAST(pmod(hash(id, 1), 3) AS STRING) AS b",
                                       "CAST(NULL AS STRING) AS c").repartition(6)
    got = {r["column"]: r["samples"] for r in profiling.smallest_values(df, ["a", "b", "c"]).collect()}
    for name in ("a", "b"):
        assert got[name] == [r[0] for r in df.select(name).distinct().orderBy(name).limit(5).collect()]
    assert "c" not in got


def test_profile_text(frame):
    df = frame("id int, city string, gap double", [(1, "Paris", None), (20, "Lyon", None)])
    assert profiling.profile_text(df).first()["profile"].split("\n") == [
        "Dataset: 2 rows, 3 cols", "- id (int): Range [1.0 to 20.0]", "- city (string): Samples: Lyon, Paris",
        "- gap (double): Range [N/A to N/A]",
    ]


def test_sample_rows(frame):
    assert [r["v"] for r in profiling.sample_rows(frame("v int", [9, 3, 7, 1, 8, 2]), "v").collect()] == [1, 2, 3, 7, 8]


def test_catalog(frame):
    one = frame("a int, b int, c int", [(1, 3, 5), (2, 4, 6)])
    two = frame("B int, d int", [(7, 9), (8, 10)])
    book = profiling.catalog_text({"Sheet1": one, "Sheet2": two}).first()["profile"]
    assert book.split("\n") == [
        "Workbook with 2 sheets", "Total rows: 4, Max columns :3", "Sheets:",
        "Sheet1: rows = 2, cols=3, columns=[a,b,c]", "Sheet2: rows = 2, cols=2, columns=[B,d]", "Columns (union): a,b,c,d",
    ]
    assert profiling.catalog_text(one).first()["profile"] == "Rows: 2, Columns: 3\nColumns: a,b,c"


def test_chunks(frame):
    text = "  " + "a" * 499 + "é" + "😀" * 3 + "\n end\t"
    df = frame("id string, body string, note string", [("r|1", text, "n/a"), ("r2", "   ", None)])
    rows = chunking.chunk_text(df, ["body", "note"], "id").orderBy("chunk_index").collect()
    stripped = text.strip()
    assert [r["text"] for r in rows] == [stripped[:500], stripped[500:]]
    assert rows[1]["chunk_id"] == "row:r_1|col:body|chunk:1" and rows[1]["sheet"] is None and rows[1]["row"] == "r|1"
    assert rows[1]["label"] == f"Chunk row:r_1|col:body|chunk:1 | Row r|1 | body: {stripped[500:]}"
    tagged = chunking.chunk_text(df, ["body"], "id", sheet="S").first()
    assert tagged["label"].startswith("Sheet S | Chunk sheet:S|row:r_1|col:body|chunk:0 | Row r|1 | body: ")


def test_ids_keep_every_digit(spark, tmp_path):
    from gridsense.sources.csv import read_csv

    path = tmp_path / "ids.csv"
    path.write_text("a,b\n1234567890123456789,12345678901234567890\n1234567890123456788,1\n")
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "decimal(38,0)"]
    assert {r["a"] for r in df.collect()} == {1234567890123456789, 1234567890123456788}


def test_periods_at_the_edge_of_the_calendar():
    from datetime import datetime

    from gridsense.functions.literals import number_of, period_of

    assert period_of("9999-12").start == datetime(9999, 12, 1) and period_of("9999-12").end is None
    assert period_of("9999Q4").end is None and period_of("0000-05") is None
    assert number_of("1234567890123456789") == 1234567890123456789
