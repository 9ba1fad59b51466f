import pytest

from gridsense.sources.dataset import index_texts, load, registry


@pytest.fixture
def workbook(spark, tmp_path):
    (tmp_path / "sales.csv").write_text("Region,Revenue ($)\nNorth,120000\nSouth,98000\n,\n")
    (tmp_path / "staff.csv").write_text("id;bio;salary\n7;" + "engineer in the platform team " * 20 + ";90000\n8;n/a;80000\n")
    return load(spark, "company", {"Sales": str(tmp_path / "sales.csv"), "Staff": str(tmp_path / "staff.csv")})


def test_workbook(workbook, spark):
    assert workbook.data["Sales"].columns == ["Region", "Revenue "] and workbook.data["Sales"].count() == 2
    rows = workbook.run({"operation": "sum", "columns": ["revenue"]}, per_sheet=True).rows()
    assert [r["sheet"] for r in rows] == ["Sales", "Staff"]
    flat = workbook.run({"operation": "count", "group_by": ["sheet"]}).rows()
    assert flat == [{"sheet": "Sales", "count": 2}, {"sheet": "Staff", "count": 2}]
    assert [r["id"] for r in workbook.search({"query_text": "platform engineer"}).collect()] == [7]
    assert [r["rows"] for r in workbook.catalog().orderBy("position").collect()] == [2, 2]
    assert "Total rows: 4" in workbook.catalog_text().first()["profile"]
    assert workbook.profile_text()["Sales"].first()["profile"].startswith("Dataset (Sheet: Sales): 2 rows, 2 cols")
    listed = registry([workbook]).orderBy("sheet").collect()
    assert [(r["dataset"], r["sheet"], r["columns"]) for r in listed] == [
        ("company", "Sales", "Region,Revenue "), ("company", "Staff", "id,bio,salary")]
    workbook.register()
    assert spark.sql("SELECT max(salary) AS s FROM company_Staff").first()["s"] == 90000


def test_only_text_heavy_sheets_are_cut(workbook):
    chunks = workbook.chunks()
    assert list(chunks) == ["Staff"]
    rows = chunks["Staff"].orderBy("chunk_index").collect()
    texts = index_texts(workbook).collect()
    assert len(texts) == 2 and texts[0]["text"].startswith("Sheet Staff | Chunk ")
    assert [r["chunk_id"] for r in rows] == ["sheet:Staff|row:7|col:bio|chunk:0", "sheet:Staff|row:7|col:bio|chunk:1"]


def test_single_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,v\na,1\nN/A,2\n")
    table = load(spark, "t", str(tmp_path / "t.csv"), fill=True)
    assert sorted(r["name"] for r in table.data.collect()) == ["N/A", "a"]
    assert table.run({"operation": "max", "columns": ["v"]}).rows() == [{"max_v": 2}]
    assert table.catalog_text().first()["profile"] == "Rows: 2, Columns: 2\nColumns: name,v"
    assert table.chunks() == {} and list(table.profile_text()) == [""]
    assert set(table.table.columns) == {"name", "v", "id"}
    assert [r["id"] for r in index_texts(table).collect()] == ["t"]
    table.register()
    assert spark.table("t").count() == 2
