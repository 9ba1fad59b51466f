import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from gridsense.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "local[4]",
        "gridsense-tests",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture
def frame(spark):
    """Make a table from a schema string and rows."""

    def make(schema, rows):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def ask(frame):
    """Run a request over an inline table and return plain rows."""
    from gridsense import run

    def answer(schema, rows, request):
        return run(frame(schema, rows), request).rows()

    return answer
