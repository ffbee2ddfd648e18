import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]


@pytest.fixture(scope="session")
def spark():
    from pagelens.session import local_session

    session = local_session(8, "tests")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Values of one expression over rows of literals."""

    def run(rows, schema, expression):
        frame = spark.createDataFrame(rows, schema).coalesce(1)
        return [r[0] for r in frame.select(expression.alias("value")).collect()]

    return run
