import compare
import pytest

from pagelens.llm.queries import LLM_QUERIES, LLM_SQL

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", list(LLM_SQL))
def test_query_equals_its_sql(spark, name):
    assert name in LLM_QUERIES
    with compare.connect(SF) as con:
        assert compare.compare(spark, con, name, SF) == ""
