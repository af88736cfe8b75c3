import pytest

import __spark_entry__ as entry
from tests.compare import difference

SQL = entry.oracle_sql()
GENERAL = [name for name, query in entry.queries().items() if not query.__module__.startswith("wortlake.llm")]


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", GENERAL)
def test_query(spark, name):
    df = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert difference(df, SQL[name]) == "" if name in SQL else df.count() >= 0
