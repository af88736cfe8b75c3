import pytest

from tests.compare import SF, difference
from wortlake.llm.queries import QUERIES
from wortlake.llm.sql import SQL


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    assert difference(df, SQL[name]) == "" if name in SQL else df.count() > 0


def test_packing_is_tight(spark):
    from wortlake.llm.queries import CAPACITY

    used = QUERIES["p7_packed"](spark, SF).selectExpr("sum(length) AS n", "count(DISTINCT container) AS k").first()
    # The incomplete containers of each class weigh at this size; at sf0.1 they do not.
    assert used.k <= used.n / CAPACITY / 0.93 + 12
