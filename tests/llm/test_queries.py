import pytest

from quire.llm import queries
from tests.oracle import differs

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query_equals_its_sql(spark, name):
    assert differs(spark, SF, queries.queries()[name], queries.oracle_sql()[name]) == ""


def test_every_operator_is_registered():
    assert {int(n.split("_")[0][2:]) for n in queries.queries()} == set(range(1, 11))
