import pytest

from quillmask.llm import queries
from tests import oracle


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    oracle.check(queries.queries()[name](spark, oracle.DATA), queries.oracle_sql()[name], oracle.connect())
