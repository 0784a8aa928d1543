import pytest

from quillmask.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_gives_the_rows_of_its_sql(spark, con, name):
    oracle.check(registry.queries()[name](spark, oracle.DATA), registry.oracle_sql()[name], con)
