import pytest

from geoflow.queries import QUERIES, SQL
from tests.oracle import SF, same_rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    same_rows(QUERIES[name](spark, SF), SQL[name])
