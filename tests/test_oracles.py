import pytest

from folioflow.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    assert compare(spark, data, QUERIES[name], ORACLES[name]) > 0


def test_every_query_has_a_name_and_runs(spark, data):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, data).count() > 0
