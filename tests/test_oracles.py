import pytest

from grovewise.plans.oracles import ORACLES
from grovewise.plans.queries import QUERIES
from oracle import compare


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in ORACLES:
        compare(spark, QUERIES[name], ORACLES[name], "/root/testdata/sf0.001")
    else:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
