"""Every catalogue query gives the rows of its SQL; those without SQL give rows."""

import pytest

from oracle import compare, connect
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
EMPTY_OK = {"event_streak"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    if name in catalogue.ORACLE_SQL:
        assert not compare(df, catalogue.ORACLE_SQL[name], duck)[:3]
    elif name not in EMPTY_OK:
        assert df.count() > 0
