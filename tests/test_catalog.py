import os

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from fwlens.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, SF, name, catalog.QUERIES[name], catalog.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).columns == ["bin_faddr", "lib_faddr"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
