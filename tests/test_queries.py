"""Every registered query against its SQL, on the smallest tables."""

import pytest

from oracle import connect, differences
from tripleloom.workloads import ALL

SF_DIR = "/root/testdata/sf0.001"
# These find nothing in the smallest tables, on both sides.
MAY_BE_EMPTY = {"mappings_by_dataset"}


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(ALL))
def test_same_as_sql(spark, con, name):
    found = differences(ALL[name], spark, con, SF_DIR)
    if name in MAY_BE_EMPTY and found == ["SQL gives no rows"]:
        return
    assert not found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
