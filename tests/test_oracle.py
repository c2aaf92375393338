"""Every registered query with SQL gives DuckDB's rows."""

import pytest

from siltstone.plans import registry
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, con, sf, name):
    assert oracle.differences(spark, con, registry.QUERIES[name], registry.SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_approximate_is_near(spark, sf):
    row = registry.QUERIES["a25_approximate_users"](spark, sf).first()
    exact = registry.QUERIES["a25_distinct_users"](spark, sf).first()["users"]
    assert abs(row["users"] - exact) <= 0.05 * exact + 1 and abs(row["sketched"] - exact) <= 0.05 * exact + 1
