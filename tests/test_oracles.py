"""Every registered query with an oracle equals it on the smallest data set."""

import oracle_check
import pytest
from conftest import SF

from pairlab.plans import oracles, registry

SQL = oracles.build()


@pytest.fixture(scope="module")
def con():
    return oracle_check.connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, con, name):
    text, _, _, ok = oracle_check.compare(
        spark, con, name, registry.QUERIES[name], SQL[name], SF
    )
    assert ok, text


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(registry.QUERIES)
