"""Every registered query against its SQL on the smallest tables; those without SQL must run."""

import oracle
import pytest

import commitlens.plans.all  # noqa: F401
from commitlens.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return oracle.duck()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, oracle.SF)
    if name in ORACLES:
        oracle.same(df, con, ORACLES[name])
    else:
        assert df.columns and df.count() >= 0
