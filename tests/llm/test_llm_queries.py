"""Every training-data query against its oracle, and that it runs at all."""

import os

import oracle
import pytest

from plexora.llm.queries import REG

SCALE = os.environ.get("PLEXORA_TEST_SF", "sf0.001")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SCALE)


@pytest.mark.parametrize("name", sorted(REG.sql))
def test_matches_oracle(spark, con, name):
    oracle.compare(spark, name, REG.queries[name], REG.sql[name], SCALE, con)


@pytest.mark.parametrize("name", sorted(set(REG.queries) - set(REG.sql)))
def test_runs(spark, name):
    df = REG.queries[name](spark, f"{oracle.DATA}/{SCALE}")
    assert df.columns and df.collect() is not None
