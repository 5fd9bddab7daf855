"""Every core query against its oracle; queries without one must run."""

import os

import oracle
import pytest

import __spark_entry__ as entry

SCALE = os.environ.get("PLEXORA_TEST_SF", "sf0.001")
CORE = {k: q for m in entry._CORE for k, q in __import__(f"plexora.plans.{m}", fromlist=["REG"]).REG.queries.items()}
SQL = {k: s for m in entry._CORE for k, s in __import__(f"plexora.plans.{m}", fromlist=["REG"]).REG.sql.items()}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SCALE)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    oracle.compare(spark, name, CORE[name], SQL[name], SCALE, con)


@pytest.mark.parametrize("name", sorted(set(CORE) - set(SQL)))
def test_runs(spark, name):
    df = CORE[name](spark, f"{oracle.DATA}/{SCALE}")
    assert df.columns and df.collect() is not None


def test_entry(spark):
    assert entry.entry(spark).limit(1).collect()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_one_key_for_each_name():
    names = list(CORE)
    assert len(names) == len(set(names))
