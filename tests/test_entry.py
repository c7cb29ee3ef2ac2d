"""The driver contract, and every SQL-checked query at the smallest scale."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

import __spark_entry__ as contract  # noqa: E402
from check_queries import check, connect  # noqa: E402
from smallest import SF  # noqa: E402


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["l_returnflag", "dim", "n", "mean_effect"]
    assert df.count() > 0


def test_keys_agree():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 60


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    line = check(spark, con, name, SF)
    assert line.startswith("ok"), line
