"""Every query with SQL gives the SQL's rows; every query runs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from tools import compare  # noqa: E402

CORE = [n for n in entry.queries() if not n.startswith("p") or not n[1:2].isdigit() or n.startswith("p2_")]


@pytest.fixture(scope="module")
def connection(sf_dir):
    return compare.oracle(sf_dir)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, sf_dir, connection, name):
    said, _, ok = compare.compare(spark, connection, name, entry.queries()[name], entry.oracle_sql().get(name), sf_dir)
    assert ok, said


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "grain" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
