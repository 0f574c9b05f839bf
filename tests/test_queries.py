"""Every query with SQL gives DuckDB's rows; every other one runs."""

import pytest

from marginalia.plans import registered
from tests.oracle import assert_same, connect

SLOW = {"e6_train_taxonomy"}


@pytest.fixture(scope="module")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(registered.SQL))
def test_same_rows_as_sql(spark, data, duck, name):
    df = registered.QUERIES[name](spark, data)
    assert_same([tuple(r) for r in df.collect()], df.columns, duck.execute(registered.SQL[name]))


@pytest.mark.parametrize("name", sorted(registered.QUERIES.keys() - registered.SQL.keys() - SLOW))
def test_runs(spark, data, name):
    registered.QUERIES[name](spark, data).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_names_can_be_read_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
