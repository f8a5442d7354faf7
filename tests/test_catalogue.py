import os

import duckdb
import pytest

import __spark_entry__
from bitloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from '{DATA}/{name}'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_against_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.sql(f"select {', '.join(columns)} from ({catalogue.ORACLES[name]})")
    assert columns == want.columns
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_import_without_a_session():
    """The registered queries can be listed before there is a session."""
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=root, check=True)
