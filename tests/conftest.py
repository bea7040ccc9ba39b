import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session, ship_package

    s = local_session("4", "4g")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    """The driver's tables as views of DuckDB."""
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}{'/*.parquet' if os.path.isdir(f) else ''}')")
    return con


@pytest.fixture(scope="session")
def agree(spark, duck, sf_dir):
    """Compares a query with its SQL: same columns, same rows in any order."""

    def rows(columns, found):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        plain = lambda v: repr(round(v, 9)) if isinstance(v, float) else repr(v)
        return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in found)

    def check(name):
        import __spark_entry__ as entry

        df = entry.queries()[name](spark, sf_dir)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        r = duck.execute(entry.oracle_sql()[name])
        assert got == rows([c[0] for c in r.description], r.fetchall())

    return check
