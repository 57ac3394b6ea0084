import os

import pytest
from pyspark.sql import SparkSession

from pagemill import ship

DATA = os.environ.get("PAGEMILL_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test tables here")
    return path


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def same(df, duck, sql):
    """Asserts that both give the same rows, in any order, under the same names."""
    got = df.collect()
    q = duck.execute(sql)
    names, rows = [x[0] for x in q.description], q.fetchall()
    assert sorted(df.columns) == sorted(names)
    columns = sorted(names)
    a = sorted(repr([plain(r[c]) for c in columns]) for r in got)
    b = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in rows)
    assert len(a) == len(b)
    assert a == b
