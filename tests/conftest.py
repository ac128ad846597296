import math
import os
import sys
from collections import Counter

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from verbarium.session import clear_scratch, get_spark  # noqa: E402

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = get_spark(cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    clear_scratch(session)
    session.stop()


def canonical(value):
    if isinstance(value, list):
        return tuple(map(canonical, value))
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def bag(rows):
    return Counter(tuple(canonical(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def duck():
    """The smallest test tables as views."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(TESTDATA):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for name in os.listdir(TESTDATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{TESTDATA}/{name}'")
    return con


def compare(spark, duck, query, sql):
    df = query(spark, TESTDATA)
    columns = sorted(df.columns)
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert bag(df.select(columns).collect()) == bag([tuple(r[i] for i in order) for r in result.fetchall()])
