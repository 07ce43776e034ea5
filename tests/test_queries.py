"""Every core query beside its SQL on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from compare import plain
from tallyloom.plans.registry import core_queries, core_sql

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(core_queries()))
def test_query(spark, base, name):
    df = core_queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in core_sql():
        return
    cursor = base.execute(core_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert mine == Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
