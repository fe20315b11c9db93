"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import pytest
from conftest import rows_of

from tallyloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    run, sql = QUERIES[name]
    df = run(spark, SF)
    mine = df.collect()
    if sql is None:
        assert df.columns
        return
    cur = duck.execute(sql)
    theirs = cur.fetchall()
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, mine) == rows_of(names, theirs)
