"""Every registered query at the smallest scale, next to its SQL check where there is one."""

import duckdb
import pytest

import __spark_entry__ as se
from rollscope.sources.views import TABLES
from tools.check import norm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(se.queries()))
def test_query_matches_sql(spark, con, name):
    df = se.queries()[name](spark, SF)
    cols = sorted(df.columns)
    assert len(set(cols)) == len(cols)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in (x.asDict(recursive=True) for x in df.collect()))
    sql = se.oracle_sql().get(name)
    if sql is None:
        return
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert rows == want


def test_entry_runs(spark):
    df = se.entry(spark)
    assert df.columns == ["rank", "task_id", "regret", "pass_rate", "direction"]
    assert df.count() > 0
