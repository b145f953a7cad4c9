"""Every registered core query against its SQL, on the smallest tables; the rest still imports without llm."""

import glob
import math
import os
import subprocess
import sys

import duckdb
import pytest

from docloom.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.9g}"
    return "NULL" if value is None or str(value) in ("NaT", "nan", "<NA>") else f"{value:.9g}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(plain(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.skipif(not os.path.exists(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_core_does_not_need_llm():
    code = "import sys; sys.modules['docloom.llm'] = None; import __spark_entry__ as e; assert e.queries() and not any(q.startswith(('p1_', 'p4_')) for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
