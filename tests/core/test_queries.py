"""Queries against their SQL, on the smallest tables."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
from helixloom.plans import oracle, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(set(queries.registry()) & set(oracle.sql()))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set threads = 4; set memory_limit = '6GB'; set max_temp_directory_size = '3GB'")
    for t in os.listdir(SF):
        c.sql(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = queries.registry()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(same, r)) for r in df.select(*columns).collect()), key=str)
    r = duck.execute(oracle.sql()[name])
    at = [[d[0] for d in r.description].index(c) for c in columns]
    assert got == sorted((tuple(same(x[i]) for i in at) for x in r.fetchall()), key=str)


def test_entry_works_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("helixloom.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "helixloom.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    import __spark_entry__

    assert set(NAMES) <= set(__spark_entry__.queries()) and not [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert set(__spark_entry__.oracle_sql()) == set(oracle.sql())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
