import duckdb
import pandas as pd
import pytest

from evidra.plans import catalogue

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return c


def rows(df):
    cells = df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)
    return sorted(str(tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r)) for r in cells)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, SMALL).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql:
        assert rows(got) == rows(duck.sql(sql).df())
    else:
        assert len(got)


def test_library_works_without_the_training_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def gone(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("evidra.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="evidra.llm")
        return real(name, globals, locals, fromlist, level)

    for m in [m for m in sys.modules if m.startswith("evidra.llm") or m == "__spark_entry__"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", gone)
    entry = importlib.import_module("__spark_entry__")
    assert "hybrid_search" in entry.queries() and not any(k.startswith("op1_") for k in entry.queries()) and "bm25_topk" in entry.oracle_sql()
