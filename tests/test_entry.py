"""The catalogue against its SQL on the smallest tables, and the entry points."""

import importlib
import sys
from pathlib import Path

import pytest

from millrace.plans import catalog

SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not SF.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    return round(v, 6) if isinstance(v, float) else v


@needs_data
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    got = sorted([[shown(r[c]) for c in columns] for r in df.collect()], key=str)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted([[shown(r[i]) for i in at] for r in rel.fetchall()], key=str)


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "item_id", "k"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_training_data_part(monkeypatch):
    import __spark_entry__ as entry

    class Gone:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "millrace.llm"):
                raise ModuleNotFoundError(name, name=name)

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("millrace.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    again = importlib.reload(entry)
    assert again.llm is None and set(again.queries()) == set(catalog.QUERIES)
    monkeypatch.undo()
    importlib.reload(entry)
