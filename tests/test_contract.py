import re
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal


@pytest.fixture(scope="session")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "chunk_id", "score", "rank"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the optional subpackage's queries, all or none
    numbered = {n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)}
    assert numbered == set(entry._training_data()[0])


def test_names_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.split(".")[0] == "corpus_pipeline" or n.startswith("litweave.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "litweave.llm", None)
    assert not [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_oracle(spark, db, sf, name):
    got = entry.queries()[name](spark, sf).toPandas()
    want = db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
