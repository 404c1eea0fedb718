"""Every query with SQL against that SQL, on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if not n.startswith("op")))
def test_same_as_sql(spark, engine, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    result = engine.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    want = sorted(tuple(plain(row[result.columns.index(c)]) for c in columns) for row in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_citations_of_odd_documents(spark, tmp_path):
    texts = ["ab", "", "abcd \n\t ", "abcd\f\r", "abcd\u00a0\u00a0", "abcd \u3000 ", "abcd\u2003\u202f", "abcd\v\v", "abcd\u3000hello\u3000", "words that\nno  document has", "abcd hello  there", None]
    rows = [(5 * i + m, t) for i, t in enumerate(texts) for m in range(5)] + [(-3, "abcd so"), (-7, "a"), (None, "abcd so"), (None, "ab")]
    rows += [(n, t) for n in range(1000, 1005) for t in ("ab", "abcd one", "abcd two", "abcd two")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    got = entry.queries()["cited_findings"](spark, str(tmp_path)).select("finding", "dropped").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, con.sql(ORACLES["cited_findings"]).fetchall()))
