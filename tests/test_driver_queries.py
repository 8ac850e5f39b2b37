import math

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerfold.plans import driver_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(driver_queries.ORACLES))
def test_against_sql(spark, db, name):
    got = driver_queries.QUERIES[name](spark, SF)
    want = db.sql(driver_queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    at = [want.columns.index(c) for c in order]
    assert a == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_records_are_whole_where_one_person_has_most_votes(spark, tmp_path):
    spark.createDataFrame([(i, f"c{i}", 9000.0 if i % 3 == 1 else 0.0) for i in range(1, 17)], "c_custkey long, c_name string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(i, 1 if i < 600 else 16 if i < 1000 else 2, "F", "1-URGENT", "1995-01-01") for i in range(1100)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate string"
    spark.createDataFrame(orders, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    for name in ("legislator_votes", "legislator_records"):
        con = duckdb.connect()
        for t in ("customer", "orders"):
            con.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
        got = driver_queries.QUERIES[name](spark, str(tmp_path)).select("person_id", "vote_event_id").collect()
        want = con.sql(driver_queries.ORACLES[name]).project("person_id, vote_event_id").fetchall()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert len(got) == {"legislator_votes": 604, "legislator_records": 1014}[name]


def test_titles_of_odd_pages(spark, tmp_path):
    """References that are cut off, wide spaces, a drawing's own title, no title."""
    titles = ["a&amp", "b &amp;&am", "c&lt", "d &#39", "&lt;e&gt; &amp;lt; &quot;x&quot;", "f & g && h", " i\n\tj ", "k\u3000l\u00a0m", "", "n&#x27;s"]
    pages = [(i, f"<html><head><title>{t}</title></head><body><td>x</td></body></html>") for i, t in enumerate(titles)]
    pages += [(50, "<title>first</title><svg><title>drawn</title></svg>"), (51, "<p>none</p>"), (52, None)]
    spark.createDataFrame([(i, "u", h) for i, h in pages], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = driver_queries.QUERIES["roll_call_pages"](spark, str(tmp_path)).select("page_id", "title").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(driver_queries.ORACLES["roll_call_pages"]).project("page_id, title").fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "seq" and set(entry.oracle_sql()) <= set(entry.queries())
