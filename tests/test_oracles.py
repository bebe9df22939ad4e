"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import os

import pytest

import oracle
from webloom.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    assert oracle.compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], DATA) is None


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_adjacency_of_all_pages(spark, con):
    rows = catalog.queries()["link_adjacency_all"](spark, DATA).collect()
    anchors = con.execute("SELECT sum(len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) FROM pages").fetchone()[0]
    urls = dict(con.execute("SELECT page_id, regexp_replace(url, '#.*$', '') FROM pages").fetchall())
    assert len(rows) == anchors > 100
    order = [(urls[r.page_id], r.position, r.page_id) for r in rows]
    assert order == sorted(order)


def test_gzip_bodies_of_all_orders(spark, con):
    assert catalog.queries()["gzip_bodies_all"](spark, DATA).count() == con.execute("SELECT count(*) FROM orders").fetchone()[0] > 500
