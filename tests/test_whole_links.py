"""The merging queries over whole tables, against their SQL and a union-find."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from tests.test_entry import SF, TABLES, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["components_whole", "rewrite_triples_whole", "merge_graphs_whole"])
def test_against_sql(spark, con, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_customer_is_mapped(spark, con):
    links = con.sql("SELECT o_custkey, l_suppkey, o_orderkey % 10 FROM orders JOIN lineitem ON o_orderkey = l_orderkey").fetchall()
    links = [(f"http://x/customer%2F{c}", f"http://x/supplier/{s}", k) for c, s, k in links]
    up = {u: u for c, s, _ in links for u in (c, s)}

    def root(u):
        while up[u] != u:
            up[u] = u = up[up[u]]
        return u

    for c, s, k in links:
        if k >= 7:
            up[root(c)] = root(s)
    members = {}
    for u in up:
        members.setdefault(root(u), []).append(u)
    want = {u: min(m, key=lambda x: ("%" in x, len(x), x)) for m in members.values() for u in m}
    found = __spark_entry__.queries()
    mapped = lambda name: {r["old"]: r["canonical"] for r in found[name](spark, SF).collect()}
    got = mapped("canonical_mapping_whole")
    assert got == want and max(Counter(got.values()).values()) > 100
    rings = mapped("canonical_mapping")
    assert len(rings) == con.sql("SELECT count(*) FROM orders").fetchall()[0][0]  # every order, in chains of many lengths
    assert len(set(Counter(rings.values()).values())) > 3 and any("%" in u for u in rings)
