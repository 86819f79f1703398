"""The driver's contract, and the toolkit's queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from graphloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def rows(df: pd.DataFrame) -> list[str]:
    norm = lambda v: None if pd.isna(v) else float(v) if not isinstance(v, (str, bool)) else v
    return sorted(map(repr, df[sorted(df.columns)].map(norm).itertuples(index=False, name=None)))


def test_names():
    found = __spark_entry__.queries()
    assert set(queries.QUERIES) <= set(found) and set(__spark_entry__.oracle_sql()) <= set(found)
    assert set(queries.SQL) == set(queries.QUERIES)


@needs_tables
def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["left", "right", "score"] and df.take(1)


@needs_tables
@pytest.mark.parametrize("name", ["align", "align_metrics", "candidates", "canonical_mapping", "merge_graphs", "nt_roundtrip", "links_lenient", "sparql_json", "pair_ids", "components", "class_csv", "instance_csv", "manifest", "result_index", "mapping_file"])
def test_queries(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), con.sql(__spark_entry__.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
