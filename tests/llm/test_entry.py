"""The driver's entry: every numbered query is there, and SQL twins agree."""

import os
import re

import duckdb
import pytest

import __spark_entry__

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_warc_bundles", "op9_embedding_groups", "op12_source_divergence", "op13_repeated_passages"])
def test_like_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    expected = con.sql(__spark_entry__.oracle_sql()[name]).df()
    found = __spark_entry__.queries()[name](spark, SF_DIR).toPandas()
    columns = sorted(expected.columns)
    plain = [df[columns].astype(object).where(df[columns].notna(), None).values.tolist() for df in (expected, found)]
    rows = [sorted((tuple(int(v) if isinstance(v, float) and v.is_integer() else v for v in r) for r in x), key=repr) for x in plain]
    assert sorted(expected.columns) == sorted(found.columns) and rows[0] == rows[1]
