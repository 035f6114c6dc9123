"""Queries of the training-data operators that SQL can express, against that SQL, on a whole test table."""
import os
from collections import Counter

import duckdb
import pytest

from tidemill.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_of_sql(name, spark, data):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark"):
        path = f"{data}/{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    found = con.execute(ORACLE_SQL[name])
    names = sorted(d[0] for d in found.description)
    order = [[d[0] for d in found.description].index(n) for n in names]
    want = Counter(tuple(r[i] for i in order) for r in found.fetchall())
    df = QUERIES[name](spark, data)
    assert sorted(df.columns) == names
    assert Counter(tuple(r[n] for n in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_whole_table_comes_back(name, spark, data):
    out = QUERIES[name](spark, data)
    table = {"op1_extract": "pages", "op3_urls": "pages", "op5_topk": None, "op8_vectors": "embeddings", "op13_centroids": "embeddings"}.get(name, "documents")
    if table:
        assert out.count() == spark.read.parquet(f"{data}/{table}.parquet").count()
