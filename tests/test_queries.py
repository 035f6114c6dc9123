"""Every query runs, and gives the rows of its SQL where it has one."""
import datetime
import decimal
import math
import os

import duckdb
import pytest

import __spark_entry__

NAMES = sorted(__spark_entry__.queries())
SQL = __spark_entry__.oracle_sql()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries of the training-data operators have tests of their own, on rows made for them.
OWN = [n for n in NAMES if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_rows_of_sql(name, spark, duck, data):
    df = __spark_entry__.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL])
def test_rows_without_sql(name, spark, data):
    df = __spark_entry__.queries()[name](spark, data)
    assert df.columns and df.count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(NAMES)


@pytest.mark.parametrize("name", ["x6_tumbling_windows", "x6_sliding_windows", "x6_sessions", "x3_stage_states"])
def test_streams_of_many_shuffled_files(name, spark, data, tmp_path):
    path = f"{tmp_path}/events.parquet"
    spark.read.parquet(f"{data}/events.parquet").repartition(200).write.parquet(path)
    # Spark drops late rows from the third batch on, so files for two batches of 64 would not show it.
    assert len([f for f in os.listdir(path) if f.endswith(".parquet")]) > 128
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect()) == want


def test_distances_have_no_cap(spark, tmp_path):
    n = 1_000_003
    spark.range(n).selectExpr("id AS vec_id", "array(1.0f, 2.0f) AS embedding", "1 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    df = __spark_entry__.queries()["p6_distance_threshold"](spark, str(tmp_path))
    assert {r["query_id"]: r["count"] for r in df.groupBy("query_id").count().collect()} == {0: n, 7: n, 20: n}
    assert __spark_entry__.queries()["n12_cosine_distance"](spark, str(tmp_path)).count() == n
