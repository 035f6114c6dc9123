"""Vector search for many queries against brute force; the inverted file's recall and its table."""
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import vectors as V

SCHEMA = "vec_id bigint, embedding array<float>, label string, doc int"


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(1)
    middles = r.standard_normal((12, 16))
    out = [(i, (middles[i % 12] + 0.5 * r.standard_normal(16)).astype(np.float32).tolist(), f"l{i % 4}", i // 7) for i in range(900)]
    out += [(i, out[i % 5][1], "l0", 999) for i in range(900, 1100)]  # copies
    out += [(2000, None, "l1", 1), (2001, [0.0] * 16, "l1", 1), (2002, [None] + [1.0] * 15, "l1", 1), (2003, [math.nan] * 16, "l1", 1), (2004, [1.0, 2.0], "l1", 1),
            (2005, [2.0, 1.0], None, 1), (2006, [math.inf] + [1.0] * 15, "l1", 1), (2007, [], "l1", 1), (2008, [1.0] * 16, None, None)]
    return out


def brute(rows, queries, k, allowed=lambda q, r: True, most=math.inf):
    good = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    fit, want = [r for r in rows if good(r[1])], {}
    for q in queries:
        if good(q[1]):
            a = np.array(q[1], np.float64)
            found = sorted((float(round(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), 9)) + 0.0, r[0]) for r in fit if len(r[1]) == len(q[1]) and allowed(q, r) for b in [np.array(r[1], np.float64)])
            want[q[0]] = [(i, d) for d, i in found if d <= most][:k]
    return {q: v for q, v in want.items() if v}


def table(hits):
    out = {}
    for r in hits.withColumn("distance", F.round("distance", 9)).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"] + 0.0))
    return out


def close(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], atol=2e-9)


@pytest.mark.parametrize("queries,k,most", [(1 << 14, 7, None), (100, 3, 0.4), (100, 2000, None)])
def test_all_against_all(spark, rows, monkeypatch, queries, k, most):
    monkeypatch.setattr(V, "QUERIES", queries)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    close(table(V.nearest_many(df, asked, k, most)), brute(rows, rows, k, most=math.inf if most is None else most))


def test_filters_of_each_query(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.when(F.col("vec_id") % 2 == 0, F.col("label")).alias("label"), "doc")
    got = table(V.nearest_many(df, asked, 4, same=["label"], other=["doc"]))
    want = brute(rows, [(i, v, g if i % 2 == 0 else None, d) for i, v, g, d in rows], 4, lambda q, r: (q[2] is None or q[2] == r[2]) and (q[3] is None or (r[3] is not None and q[3] != r[3])))
    close(got, want)


def test_by_source(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    sources = spark.createDataFrame([(3,), (3,), (901,), (2000,), (5555,)], "vec_id bigint")
    asked = [r for r in rows if r[0] in (3, 901, 2000)]
    close(table(V.nearest_by_source(df, sources, 5)), brute(rows, asked, 5, lambda q, r: q[0] != r[0]))
    close(table(V.nearest_by_source(df, sources, 5, "doc")), brute(rows, asked, 5, lambda q, r: q[0] != r[0] and q[3] != r[3]))
    close(table(V.nearest_by_source(df, sources, 5, "doc", within=True)), brute(rows, asked, 5, lambda q, r: q[0] != r[0] and q[3] == r[3]))


def test_empty_sides(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert V.nearest_many(df.limit(0), asked, 3).collect() == [] and V.nearest_many(df, asked.limit(0), 3).collect() == []


def test_more_queries_than_a_broadcast_would_bear(spark):
    n = 5000
    r = np.random.default_rng(5)
    x = r.standard_normal((n, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id int, embedding array<double>")
    got = table(V.nearest_many(df, df.withColumnsRenamed({"vec_id": "query_id", "embedding": "query"}), 3))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert [[i for i, _ in got[q]] for q in range(n)] == want.tolist()


def test_inverted_file(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "ROWS", 40)  # lists of copies in many parts
    fit = [r for r in rows if r[1] is not None and len(r[1]) == 16]
    df = spark.createDataFrame(fit, SCHEMA)
    path = f"{tmp_path}/lists"
    V.InvertedFile.build(df, path, lists=20)
    index = V.InvertedFile.open(spark, path)
    asked = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    close(table(index.search(asked, 6, probes=20)), brute(fit, fit, 6))
    exact, some = brute(fit, fit, 10), table(index.search(asked, 10, probes=8))
    assert np.mean([len({i for i, _ in exact[q]} & {i for i, _ in some.get(q, [])}) / len(exact[q]) for q in exact]) >= 0.9
    plan = index.search(asked.where("query_id = 3"), 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan.replace("isnotnull(list", "list")
    assert sorted(os.listdir(path))[-1].startswith("list=")
    with pytest.raises(ValueError):
        V.InvertedFile.build(df, f"{path}-2", lists=0)
    with pytest.raises(ValueError):
        V.InvertedFile.build(df.limit(0), f"{path}-3")


def test_recall_at_half_of_a_hundred_lists(spark, data, tmp_path):
    df = spark.read.parquet(f"{os.path.dirname(data)}/sf0.1/embeddings.parquet")
    index = V.InvertedFile.build(df, f"{tmp_path}/lists", lists=100)
    asked = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    exact, some = table(V.nearest_many(df, asked, 10)), table(index.search(asked, 10, probes=50))
    assert np.mean([len({i for i, _ in exact[q]} & {i for i, _ in some[q]}) / 10 for q in exact]) >= 0.9
