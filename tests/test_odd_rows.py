"""Queries against their SQL, or plain Python, on rows that the test tables hardly have."""
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__

SQL = __spark_entry__.oracle_sql()


def same_as_sql(spark, folder, name, table, rows, schema):
    """Whether the query gives its SQL's rows on a table of these rows; returns them."""
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in __spark_entry__.queries()[name](spark, str(folder)).select(*columns).collect()), key=repr)
    assert got == want
    return got


MESSAGES = "conv_id bigint, turn bigint, role string, text string"


def test_borders_of_words_in_questions_are_those_of_sql(spark, tmp_path):
    texts = [
        "Stück für Stück", "fünf 12 Main Stäfa, Über Berlin, DEé", "policy ſ12K77 and éABC-12345 or ABC-12345é", "am 01/02/2024é, März 3, 2024, ſep 4, 2024",
        "é12 million, 3\u000bmillion dollarſ, 4,000 dollarſ", "Big\u000bPolicy Élan Vital Name",
    ]
    rows = [(5 + 10 * i, 10 * j, "user", t) for i, t in enumerate(texts) for j in range(2)]
    got = same_as_sql(spark, tmp_path, "f31_question_entities", "conversations", rows, MESSAGES)
    assert any("5 million St" in r for r in got)


def test_patterns_of_intents_are_matched_once_with_borders_of_sql(spark, tmp_path):
    texts = ["listä of what\u000bis", "ésource here", "show this\rand changes", "show this\nand changes", "where did it\u2028all come from", "éaudit trail and audit trailé", " "]
    same_as_sql(spark, tmp_path, "f29_intents", "conversations", [(5 + 6 * i, 6 * j, "user", t) for i, t in enumerate(texts) for j in range(2)], MESSAGES)
    plan = __spark_entry__.queries()["f29_intents"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("provenance") == 1


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_words_are_hashed_once_whatever_the_size(spark):
    import time

    from tidemill.functions.text import hashed_words

    texts = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(100_000)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text")).cache()
    assert texts.count() == 1
    took = {}
    for size in (2, 2, 128):
        began = time.perf_counter()
        counts = texts.select(hashed_words(F.col("text"), size).alias("v")).first()["v"]
        took[size] = time.perf_counter() - began
        assert len(counts) == size and sum(counts) == 100_000
    assert took[128] < 12 * took[2]


def test_words_of_encoded_rows_are_those_of_sql(spark, tmp_path):
    texts = ["one\u000btwo three one", "", " ", "\n", "x y\tz\fa", "Straße É é", "w " * 3000]
    same_as_sql(spark, tmp_path, "s26_encoded_rows", "documents", [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS)


def test_text_search_is_that_of_sql(spark, tmp_path):
    texts = ["a b c", "one\u000btwo three one", "\n", "one two three", "ONE\u000bTWO", "b a c", "x", "y", "a b c d"]
    assert same_as_sql(spark, tmp_path, "e20_text_search", "documents", [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS)


def test_spans_far_longer_than_a_bin(spark):
    from tidemill.operators.relational import in_intervals

    spans = [(1, 0, 3 * 10**9, "a"), (1, 5, 5, "b"), (1, 100, 90, "none"), (1, -7, 12, "c"), (2, 2, None, "none"), (2, 10**6, 10**6 + 17, "d"), (2, 0, 1 << 40, "e")]
    points = [(k, at) for k in (1, 2, 3) for at in (-8, -7, 0, 5, 12, 13, 95, 10**6, 10**6 + 17, 10**6 + 18, 3 * 10**9, 3 * 10**9 + 1, 1 << 40)]
    got = in_intervals(spark.createDataFrame(points, "k int, at bigint"), spark.createDataFrame(spans, "k int, s bigint, e bigint, name string"), "k", "at", "s", "e", 10)
    want = sorted((k, at, n) for k, at in points for j, s, e, n in spans if j == k and e is not None and s <= at <= e)
    assert sorted((r["k"], r["at"], r["name"]) for r in got.collect()) == want


def test_near_sets_are_compared_only_when_near(spark):
    import random

    from tidemill.operators.similarity import jaccard_pairs

    chance = random.Random(5)
    base = [[f"w{chance.randrange(40 + 60 * (i % 3))}" for _ in range(5 + 9 * (i % 5))] for i in range(60)]
    rows = [(i, w) for i, w in enumerate(base)] + [(100 + i, w[1:] + [f"x{i % 7}"]) for i, w in enumerate(base)] + [(300, []), (301, ["a", "a"]), (302, ["a"]), (303, [f"n{i}" for i in range(35)]), (304, [f"n{i}" for i in range(28)])]
    df = spark.createDataFrame(rows, "k bigint, t array<string>")
    first = {}
    for k, t in sorted(rows):
        if t:
            first.setdefault(frozenset(t), k)
    sets = sorted((k, t) for t, k in first.items())
    want = {(a, b): len(x & y) / len(x | y) for n, (a, x) in enumerate(sets) for b, y in sets[n + 1:] if len(x & y) / len(x | y) >= 0.8}
    out = jaccard_pairs(df, "k", "t", 0.8)
    assert {(r["a"], r["b"]): r["jaccard"] for r in out.collect()} == want and (303, 304) in want
    # Of the pairs that share rare words, hardly any but the near ones have their sets joined.
    far = spark.createDataFrame([(i, ["rare"] + [f"w{i}-{j}" for j in range(60)]) for i in range(200)], "k bigint, t array<string>")
    plan = jaccard_pairs(far, "k", "t", 0.8)
    assert plan.count() == 0
    assert "bit_count" in plan._jdf.queryExecution().optimizedPlan().toString()


def test_synthesis_pairs_suppliers_with_brands_not_parts(spark, data):
    plan = __spark_entry__.queries()["c5_coverage_synthesis"](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    # Parts are rolled up to brands below the join with suppliers.
    lines = plan.splitlines()
    parts = [i for i, line in enumerate(lines) if "Relation [p_partkey" in line]
    joins = [max(j for j in range(i) if "Join Inner, (k#" in lines[j]) for i in parts]
    assert parts and all(any("Aggregate" in line for line in lines[j:i]) for j, i in zip(joins, parts, strict=True))


def test_a_search_of_all_lists_copies_no_query_to_each(spark, tmp_path):
    import numpy as np

    from tidemill.operators.vectors import InvertedFile

    some = np.random.default_rng(3).normal(size=(120, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(some)] + [(500, [0.0] * 6), (501, None)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([*rows[:40], (900, [1.0, 2.0]), (901, None)], "query_id bigint, query array<double>")
    index = InvertedFile.build(corpus, f"{tmp_path}/lists", lists=20)
    found = index.search(asked, 3, probes=20)
    unit = some / np.linalg.norm(some, axis=1, keepdims=True)
    want = {(q, int(v), r + 1) for q in range(40) for r, v in enumerate(np.argsort(1 - unit @ unit[q], kind="stable")[:3])}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found.collect()} == want
    assert "explode(lists" not in found._jdf.queryExecution().optimizedPlan().toString()
