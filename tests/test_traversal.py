"""Bounded traversal against all trails, with loops, parallel edges and hubs."""
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import graph as G

EDGES = "edge_id bigint, src bigint, dst bigint, kind string"


def trails(edges, starts, depth):
    out = set()
    for s in set(starts) - {None}:
        front = [(s, (), ())]
        for hop in range(1, depth + 1):
            after = []
            for at, used, chain in front:
                for i, a, b, k in edges:
                    if i in used or at not in (a, b) or a is None or b is None:
                        continue
                    after.append((b if a == at else a, (*used, i), (*chain, k)))
            front = after
            out |= {(s, at, hop, ">".join(chain)) for at, _, chain in front if at != s}
    return out


@pytest.mark.parametrize("seed", range(8))
def test_trails_of_random_graphs(spark, seed):
    r = random.Random(seed)
    n = r.choice([3, 5, 8])
    edges = [(i, r.randint(1, n), r.randint(1, n), r.choice("AB" if seed % 3 else "A")) for i in range(r.choice([6, 11, 16]))] + [(90, None, 1, "A"), (91, 2, None, "A")]
    df = spark.createDataFrame(edges, EDGES)
    starts = spark.createDataFrame([(1,), (2,), (2,), (99,), (None,)], "node bigint")
    for depth in (1, 2, 3):
        got = [tuple(x) for x in G.traversed(df, starts, depth).collect()]
        assert len(got) == len(set(got)) and set(got) == trails(edges, [1, 2, 99], depth)
    only = {tuple(x) for x in G.traversed(df, starts, 3, ["A"]).collect()}
    assert only == trails([e for e in edges if e[3] == "A"], [1, 2, 99], 3)


def test_a_hub_keeps_the_frontier_distinct(spark):
    """A thousand starts beside each other reach a hub of 10^5 edges; each knows every neighbour once, however many trails lead there."""
    n = 100_000
    hub = spark.range(1, n + 1).select(F.col("id").alias("edge_id"), F.lit(0).cast("bigint").alias("src"), F.col("id").alias("dst"), F.lit("A").alias("kind"))
    again = hub.withColumn("edge_id", F.col("edge_id") + n)
    starts = spark.createDataFrame([(7,), (8,)], "node bigint")
    found = G.traversed(hub.unionByName(again), starts, 3).groupBy("distance").count().collect()
    # Hop 3 comes back to the hub by the second edge of any neighbour, or of the start.
    assert {x["distance"]: x["count"] for x in found} == {1: 2, 2: 2 * (n - 1), 3: 2}


def test_depth_is_bounded(spark):
    empty = spark.createDataFrame([], EDGES)
    with pytest.raises(ValueError):
        G.traversed(empty, empty.select(F.col("src").alias("node")), 4)
    assert G.traversed(empty, empty.select(F.col("src").alias("node")), 3).collect() == []


def test_too_many_boosts_raise(spark):
    found = spark.createDataFrame([(1, "Coverage", "a", 1, {"name": "x"})], "node bigint, kind string, section string, distance int, props map<string,string>")
    boosts = spark.range(1001).select(F.col("id").cast("string").alias("section"), F.lit(0.1).alias("boost"))
    with pytest.raises(Exception, match="more than 1000 boosts"):
        G.scored_nodes(found, boosts).collect()
    assert len(G.scored_nodes(found, boosts.limit(1000)).collect()) == 1


def test_properties_of_each_kind_of_node(spark):
    rows = [
        ("Coverage", "k1", {"name": "", "coverage_name": "Fire", "deductible_amount": "5", "unknown": "x"}), ("Coverage", "k2", {}), ("Driver", "k3", {"title": "T", "accidents": "2"}),
        ("Exclusion", "k4", {"title": "War", "type": "absolute", "applies_to": None}), ("Endorsement", "k5", {"form_number": "CG", "endorsement_number": "9"}), ("Other", "k6", {"term": "A"}),
    ]
    df = spark.createDataFrame(rows, "kind string, key string, attributes map<string,string>")
    got = {r["key"]: r["p"] for r in df.select("key", G.node_properties(F.col("kind"), F.col("key"), F.col("attributes"), F.lit("2024")).alias("p")).collect()}
    base = lambda kind, key, **more: {"id": key, "entity_type": kind, "created_at": "2024"} | more
    assert got == {
        "k1": base("Coverage", "k1", name="Fire", deductible_amount="5"), "k2": base("Coverage", "k2", name="k2"), "k3": base("Driver", "k3", accidents="2"),
        "k4": base("Exclusion", "k4", name="War", exclusion_type="absolute"), "k5": base("Endorsement", "k5", name="9", endorsement_number="CG"), "k6": base("Other", "k6", name="A"),
    }
