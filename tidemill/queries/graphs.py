"""The graph of customers, orders and parts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import graph as G
from tidemill.queries import Tables, query


def edges(t: Tables) -> DataFrame:
    placed = t.orders.select("o_orderkey", F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("dst"))
    placed = placed.select(F.col("o_orderkey").alias("edge_id"), "src", "dst", F.lit("PLACED").alias("kind"))
    holds = t.lineitem.select("l_orderkey", "l_partkey").distinct().select(
        (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey") + 1_000_000_000_000).alias("edge_id"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"), F.lit("HOLDS").alias("kind"),
    )
    return placed.unionByName(holds)


_WALK = """WITH RECURSIVE e AS (SELECT o_orderkey AS id, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS kind FROM orders
UNION ALL SELECT DISTINCT l_orderkey * 1000000 + l_partkey + 1000000000000, 'o' || l_orderkey, 'p' || l_partkey, 'HOLDS' FROM lineitem),
b AS (SELECT id, src AS a, dst AS z, kind FROM e UNION ALL SELECT id, dst, src, kind FROM e),
w AS (SELECT 'c7' AS start, 'c7' AS node, 0 AS distance, []::BIGINT[] AS used, '' AS chain UNION ALL
SELECT w.start, b.z, w.distance + 1, list_append(w.used, b.id), CASE WHEN w.chain = '' THEN b.kind ELSE w.chain || '>' || b.kind END FROM w JOIN b ON b.a = w.node WHERE w.distance < {depth} AND NOT list_contains(w.used, b.id)),
f AS (SELECT DISTINCT start, node, distance, chain FROM w WHERE distance > 0 AND node <> start)"""


@query("graph1_traversal", _WALK.format(depth=3) + " SELECT start, node, distance, chain FROM f")
def _(t: Tables) -> DataFrame:
    return G.traversed(edges(t), t.spark.createDataFrame([("c7",)], "node string"), 3)


@query("graph1_nearest", _WALK.format(depth=2) + " SELECT start, node, distance, chain FROM f ORDER BY distance, node, chain, start LIMIT 25")
def _(t: Tables) -> DataFrame:
    return G.nearest_nodes(G.traversed(edges(t), t.spark.createDataFrame([("c7",)], "node string"), 2), 25)


@query("graph2_seeds", """WITH n AS (SELECT vec_id % 100 AS node, max(label::VARCHAR) AS label FROM embeddings GROUP BY 1), d AS (SELECT DISTINCT vec_id % 100 AS node FROM embeddings WHERE vec_id IN (3, 104))
SELECT node, 'vector' AS via FROM d UNION ALL SELECT node, 'label' FROM n WHERE label = '9' AND node NOT IN (SELECT node FROM d)""")
def _(t: Tables) -> DataFrame:
    nodes = t.embeddings.select("vec_id", "label").groupBy((F.col("vec_id") % 100).alias("node")).agg(F.max(F.col("label").cast("string")).alias("label"), F.collect_set("vec_id").alias("vector_ids"))
    wanted = t.spark.createDataFrame([(3, "a"), (104, "a"), (-1, "b")], "vec_id bigint, section string")
    return G.seeds(nodes, wanted, t.spark.createDataFrame([("b", "9")], "section string, label string"))


@query("graph3_relevance", _WALK.format(depth=2) + " SELECT node, distance, chain, round(least(1.0::DOUBLE, pow(0.9::DOUBLE, distance) + CASE WHEN starts_with(node, 'p') THEN 0.05::DOUBLE ELSE 0 END), 9) AS score FROM f")
def _(t: Tables) -> DataFrame:
    found = G.traversed(edges(t), t.spark.createDataFrame([("c7",)], "node string"), 2)
    boosts = found.where(F.startswith("node", F.lit("p"))).select("node", F.lit(0.05).alias("boost")).distinct()
    return G.relevance(found, boosts).select("node", "distance", "chain", F.round("score", 9).alias("score"))


@query("graph4_build", """SELECT c_custkey AS node, arg_min(o_orderstatus, o_orderkey) AS section, count(DISTINCT o_orderkey % 5) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    mentions = t.orders.select(F.col("o_custkey").alias("node"), F.col("o_orderstatus").alias("section"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 5).alias("vec_id"))
    out = G.with_provenance(t.customer.select(F.col("c_custkey").alias("node")), mentions)
    return out.select("node", "section", F.coalesce(F.size("vector_ids"), F.lit(0)).cast("bigint").alias("n"))


@query("graph5_properties", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 2 ELSE 1 END AS n FROM supplier")
def _(t: Tables) -> DataFrame:
    props = F.create_map(F.lit("name"), F.col("s_name"), F.lit("balance"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("string")))
    return t.supplier.withColumn("p", props).select("s_suppkey", F.size(G.non_null("p")).alias("n"))


@query("graph5_mapped_properties", """WITH p AS (SELECT *, p_partkey % 5 AS k FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'coverage_type=' || p_type || ';deductible_amount=' || p_size || ';entity_type=Coverage;id=' || p_partkey || ';name=' || p_name
  WHEN 1 THEN 'address=' || p_brand || ';entity_type=Organization;id=' || p_partkey WHEN 2 THEN 'claim_number=' || p_partkey || ';entity_type=Claim;id=' || p_partkey || ';name=' || p_partkey || ';report_date=' || p_size
  WHEN 3 THEN 'currency=USD;entity_type=Monetary;id=' || p_partkey || ';monetary_type=' || p_type || ';name=' || p_partkey ELSE 'entity_type=Widget;id=' || p_partkey || ';name=' || p_name END AS props FROM p""")
def _(t: Tables) -> DataFrame:
    text = lambda c: F.col(c).cast("string")
    kinds = [
        ("Coverage", {"coverage_name": text("p_name"), "name": F.lit(""), "coverage_type": text("p_type"), "deductible": text("p_size"), "other": F.lit("x")}),
        ("Organization", {"title": text("p_name"), "address": text("p_brand")}), ("Claim", {"claim_number": text("p_partkey"), "reported_date": text("p_size")}),
        ("Monetary", {"currency": F.lit("USD"), "type": text("p_type")}), ("Widget", {"title": text("p_name"), "size": text("p_size")}),
    ]
    k = F.col("p_partkey") % 5
    kind = F.coalesce(*(F.when(k == i, F.lit(n)) for i, (n, _) in enumerate(kinds)))
    data = F.coalesce(*(F.when(k == i, F.create_map(*(x for n, c in d.items() for x in (F.lit(n), c)))) for i, (_, d) in enumerate(kinds)))
    props = F.map_entries(G.node_properties(kind, F.col("p_partkey"), data))
    return t.part.select("p_partkey", F.array_join(F.array_sort(F.transform(props, lambda x: F.concat(x["key"], F.lit("="), x["value"]))), ";").alias("props"))


@query("s20_node_merge", "SELECT 'w' AS scope, n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN 'New' ELSE 'Nation' END AS label, CASE WHEN n_nationkey < 10 THEN 'x' ELSE n_name END AS name, n_regionkey::VARCHAR AS region FROM nation")
def _(t: Tables) -> DataFrame:
    from tidemill.sources.sinks import merge_nodes

    base = t.nation.select(F.lit("w").alias("scope"), F.col("n_nationkey").alias("id"), F.lit("Nation").alias("label"), F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string")).alias("props"))
    new = t.nation.where("n_nationkey < 10").select(F.lit("w").alias("scope"), F.col("n_nationkey").alias("id"), F.lit("New").alias("label"), F.create_map(F.lit("name"), F.lit("x")).alias("props"))
    out = merge_nodes(base, new)
    return out.select("scope", "id", "label", F.element_at("props", "name").alias("name"), F.element_at("props", "region").alias("region"))


@query("s21_edge_merge", "SELECT 'w' AS scope, n_nationkey AS src, n_regionkey AS dst, 'IN' AS type FROM nation WHERE n_nationkey < 5 OR n_regionkey < n_nationkey")
def _(t: Tables) -> DataFrame:
    from tidemill.sources.sinks import merge_edges

    row = t.nation.select(F.lit("w").alias("scope"), F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst"), F.lit("IN").alias("type"), F.create_map(F.lit("k"), F.lit("v")).alias("props"))
    nodes = t.nation.select(F.lit("w").alias("scope"), F.col("n_nationkey").alias("id"))
    return merge_edges(row.where("src < 5"), row.where("dst < src"), nodes).drop("props")
