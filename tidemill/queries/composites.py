"""Composite analyses."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions import numbers as N
from tidemill.functions import text as X
from tidemill.operators import aggregates, matching, packing, relational
from tidemill.plans.chunking import chunked
from tidemill.plans.retrieval import answer_context, planned
from tidemill.queries import Tables, query
from tidemill.queries.matching import matched_rows, matched_sql


@query("c1_hybrid_retrieval")
def _(t: Tables) -> DataFrame:
    plan = planned("compare the limit and explain why", t.spark, k=20, most=2.0)
    asked = t.embeddings.where("vec_id IN (0, 7)").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    sections = F.array(*map(F.lit, ("coverages", "declarations", "limits_deductibles", "exclusions")))
    vectors = t.embeddings.withColumn("section", F.get(sections, F.pmod(F.coalesce("label", F.lit(0)), F.lit(4)).cast("int")))
    edges = t.embeddings.select(F.col("vec_id").alias("edge_id"), F.col("vec_id").alias("src"), (F.col("vec_id") * 7 % 100).alias("dst"), F.lit("LIKE").alias("kind"))
    texts = t.documents.select(F.col("doc_id").alias("node"), X.token_estimate(F.col("text")).alias("tokens"), (X.token_estimate(F.col("text")) / 10).alias("summary_tokens"))
    return answer_context(plan, vectors, asked, texts, edges)


@query("c3_table_normalisation", """SELECT p_partkey, p_retailprice::DECIMAL(18,2) AS price, coalesce(p_size, 0)::BIGINT AS size, p_retailprice < 0 AS negative FROM part""")
def _(t: Tables) -> DataFrame:
    from tidemill.sources.text_tables import markdown_tables

    text = F.concat(F.lit("| Total Value | Size |\n|---|---|\n| $"), F.col("p_retailprice").cast("decimal(18,2)").cast("string"), F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |\n"))
    rows = markdown_tables(t.part.select("p_partkey", text.alias("t")), "p_partkey", "t")
    price = N.parsed_decimal(F.element_at("cells", "Total Value"))
    return rows.select("p_partkey", price.alias("price"), N.parsed_int(F.element_at("cells", "Size")).alias("size"), (price < 0).alias("negative"))


@query("c4_chunks")
def _(t: Tables) -> DataFrame:
    return chunked(t.documents).select("doc_id", "chunk", "tokens")


@query("c4_super_chunks")
def _(t: Tables) -> DataFrame:
    parts = chunked(t.documents)
    return packing.packed(parts, "doc_id", ["chunk"], F.col("tokens"), 3000, 5).groupBy("doc_id", "bin").agg(F.count("*").alias("chunks"), F.sum("size").alias("tokens"))


@query("c5_effective_states", """WITH g AS (SELECT l_partkey, bool_or(l_returnflag = 'R') AS removed, bool_or(l_returnflag = 'A') AS added, max(l_quantity)::DOUBLE AS amount FROM lineitem GROUP BY 1)
SELECT l_partkey, CASE WHEN removed THEN 'R' WHEN added THEN 'A' ELSE 'N' END AS state, amount FROM g""")
def _(t: Tables) -> DataFrame:
    states = aggregates.lattice_state(t.lineitem, "l_partkey", "l_returnflag", ["N", "A", "R"]).withColumnRenamed("l_returnflag", "state")
    return states.join(t.lineitem.groupBy("l_partkey").agg(F.max("l_quantity").cast("double").alias("amount")), "l_partkey")


@query("c6_entity_resolution", """WITH m AS (SELECT substr(sha256(lower(p_type || ':' || p_name)), 1, 32) AS k, p_partkey, p_size, p_brand, row_number() OVER (PARTITION BY p_type, p_name ORDER BY p_size DESC, p_partkey) AS r FROM part)
SELECT k, max(p_partkey) FILTER (WHERE r = 1) AS p_partkey, max(p_size) AS p_size, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS sources FROM m GROUP BY k""")
def _(t: Tables) -> DataFrame:
    mentions = t.part.select(X.canonical_key(F.col("p_type"), F.col("p_name")).alias("k"), "p_partkey", "p_size", "p_brand")
    return aggregates.best_of_group(mentions, "k", "p_size", "p_partkey", "p_brand").withColumn("sources", F.array_join("sources", ","))


@query("c7_policy_comparison", """WITH a AS (SELECT o_orderkey, floor(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_orderkey, floor(o_totalprice) * CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 1 END AS v FROM orders WHERE o_orderkey % 4 <> 2)
SELECT CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN b.v > a.v THEN 'increase' ELSE 'decrease' END AS change, count(*) AS n FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.v IS DISTINCT FROM b.v GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    doc = lambda v: F.to_json(F.struct(F.struct(v.cast("bigint").alias("price")).alias("terms"))).alias("doc")
    old = t.orders.where("o_orderkey % 2 = 0").select("o_orderkey", doc(F.floor("o_totalprice")))
    new = t.orders.where("o_orderkey % 4 <> 2").select("o_orderkey", doc(F.floor("o_totalprice") * F.when(F.col("o_orderkey") % 6 == 0, 2).otherwise(1)))
    return matching.json_diff(old, new, "o_orderkey", "doc").groupBy("change").agg(F.count("*").alias("n"))


@query("c8_entity_comparison", f"""WITH a AS (SELECT p_partkey AS k, lower(trim(p_name)) AS n, NULL::VARCHAR AS c FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT p_partkey AS k, lower(trim(p_name)) AS n, NULL::VARCHAR AS c FROM part WHERE p_partkey % 5 <> 0),
{matched_sql('a', 'b')}, r AS ({matched_rows()}) SELECT how, count(*) AS n FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    old = t.part.where("p_partkey % 3 <> 0").select("p_partkey", "p_name")
    new = t.part.where("p_partkey % 5 <> 0").select("p_partkey", "p_name")
    return matching.name_matched(old, new, "p_partkey", "p_name").groupBy("how").agg(F.count("*").alias("n"))


@query("c9_quote_comparison", """WITH a AS (SELECT p_brand AS k, max(p_retailprice) AS v FROM part WHERE p_size <= 30 GROUP BY 1), b AS (SELECT p_brand AS k, max(p_retailprice) AS v FROM part WHERE p_size > 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS brand, a.v AS one, b.v AS two, CASE WHEN b.v IS NULL OR a.v < b.v THEN 'one' WHEN a.v IS NULL OR b.v < a.v THEN 'two' ELSE 'tie' END AS better FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    side = lambda c, n: t.part.where(c).groupBy(F.col("p_brand").alias("brand")).agg(F.max("p_retailprice").alias(n))
    both = side("p_size <= 30", "one").join(side("p_size > 3", "two"), "brand", "full_outer")
    return both.withColumn("better", N.advantage(F.col("one"), F.col("two"), False))


@query("c10_proposal_comparison", """WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1, 2)
SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, round(a.v, 2) AS expiring, round(b.v, 2) AS renewal, CASE WHEN b.v < a.v THEN 'POSITIVE_CHANGE' WHEN b.v > a.v THEN 'NEGATIVE_CHANGE' ELSE 'NEUTRAL' END AS flag
FROM (SELECT * FROM y WHERE y = 1996) a FULL JOIN (SELECT * FROM y WHERE y = 1997) b ON a.o_custkey = b.o_custkey""")
def _(t: Tables) -> DataFrame:
    wide = t.orders.withColumn("y", F.year("o_orderdate")).groupBy("o_custkey").pivot("y", [1996, 1997]).agg(F.sum("o_totalprice")).where("`1996` IS NOT NULL OR `1997` IS NOT NULL")
    return wide.select("o_custkey", F.round("1996", 2).alias("expiring"), F.round("1997", 2).alias("renewal"), N.delta_flag(F.lit("premium"), F.col("1996"), F.col("1997")).alias("flag"))


@query("c12_dashboard", """WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events)
SELECT c.c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c.c_custkey) AS orders, (SELECT count(*) FROM e WHERE e.user_id = c.c_custkey AND r <= 5) AS recent FROM customer c""")
def _(t: Tables) -> DataFrame:
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"))
    recent = relational.top_per_group(t.events.select(F.col("user_id").alias("c_custkey"), "ts", "event_id"), ["c_custkey"], [F.desc("ts"), F.desc("event_id")], 5)
    recent = recent.groupBy("c_custkey").agg(F.count("*").alias("recent"))
    return t.customer.select("c_custkey").join(orders, "c_custkey", "left").join(recent, "c_custkey", "left").na.fill(0)
