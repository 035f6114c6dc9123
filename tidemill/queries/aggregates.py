"""Aggregations."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import aggregates as A
from tidemill.queries import Tables, query


def _tokens() -> F.Column:
    return F.floor(F.col("n_chars") / 4).cast("bigint")


@query("agg1_filtered_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def _(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query("agg2_group_count", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag)")
def _(t: Tables) -> DataFrame:
    return A.with_total(t.lineitem, "l_returnflag")


@query("agg3_section_summary", """WITH a AS (SELECT CASE WHEN lang = 'es' THEN 'unknown' ELSE lang END AS section, (n_chars // 4)::BIGINT AS tok, doc_id % 7 AS page FROM documents)
SELECT section, count(*) AS chunks, sum(tok)::BIGINT AS tokens, string_agg(DISTINCT page, ',' ORDER BY page) AS pages FROM a GROUP BY section
UNION ALL SELECT '*', count(*), sum(tok)::BIGINT, string_agg(DISTINCT page, ',' ORDER BY page) FROM a""")
def _(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("tok", _tokens())
    out = A.section_summary(docs, F.when(F.col("lang") != "es", F.col("lang")), "tok", F.col("doc_id") % 7)
    return out.withColumn("pages", F.array_join(F.transform("pages", lambda x: x.cast("string")), ","))


@query("agg4_chunk_statistics", """SELECT count(*) AS total, sum(n_chars // 4)::BIGINT AS tokens, avg(n_chars // 4) AS mean, min(n_chars // 4)::BIGINT AS low, max(n_chars // 4)::BIGINT AS high,
count(DISTINCT lang) AS sections, count(DISTINCT source) AS sources, sum(CASE WHEN n_chars > 4000 THEN 1 ELSE 0 END)::BIGINT AS large, count(*) / count(DISTINCT source) AS per_source FROM documents""")
def _(t: Tables) -> DataFrame:
    tok = _tokens()
    return t.documents.agg(
        F.count("*").alias("total"), F.sum(tok).alias("tokens"), F.avg(tok).alias("mean"), F.min(tok).alias("low"), F.max(tok).alias("high"),
        F.countDistinct("lang").alias("sections"), F.countDistinct("source").alias("sources"), F.count_if(F.col("n_chars") > 4000).alias("large"),
        (F.count("*") / F.countDistinct("source")).alias("per_source"),
    )


@query("agg5_histogram", "SELECT string_agg(lang || '=' || n, ',' ORDER BY lang) AS histogram FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1)")
def _(t: Tables) -> DataFrame:
    out = A.histogram(t.documents, "lang")
    return out.select(F.array_join(F.transform(F.map_entries("histogram"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("histogram"))


@query("agg6_dominant_type", """SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r
FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY 1, 2) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    return A.dominant(t.events, "user_id", "event_type", ["error", "view"])


@query("agg7_required_set_rule", """WITH g AS (SELECT user_id, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'signup') AS s, bool_or(event_type = 'error') AS e, count(*) AS n,
count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS ps, count(*) FILTER (WHERE event_type = 'error') AS ee FROM events GROUP BY 1)
SELECT user_id, CASE WHEN p AND s THEN 'buyer' WHEN e THEN 'trouble' END AS label,
CASE WHEN p AND s THEN 0.95::DOUBLE * (0.5 + 0.5 * ps / n) WHEN e THEN 0.85::DOUBLE * (0.5 + 0.5 * ee / n) END AS confidence FROM g""")
def _(t: Tables) -> DataFrame:
    return A.first_rule(t.events, "user_id", "event_type", [(["purchase", "signup"], "buyer", 0.95), (["error"], "trouble", 0.85)])


@query("agg8_stage_rollup", """WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT user_id, done, failed, CASE WHEN done >= 14 THEN 'completed' WHEN failed > 0 AND done + failed >= 14 THEN 'partial' ELSE 'running' END AS status FROM g""")
def _(t: Tables) -> DataFrame:
    return A.stage_rollup(t.events, "user_id", "event_type", 14, "purchase", "error")


@query("agg9_progress", """SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS done,
floor(100 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*))::BIGINT AS progress, date_diff('day', min(o_orderdate), max(o_orderdate))::INT AS days FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") == "F")
    return t.orders.groupBy("o_custkey").agg(
        F.count("*").alias("total"), done.alias("done"), F.floor(100 * done / F.count("*")).cast("bigint").alias("progress"),
        F.datediff(F.max("o_orderdate"), F.min("o_orderdate")).alias("days"),
    )


@query("agg10_latest_of_sources", """SELECT o.o_orderkey, greatest(max(o.o_orderdate), max(l.l_shipdate)) AS ended FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    ships = t.lineitem.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    return t.orders.join(ships, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.greatest("o_orderdate", "shipped").alias("ended"))


@query("agg11_value_validation", """WITH a AS (SELECT l_orderkey, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_extendedprice) > 1 AS dup FROM lineitem),
g AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, count(*) FILTER (WHERE dup) AS duplicates, count(DISTINCT l_partkey) AS parts, count(*) FILTER (WHERE l_extendedprice < 0) AS negatives FROM a GROUP BY 1)
SELECT l_orderkey, total, duplicates, parts, negatives, abs(total - o_totalprice) / o_totalprice <= 0.01 AS agrees FROM g JOIN orders ON o_orderkey = l_orderkey""")
def _(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    dup = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice")) > 1
    g = t.lineitem.withColumn("dup", dup).groupBy("l_orderkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("total"), F.count_if("dup").alias("duplicates"), F.countDistinct("l_partkey").alias("parts"),
        F.count_if(F.col("l_extendedprice") < 0).alias("negatives"),
    )
    agrees = F.abs(F.col("total") - F.col("o_totalprice")) / F.col("o_totalprice") <= 0.01
    return g.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("l_orderkey", "total", "duplicates", "parts", "negatives", agrees.alias("agrees"))


@query("agg12_loss_validation", """SELECT l_suppkey, round(sum(l_extendedprice), 2) AS incurred, round(sum(l_extendedprice * (1 - l_discount)), 2) AS paid, count(*) FILTER (WHERE l_linestatus = 'O') AS open_n,
count(*) FILTER (WHERE l_linestatus = 'F') AS closed_n, count(*) FILTER (WHERE l_discount > l_tax) AS paid_over FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.sum("l_extendedprice"), 2).alias("incurred"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("paid"),
        F.count_if(F.col("l_linestatus") == "O").alias("open_n"), F.count_if(F.col("l_linestatus") == "F").alias("closed_n"),
        F.count_if(F.col("l_discount") > F.col("l_tax")).alias("paid_over"),
    )


@query("agg13_severity_counts", "SELECT count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS high, count(*) FILTER (WHERE o_orderpriority = '5-LOW') AS low FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("high"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))


@query("agg14_match_pivot", """SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) AS total FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)
    return wide.select("l_returnflag", F.col("F").alias("f"), F.col("O").alias("o"), (F.col("F") + F.col("O")).alias("total"))


@query("agg15_mean_or_zero", "SELECT u AS user_id, coalesce((SELECT avg(value) FROM events WHERE user_id = u AND event_type = 'purchase'), 0) AS mean FROM (SELECT DISTINCT user_id AS u FROM events)")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy("user_id").agg(F.coalesce(F.avg(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)).alias("mean"))


@query("agg16_best_of_group", """WITH r AS (SELECT md5(text) AS entity, doc_id, n_chars % 10 AS score, source, row_number() OVER (PARTITION BY md5(text) ORDER BY n_chars % 10 DESC, doc_id) AS r FROM documents)
SELECT entity, min(doc_id) FILTER (WHERE r = 1) AS doc_id, max(score) AS score, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM r GROUP BY entity""")
def _(t: Tables) -> DataFrame:
    rows = t.documents.select(F.md5("text").alias("entity"), "doc_id", (F.col("n_chars") % 10).alias("score"), "source")
    return A.best_of_group(rows, "entity", "score", "doc_id", "source").withColumn("sources", F.array_join("sources", ","))


@query("agg17_edge_merge", """SELECT o_custkey AS src, l_partkey AS dst, upper(l_returnflag) AS kind, string_agg(DISTINCT o_orderkey, ',' ORDER BY o_orderkey) AS evidence, max(l_quantity)::DOUBLE AS score
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    rows = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("src"), F.col("l_partkey").alias("dst"), F.lower("l_returnflag").alias("kind"), "o_orderkey", F.col("l_quantity").cast("double").alias("score")
    )
    out = A.merged_edges(rows, "src", "dst", "kind", "o_orderkey", "score")
    return out.withColumn("evidence", F.array_join(F.transform("evidence", lambda x: x.cast("string")), ","))


@query("agg18_part_rollup", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem)
SELECT l_partkey, max(l_returnflag) FILTER (WHERE r = 1) AS last_flag, string_agg(DISTINCT l_linenumber, ',' ORDER BY l_linenumber) AS pages, least(0.5::DOUBLE + 0.05 * count(*), 0.95) AS confidence FROM r GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    last = F.max_by("l_returnflag", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"))
    pages = F.array_join(F.transform(F.array_sort(F.collect_set("l_linenumber")), lambda x: x.cast("string")), ",")
    return t.lineitem.groupBy("l_partkey").agg(last.alias("last_flag"), pages.alias("pages"), F.least(0.5 + 0.05 * F.count("*"), F.lit(0.95)).alias("confidence"))


@query("agg19_state_lattice", """SELECT user_id, CASE max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END) WHEN 1 THEN 'view' WHEN 2 THEN 'click' WHEN 3 THEN 'purchase' END AS event_type
FROM events WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    rows = t.events.where("event_type IN ('view', 'click', 'purchase')")
    return A.lattice_state(rows, "user_id", "event_type", ["view", "click", "purchase"])


@query("agg20_group_items", "SELECT doc_id // 50 AS parent, lower(lang) AS section, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS docs FROM documents GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    docs = F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",")
    return t.documents.groupBy(F.floor(F.col("doc_id") / 50).alias("parent"), F.lower("lang").alias("section")).agg(F.count("*").alias("n"), docs.alias("docs"))


@query("agg21_ratio", "SELECT source, avg(CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("source").agg(F.avg((F.col("n_chars") > 1000).cast("double")).alias("ratio"))


@query("p8_quality_filter", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN n_chars % 100 < 15 THEN 'low_confidence' WHEN lower(trim(split_part(text, ' ', 1))) IN ('the', 'a', 'of') THEN 'generic'
WHEN regexp_matches(text, '^[0-9]+[.] [A-Z]') THEN 'section_reference' WHEN length(split_part(text, ' ', 1)) < 5 THEN 'short_name' ELSE 'accepted' END AS reason FROM documents) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    word = F.split_part("text", F.lit(" "), F.lit(1))
    reason = F.when(F.col("n_chars") % 100 < 15, "low_confidence").when(F.lower(F.trim(word)).isin("the", "a", "of"), "generic")
    reason = reason.when(F.col("text").rlike("^[0-9]+[.] [A-Z]"), "section_reference").when(F.length(word) < 5, "short_name").otherwise("accepted")
    return t.documents.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("p9_should_process", "SELECT doc_id, (lang <> 'es' AND (doc_id % 10 = 1 OR n_chars % 100 >= 70)) AS process FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", ((F.col("lang") != "es") & ((F.col("doc_id") % 10 == 1) | (F.col("n_chars") % 100 >= 70))).alias("process"))


@query("p10_manifest", """SELECT doc_id // 50 AS batch, count(*) FILTER (WHERE n_chars > 500) AS process, count(*) FILTER (WHERE n_chars <= 500) AS skip,
string_agg(doc_id, ',' ORDER BY doc_id) FILTER (WHERE n_chars <= 500) AS skipped, avg(CASE WHEN n_chars > 500 THEN 1.0::DOUBLE ELSE 0 END) AS ratio FROM documents GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    go = F.col("n_chars") > 500
    skipped = F.array_sort(F.collect_list(F.when(~go, F.col("doc_id"))))
    return t.documents.groupBy(F.floor(F.col("doc_id") / 50).alias("batch")).agg(
        F.count_if(go).alias("process"), F.count_if(~go).alias("skip"),
        F.when(F.size(skipped) > 0, F.array_join(F.transform(skipped, lambda x: x.cast("string")), ",")).alias("skipped"), F.avg(go.cast("double")).alias("ratio"),
    )


@query("e1_weighted_mean", "SELECT l_suppkey, sum(l_discount * l_quantity) / sum(l_quantity) AS confidence FROM lineitem GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(A.weighted_mean(F.col("l_discount"), F.col("l_quantity")).alias("confidence"))


@query("e2_highest_or_unkeyed", """WITH a AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS id, n_chars FROM documents)
SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY coalesce(id, '#' || doc_id) ORDER BY n_chars DESC, doc_id) AS r FROM a) WHERE r = 1""")
def _(t: Tables) -> DataFrame:
    from tidemill.operators.relational import top_per_group

    key = F.coalesce(F.when(F.col("doc_id") % 3 != 0, F.col("source")), F.concat(F.lit("#"), F.col("doc_id").cast("string")))
    return top_per_group(t.documents.select("doc_id", "n_chars", key.alias("id")), ["id"], [F.desc("n_chars"), "doc_id"], 1).select("doc_id")


@query("e8_provision_merge", """WITH s AS (SELECT lower(p_name) AS k, min(p_name) AS name FROM part WHERE p_size <= 30 GROUP BY 1), f AS (SELECT lower(p_name) AS k, min(upper(p_name)) AS name FROM part WHERE p_size > 20 GROUP BY 1)
SELECT coalesce(s.k, f.k) AS k, coalesce(f.name, s.name) AS name, f.k IS NOT NULL AND s.k IS NOT NULL AS modified,
CASE WHEN s.k IS NULL THEN 'found' WHEN f.k IS NULL THEN 'standard' ELSE 'standard,found' END AS sources FROM s FULL JOIN f ON s.k = f.k""")
def _(t: Tables) -> DataFrame:
    k = F.lower("p_name").alias("k")
    standard = t.part.where("p_size <= 30").groupBy(k).agg(F.min("p_name").alias("a"))
    found = t.part.where("p_size > 20").groupBy(k).agg(F.min(F.upper("p_name")).alias("b"))
    return standard.join(found, "k", "full_outer").select(
        "k", F.coalesce("b", "a").alias("name"), (F.col("a").isNotNull() & F.col("b").isNotNull()).alias("modified"),
        F.concat_ws(",", F.when(F.col("a").isNotNull(), "standard"), F.when(F.col("b").isNotNull(), "found")).alias("sources"),
    )


@query("e9_insert_missing", "SELECT n_name AS name, 1.0::DOUBLE AS confidence FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_name, 0.9::DOUBLE FROM nation WHERE n_nationkey >= 15")
def _(t: Tables) -> DataFrame:
    from tidemill.operators.relational import insert_missing

    n = t.nation.select(F.col("n_name").alias("name"), "n_nationkey")
    return insert_missing(n.where("n_nationkey < 15").select("name", F.lit(1.0).alias("confidence")), n.where("n_nationkey >= 10").select("name", F.lit(0.9).alias("confidence")), ["name"])


@query("e10_capped_discoveries", """WITH k AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size < 20), d AS (SELECT lower(p_name) AS name, max(p_size) / 50 AS confidence FROM part WHERE p_size >= 5 GROUP BY 1)
SELECT name, 1.0::DOUBLE AS confidence FROM k UNION ALL SELECT name, least(confidence, 0.85) FROM d WHERE name NOT IN (SELECT name FROM k)""")
def _(t: Tables) -> DataFrame:
    known = t.part.where("p_size < 20").select(F.lower("p_name").alias("name")).distinct()
    found = t.part.where("p_size >= 5").groupBy(F.lower("p_name").alias("name")).agg((F.max("p_size") / 50).alias("confidence"))
    more = found.join(known, "name", "left_anti").withColumn("confidence", F.least("confidence", F.lit(0.85)))
    return known.withColumn("confidence", F.lit(1.0)).unionByName(more)


@query("e12_mean_of_means", """SELECT n.n_nationkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END AS mean FROM nation n
LEFT JOIN (SELECT c_nationkey AS k, avg(c_acctbal) AS a FROM customer GROUP BY 1) x ON x.k = n.n_nationkey LEFT JOIN (SELECT s_nationkey AS k, avg(s_acctbal) AS b FROM supplier GROUP BY 1) y ON y.k = n.n_nationkey""")
def _(t: Tables) -> DataFrame:
    a = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("a"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.avg("s_acctbal").alias("b"))
    mean = F.coalesce((F.col("a") + F.col("b")) / 2, F.col("a"), F.col("b"))
    return t.nation.join(a, "n_nationkey", "left").join(b, "n_nationkey", "left").select("n_nationkey", mean.alias("mean"))


@query("e13_proposal_matrix", """SELECT l_suppkey, max(l_quantity) FILTER (WHERE l_returnflag = 'A')::DOUBLE AS a, max(l_quantity) FILTER (WHERE l_returnflag = 'N')::DOUBLE AS n, max(l_quantity) FILTER (WHERE l_returnflag = 'R')::DOUBLE AS r FROM lineitem GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    wide = t.lineitem.groupBy("l_suppkey").pivot("l_returnflag", ["A", "N", "R"]).agg(F.max("l_quantity").cast("double"))
    return wide.select("l_suppkey", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


@query("e14_findings", """SELECT o_orderpriority, bool_or(o_totalprice > 400000) AS review, count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS findings FROM orders GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.bool_or(F.col("o_totalprice") > 400000).alias("review"), F.count_if(F.col("o_orderstatus").isin("F", "P")).alias("findings"))


@query("e15_quality_totals", """WITH a AS (SELECT l_partkey AS k, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE year(l_shipdate) = 1996 GROUP BY 1), b AS (SELECT l_partkey AS k, sum(l_quantity)::DOUBLE AS q FROM lineitem WHERE year(l_shipdate) = 1998 GROUP BY 1)
SELECT sum(coalesce(a.q, 0)) AS one, sum(coalesce(b.q, 0)) AS two, CASE WHEN sum(coalesce(a.q, 0)) > sum(coalesce(b.q, 0)) THEN 'one' ELSE 'two' END AS advantage FROM a FULL JOIN b ON a.k = b.k""")
def _(t: Tables) -> DataFrame:
    def year(y: int, name: str) -> DataFrame:
        return t.lineitem.where(F.year("l_shipdate") == y).groupBy("l_partkey").agg(F.sum("l_quantity").cast("double").alias(name))

    both = year(1996, "a").join(year(1998, "b"), "l_partkey", "full_outer").na.fill(0.0)
    return both.agg(F.sum("a").alias("one"), F.sum("b").alias("two")).withColumn("advantage", F.when(F.col("one") > F.col("two"), "one").otherwise("two"))


@query("e18_cost_estimate", "SELECT lang, count(*) FILTER (WHERE n_chars > 800) AS model_calls, count(*) FILTER (WHERE n_chars <= 800) AS rule_only, sum(CASE WHEN n_chars > 800 THEN n_chars // 4 ELSE 0 END)::BIGINT AS tokens, count(*) + 2 AS batches FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    big = F.col("n_chars") > 800
    return t.documents.groupBy("lang").agg(
        F.count_if(big).alias("model_calls"), F.count_if(~big).alias("rule_only"), F.sum(F.when(big, _tokens()).otherwise(0)).alias("tokens"), (F.count("*") + 2).alias("batches")
    )
