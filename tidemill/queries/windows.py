"""Row-order operators and greedy packing."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators import packing as K
from tidemill.operators import windows as W
from tidemill.operators.relational import top_per_group
from tidemill.queries import Tables, query


@query("w3_duplicate_flag", """SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) > 1 AS duplicate FROM events""")
def _(t: Tables) -> DataFrame:
    from tidemill.operators.aggregates import duplicates_after_first

    rows = t.events.withColumn("k", F.concat_ws(":", F.col("user_id").cast("string"), "event_type"))
    return duplicates_after_first(rows, "k", ["event_id"]).select("event_id", "duplicate")


@query("w4_forward_fill", """SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM events""")
def _(t: Tables) -> DataFrame:
    return W.forward_filled(t.events, "user_id", ["event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "section").select("event_id", "section")


@query("w5_runs", """WITH a AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, run::BIGINT AS run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY 1, 2, 3""")
def _(t: Tables) -> DataFrame:
    return W.runs(t.events, "user_id", ["event_id"], "event_type")


@query("w6_absorbed_runs", """WITH a AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR (event_type NOT IN ('error', 'view') AND event_type IS DISTINCT FROM lag(event_type) OVER w) THEN 1 ELSE 0 END AS c
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM a)
SELECT user_id, run::BIGINT AS run, arg_min(event_type, event_id) AS event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM b GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return W.runs_absorbing(t.events, "user_id", ["event_id"], "event_type", ["error", "view"])


@query("w7_islands", """WITH d AS (SELECT DISTINCT source, doc_id // 10 AS page FROM documents WHERE n_chars > 1500), a AS (SELECT *, CASE WHEN page - lag(page) OVER w <= 1 THEN 0 ELSE 1 END AS c FROM d WINDOW w AS (PARTITION BY source ORDER BY page)),
b AS (SELECT *, sum(c) OVER (PARTITION BY source ORDER BY page) AS island FROM a)
SELECT source, island::BIGINT AS island, min(page) AS first, max(page) AS last, count(*) AS n FROM b GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    return W.islands(t.documents.where("n_chars > 1500").select("source", F.floor(F.col("doc_id") / 10).alias("page")), "source", "page")


@query("w8_capped_packing", """WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
f AS (SELECT k, i, q, q AS s, 1 AS n, 0 AS bin FROM o WHERE i = 1 UNION ALL
SELECT o.k, o.i, o.q, CASE WHEN f.s + o.q > 60 OR f.n >= 3 THEN o.q ELSE f.s + o.q END, CASE WHEN f.s + o.q > 60 OR f.n >= 3 THEN 1 ELSE f.n + 1 END, CASE WHEN f.s + o.q > 60 OR f.n >= 3 THEN f.bin + 1 ELSE f.bin END
FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS l_orderkey, bin, count(*) AS n, sum(q) AS total FROM f GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem
    out = K.packed(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.col("l_quantity"), 60, 3)
    return out.groupBy("l_orderkey", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("total"))


@query("w9_merge_small", """WITH RECURSIVE o AS (SELECT l_orderkey AS k, l_returnflag AS g, l_quantity::DOUBLE AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem),
f AS (SELECT k, i, g, q, q AS s, 0 AS chunk FROM o WHERE i = 1 UNION ALL
SELECT o.k, o.i, o.g, o.q, CASE WHEN f.g = o.g AND f.s < 30 AND f.s + o.q <= 70 THEN f.s + o.q ELSE o.q END, CASE WHEN f.g = o.g AND f.s < 30 AND f.s + o.q <= 70 THEN f.chunk ELSE f.chunk + 1 END
FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS l_orderkey, chunk, min(g) AS l_returnflag, sum(q) AS size, count(*)::INT AS n FROM f GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    rows = t.lineitem
    return K.merged_small(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_returnflag", F.col("l_quantity"), 30, 70)


@query("w10_context_budget", """WITH RECURSIVE o AS (SELECT doc_id // 50 AS k, doc_id, (n_chars // 4)::DOUBLE AS a, (n_chars // 40)::DOUBLE AS b, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id) AS i FROM documents),
f AS (SELECT k, 0::BIGINT AS i, -1::BIGINT AS doc_id, 0.0::DOUBLE AS spent, '' AS use FROM o WHERE i = 1 UNION ALL
SELECT o.k, o.i, o.doc_id, f.spent + CASE WHEN o.i <= 5 AND o.a <= 7600 - f.spent - 50 THEN o.a + 50 WHEN o.b <= 7600 - f.spent - 50 THEN o.b + 50 ELSE 0 END,
CASE WHEN o.i <= 5 AND o.a <= 7600 - f.spent - 50 THEN 'full' WHEN o.b <= 7600 - f.spent - 50 THEN 'short' ELSE 'skip' END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS parent, doc_id, use, spent FROM f WHERE i > 0""")
def _(t: Tables) -> DataFrame:
    pages = t.documents.withColumn("parent", F.floor(F.col("doc_id") / 50))
    out = K.within_budget(pages, "parent", ["doc_id"], F.floor(F.col("n_chars") / 4), F.floor(F.col("n_chars") / 40), int(0.95 * 8000))
    return out.select("parent", "doc_id", "use", "spent")


@query("w11_citation_numbers", """WITH f AS (SELECT user_id, event_type, min(event_id) AS i FROM events GROUP BY 1, 2), n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY i) AS number FROM f)
SELECT e.event_id, n.number FROM events e JOIN n ON e.user_id = n.user_id AND e.event_type = n.event_type""")
def _(t: Tables) -> DataFrame:
    return W.dense_first_numbers(t.events, "user_id", ["event_id"], "event_type").select("event_id", "number")


@query("w12_latest_per_parent", "SELECT user_id, event_id, r::INT AS rank FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5")
def _(t: Tables) -> DataFrame:
    return top_per_group(t.events.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", "rank")


@query("w13_label_sequence", """SELECT event_id, coalesce(ascii(event_type) - lag(ascii(event_type)) OVER (PARTITION BY user_id ORDER BY event_id) BETWEEN 1 AND 10, false) AS continues FROM events""")
def _(t: Tables) -> DataFrame:
    return W.label_sequence(t.events, "user_id", ["event_id"], "event_type").select("event_id", "continues")


@query("w16_position_ids", "SELECT l_orderkey, 'cov_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) - 1) AS id, l_partkey FROM lineitem")
def _(t: Tables) -> DataFrame:
    nested = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_linenumber", "l_suppkey"))).alias("items"))
    return nested.select("l_orderkey", F.posexplode("items").alias("i", "x")).select("l_orderkey", F.concat(F.lit("cov_"), F.col("i").cast("string")).alias("id"), "x.l_partkey")


@query("e3_merged_intervals", """WITH a AS (SELECT event_id, user_id, event_id // 100 AS s, event_id // 100 + floor(value)::BIGINT % 4 AS e FROM events), b AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 >= s THEN 0 ELSE 1 END AS c FROM a),
p AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s, e, event_id ROWS UNBOUNDED PRECEDING) AS part FROM b)
SELECT user_id, part::BIGINT AS part, min(s) AS s, max(e) AS e, count(*) AS n FROM p GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    start = F.floor(F.col("event_id") / 100)
    rows = t.events.select("user_id", start.alias("s"), (start + F.floor("value").cast("bigint") % 4).alias("e"))
    return W.merged_intervals(rows, "user_id", "s", "e")


@query("e4_group_batches", """WITH RECURSIVE g AS (SELECT l_suppkey AS k, l_partkey AS p, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p) AS i FROM g),
f AS (SELECT k, i, q AS s, 1 AS n, 0 AS bin FROM o WHERE i = 1 UNION ALL SELECT o.k, o.i, CASE WHEN f.s + o.q > 300 OR f.n >= 5 THEN o.q ELSE f.s + o.q END, CASE WHEN f.s + o.q > 300 OR f.n >= 5 THEN 1 ELSE f.n + 1 END,
CASE WHEN f.s + o.q > 300 OR f.n >= 5 THEN f.bin + 1 ELSE f.bin END FROM f JOIN o ON o.k = f.k AND o.i = f.i + 1)
SELECT k AS l_suppkey, bin, count(*) AS n FROM f GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    g = t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    return K.packed(g, "l_suppkey", ["l_partkey"], F.col("q"), 300, 5).groupBy("l_suppkey", "bin").agg(F.count("*").alias("n"))


@query("e16_ordered_text", """SELECT conv_id, string_agg('[' || turn || ' ' || role || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY turn) AS content FROM conversations GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    item = F.struct("turn", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit(" "), "role", F.lit("]\n"), "text").alias("x"))
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda i: i["x"]), "\n\n").alias("content"))


@query("e19_context_quotes", "SELECT conv_id, count(DISTINCT lower(text)) AS quotes FROM conversations GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.size(F.array_distinct(F.collect_list(F.lower("text")))).cast("bigint").alias("quotes"))
